"""Similarities of all voter pairs, one block of voters against another.

Where most voters meet, the pairs of all votes are far more than the voter pairs they sum
up to. Voters are dealt into blocks, the votes of a block are packed into one row, each pair
of blocks gets the two rows, and its task applies the votes batch by batch to a matrix of
pair products, as the recurrences say. A task holds one matrix and the votes of two blocks,
however many voters there are; no pair of votes is shuffled or stored. The pairs of blocks
are gone through in passes, so that disk holds a bounded number of copies of the votes.
"""

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from driftsim.functions.scoring import rank_key
from driftsim.operators.ordering import positions, top_per_key
from driftsim.session import durable

# Voters and mean votes of a block, and blocks that a smaller number of voters is dealt into.
BLOCK_VOTERS, BLOCK_VOTES, LEAST_BLOCKS = 4096, 4_000_000, 12
# Copies of all packed votes that one pass shuffles.
PASS_COPIES = 16
# Cells of (voter, electee) that are found in a table; more are searched for.
TABLE_CELLS = 1 << 24
# Cells of a matrix that are ranked or returned at once.
CHUNK_CELLS = 1 << 20
# Share of positive cells of a matrix up to which these are ranked without the others.
POSITIVE = 0.25
# Electees of a group that one matrix product sums over.
GROUP_ELECTEES = 256
# Pairs of voters of a mean batch under which the batches of two blocks are applied many at
# once, and pairs that are made for it at once.
FEW_PAIRS, CHUNK_PAIRS = 512, 1 << 20
# Votes of one voter on one electee that are gone through one by one.
FEW_TIMES = 16
# Rows that are looked at at once, and those that wait to be sifted for the best.
ADDED_ROWS, WAITING_ROWS = 1 << 17, 1 << 20

LISTS = "voter_id long, neighbor_id long, sim double"
# Pairs of one voter with several others.
PAIRS = "voter_i long, voter_j array<bigint>, p array<double>"


def block_lists(
    deltas: DataFrame, voters: DataFrame, alpha: float, size: int, block: int | None = None, copies: int = PASS_COPIES
) -> DataFrame:
    """(voter_id, neighbor_id, sim): of every voter the ``size`` best of each block or pass; strangers count 0.

    ``deltas`` are (batch, voter_id, electee_id, vote), ``voters`` all that compete.
    """

    def rank(products: "Products") -> Iterator[pa.RecordBatch]:
        yield from products.best(size)

    parts = _by_block_pair(deltas, voters, block or BLOCK_VOTERS, rank, alpha, LISTS, copies)
    if len(parts) == 1:
        return parts[0]
    # A pass leaves the best of its blocks only, and what it shuffled is deleted.
    found = None
    for part in parts:
        part = durable(top_per_key(part, "voter_id", [rank_key("sim"), F.col("neighbor_id")], size).drop("rank"), last_use=True)
        found = part if found is None else found.unionByName(part)
    return found


def exact_lists(profiles: DataFrame, voters: DataFrame, size: int, block: int | None = None) -> DataFrame:
    """The same by the undecayed cosine of (voter_id, electee_id, vote).

    Nothing fades, and a group of electees stands for a batch: each is in one of them only.
    """
    electees = profiles.agg(F.count_distinct("electee_id")).first()[0]
    group = F.pmod(F.xxhash64("electee_id"), F.lit(-(-max(electees, 1) // GROUP_ELECTEES)))
    return block_lists(profiles.withColumn("batch", group), voters, 0.0, size, block)


def block_products(deltas: DataFrame, alpha: float, block: int | None = None) -> DataFrame:
    """(voter_i, voter_j, p): the decayed product of every voter pair that ever shared an electee."""
    found, *parts = block_product_parts(deltas, alpha, block)
    for part in parts:
        found = found.unionByName(part)
    return found.select("voter_i", F.inline(F.arrays_zip("voter_j", "p")))


def block_product_parts(deltas: DataFrame, alpha: float, block: int | None = None, copies: int = PASS_COPIES) -> list[DataFrame]:
    """The same in parts of different pairs, to be written one after another.

    Each part shuffles ``copies`` of the votes. The pairs themselves are not shuffled: a task
    returns those of two blocks, in lists of a voter with others of one block.
    """

    def met(products: "Products") -> Iterator[pa.RecordBatch]:
        yield from products.met_pairs()

    return _by_block_pair(deltas, deltas, block or BLOCK_VOTERS, met, alpha, PAIRS, copies)


def nearest(pairs: DataFrame, ids: np.ndarray, q: np.ndarray, size: int) -> DataFrame:
    """(voter_id, neighbor_id, sim): of each task's pairs the ``size`` best of every voter.

    ``pairs`` come in lists, ``ids`` are the voters with a norm ``q`` in order. A task keeps
    so many rows a voter, and no pair is sorted or shuffled before.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, some, many = Nearest(ids, q, size), [], 0
        for rows in batches:
            others, p = (rows.column(c) for c in ("voter_j", "p"))
            voters = np.repeat(rows.column("voter_i").to_numpy(), pa.compute.list_value_length(others).to_numpy())
            some.append((voters, others.flatten().to_numpy(), p.flatten().to_numpy()))
            many += len(voters)
            if many >= ADDED_ROWS:
                best.add(*map(np.concatenate, zip(*some)))
                some, many = [], 0
        if some:
            best.add(*map(np.concatenate, zip(*some)))
        yield best.rows()

    return pairs.select("voter_i", "voter_j", "p").mapInArrow(keep, LISTS)


class Nearest:
    """The best partners of each voter so far."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, size: int, at_once: int = WAITING_ROWS):
        self.ids, self.root = ids, np.sqrt(q)
        self.size, self.at_once, self.waiting = size, at_once, 0
        #: What a partner must reach to be among them.
        self.least = np.full(len(ids), -np.inf)
        self.found = [tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.float64, np.float64))]

    def add(self, voter_i: np.ndarray, voter_j: np.ndarray, p: np.ndarray) -> None:
        if not len(self.ids):
            return
        i, j = (np.minimum(np.searchsorted(self.ids, v), len(self.ids) - 1) for v in (voter_i, voter_j))
        known = (self.ids[i] == voter_i) & (self.ids[j] == voter_j)
        if not known.all():
            i, j, p = i[known], j[known], p[known]
        sim = p / (self.root[i] * self.root[j])
        # As ``rank_key`` does it.
        rank = np.floor(sim * 1e9 + 0.5)
        for voter, other in ((i, j), (j, i)):
            take = np.flatnonzero(rank >= self.least[voter])
            self.found.append((voter[take], other[take], rank[take], sim[take]))
            self.waiting += len(take)
        if self.waiting > max(self.at_once, len(self.found[0][0])):
            self._sift()

    def _sift(self) -> None:
        voter, other, rank, sim = (np.concatenate(c) for c in zip(*self.found))
        # Places are in order of ids.
        order = np.lexsort((other, -rank, voter))
        voter = voter[order]
        place = np.arange(len(voter)) - np.searchsorted(voter, voter)
        best = place < self.size
        order, voter, last = order[best], voter[best], place[best] == self.size - 1
        self.found, self.waiting = [(voter, other[order], rank[order], sim[order])], 0
        self.least[voter[last]] = rank[order][last]

    def rows(self) -> pa.RecordBatch:
        self._sift()
        voter, other, _, sim = self.found[0]
        return _rows(LISTS, self.ids[voter], self.ids[other], sim)


class Block(NamedTuple):
    """The votes of some voters, in order of batches."""

    ids: np.ndarray
    #: Decayed squared norm of each voter.
    q: np.ndarray
    #: The electees that were voted on.
    names: np.ndarray
    #: Of each vote the places of its voter and electee (-1: none) in these.
    member: np.ndarray
    electee: np.ndarray
    batch: np.ndarray
    vote: np.ndarray


PACKED = "block int, ids array<bigint>, q array<double>, names array<bigint>, votes binary"


def pack(block: int, votes: pa.Table, fade: float) -> pa.Table:
    """Votes (voter_id, batch, electee_id, vote) of a block as one row; a voter without votes has a null batch."""
    ids, member = np.unique(votes.column("voter_id").to_numpy(), return_inverse=True)
    cast = pa.compute.is_valid(votes.column("batch"))
    member, votes = member[cast.to_numpy()], votes.filter(cast).combine_chunks()
    batch = votes.column("batch").to_numpy()
    order = np.lexsort((member, batch))
    batch, member = batch[order], member[order]
    # A missing vote counts nothing; a missing electee is met by nobody.
    vote = votes.column("vote").fill_null(0.0).to_numpy()[order]
    known = pa.compute.is_valid(votes.column("electee_id")).to_numpy()[order]
    names, electee = np.unique(votes.column("electee_id").fill_null(0).to_numpy()[order], return_inverse=True)
    columns = {"member": member.astype(np.int32), "electee": np.where(known, electee, -1).astype(np.int32), "batch": batch, "vote": vote}
    sink = pa.BufferOutputStream()
    table = pa.table(columns)
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    row = {"block": block, "ids": ids, "q": _norms(member, batch, vote, len(ids), fade), "names": names, "votes": sink.getvalue().to_pybytes()}
    types = (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.binary())
    return pa.table({name: pa.array([value], kind) for (name, value), kind in zip(row.items(), types)})


def _norms(member: np.ndarray, batch: np.ndarray, vote: np.ndarray, members: int, fade: float) -> np.ndarray:
    """Decayed squared norm of each member: q <- dq + fade * q in its own batches."""
    if not len(member):
        return np.zeros(members)
    start = np.flatnonzero(np.concatenate([[True], (np.diff(member) != 0) | (np.diff(batch) != 0)]))
    dq, of = np.add.reduceat(vote * vote, start), member[start]
    order = np.argsort(of, kind="stable")
    dq, of = dq[order], of[order]
    last = np.searchsorted(of, of, side="right") - 1
    return np.bincount(of, dq * fade ** (last - np.arange(len(of))), members)


def unpack(row: pa.RecordBatch, at: int) -> Block:
    with pa.ipc.open_stream(row.column("votes")[at].as_buffer()) as reader:
        votes = reader.read_all()
    lists = (row.column(c)[at].values.to_numpy() for c in ("ids", "q", "names"))
    return Block(*lists, *(votes.column(c).to_numpy() for c in ("member", "electee", "batch", "vote")))


def _by_block_pair(deltas, voters, block: int, out: Callable, alpha: float, schema: str, copies: int) -> list[DataFrame]:
    """What ``out`` gives for each pair of blocks, one frame a pass."""
    spark = deltas.sparkSession
    ids = voters.select("voter_id").filter("voter_id is not null").distinct()
    n, rows = ids.count(), deltas.count()
    block = max(2, min(block, -(-n // LEAST_BLOCKS)))
    blocks = max(1, -(-n // block), min(n // 2, -(-rows // BLOCK_VOTES)))
    block = max(1, -(-n // blocks))
    blocks = max(1, -(-n // block))
    # Dealt by hash: voters with neighbouring ids may have much the same many votes.
    place = positions(ids, [F.xxhash64("voter_id"), F.col("voter_id")], "place", (), n, unique=True)
    # Written, so that the votes are not dealt by the one task that numbers the voters.
    dealt = durable(place.select("voter_id", F.floor((F.col("place") - 1) / F.lit(block)).cast("int").alias("block")))
    # Each voter comes, whether or not there are votes.
    votes = dealt.join(deltas.select("voter_id", "batch", "electee_id", "vote"), "voter_id", "left")
    fade = float(np.exp(-2.0 * alpha))

    def packed(key: tuple[pa.Scalar, ...], votes: pa.Table) -> pa.Table:
        return pack(key[0].as_py(), votes, fade)

    def run(key: tuple[pa.Scalar, ...], found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, column = (k.as_py() for k in key)
        of = {b: unpack(rows, i) for rows in found for i, b in enumerate(rows.column("block").to_pylist())}
        yield from out(Products(of[row], None if row == column else of[column], fade, schema == PAIRS))

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks_of_votes = durable(votes.repartition(max(tasks, blocks), "block").groupBy("block").applyInArrow(packed, PACKED), last_use=True)
    other = F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))
    cells, a_pass = blocks * (blocks + 1) // 2, max(1, copies * blocks // 2)
    parts = []
    for start in range(0, cells, a_pass):
        shared = blocks_of_votes.select("*", F.explode(F.filter(other, _between(start, start + a_pass))).alias("other"))
        parts.append(
            shared.withColumns({"row": F.least("block", "other"), "column": F.greatest("block", "other")})
            .select("row", "column", *(c.split()[0] for c in PACKED.split(", ")))
            # More tasks than pairs of blocks, so that few tasks get two of them.
            .repartition(max(tasks, 2 * min(a_pass, cells - start)), "row", "column")
            .groupBy("row", "column")
            .applyInArrow(run, schema)
        )
    return parts


def _between(start: int, end: int) -> Callable:
    """Whether the pair of ``block`` and another block has its number in a range."""

    def among(other):
        low, high = F.least("block", other), F.greatest("block", other)
        nth = high * (high + 1) / 2 + low
        return (nth >= start) & (nth < end)

    return among


def _rows(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({field.split()[0]: column for field, column in zip(schema.split(", "), columns)})


class Products:
    """Products of the voters of two blocks, or of one block, after all batches.

    ``met`` is filled if ``shared``: whether two voters shared an electee.
    """

    def __init__(self, row: Block, column: Block | None, fade: float, shared: bool):
        self.same, self.shared = column is None, shared
        self.sides = [row] if self.same else [row, column]
        self.ids = [side.ids for side in self.sides]
        self.first = len(row.ids)
        self.p = np.zeros((self.first, len(self.ids[-1])))
        self.met = np.zeros(self.p.shape if shared else (0, 0), bool)
        if not all(len(side.batch) for side in self.sides):
            return
        self.names = np.unique(np.concatenate([side.names for side in self.sides]))
        present = [_presence(side) for side in self.sides]
        common, *at = np.intersect1d(present[0].batches, present[-1].batches, return_indices=True)
        pairs = present[0].sizes[at[0]] * present[-1].sizes[at[1]]
        if pairs.sum() < FEW_PAIRS * len(common):
            self._apply_many(present, common, at, pairs, fade)
        else:
            self._apply_each(fade)

    def _electees(self, side: Block) -> np.ndarray:
        """Places of the votes' electees among those of both sides; -1: none."""
        return np.where(side.electee < 0, -1, np.searchsorted(self.names, side.names)[side.electee])

    def _apply_each(self, fade: float) -> None:
        """One batch after another, each by a matrix product."""
        batch, vote = (np.concatenate([getattr(side, c) for side in self.sides]) for c in ("batch", "vote"))
        electee = np.concatenate([self._electees(side) for side in self.sides])
        member = np.concatenate([side.member + n * self.first for n, side in enumerate(self.sides)]).astype(np.int64)
        order = np.argsort(batch, kind="stable")
        batch, member, vote, electee = batch[order], member[order], vote[order], electee[order]
        known = electee >= 0
        members, width = sum(map(len, self.ids)), len(self.names)
        keys = np.unique((member * width + electee)[known])
        find = _finder(keys, members * width)
        # The last slot stands for all that was never voted on.
        last, seen = np.zeros(len(keys) + 1), np.zeros(len(keys) + 1)
        edges = np.flatnonzero(np.diff(batch)) + 1
        for start, end in zip([0, *edges], [*edges, len(batch)]):
            m, e, v, ok = member[start:end], electee[start:end], vote[start:end], known[start:end]
            who, of_who = np.unique(m, return_inverse=True)
            slot = find(m[ok] * width + e[ok])
            border = np.searchsorted(who, self.first)
            if self.same or 0 < border < len(who):
                what, of_what = np.unique(e[ok], return_inverse=True)
                now, voted = np.zeros((2, len(who), len(what)))
                now[of_who[ok], of_what], voted[of_who[ok], of_what] = v[ok], 1.0
                old = find((who[:, None] * width + what).ravel()).reshape(now.shape)
                rows, columns = (slice(None),) * 2 if self.same else (slice(0, border), slice(border, None))
                known_before = seen[old]
                any_before = known_before.any()
                dp = _meet(now, last[old] if any_before else None, rows, columns)
                if len(who) == members:
                    self.p *= fade
                    self.p += dp
                else:
                    at = np.ix_(who[rows], who[columns] - (0 if self.same else self.first))
                    self.p[at] = dp + fade * self.p[at]
                if self.shared:
                    both = _meet(voted, known_before if any_before else None, rows, columns) > 0
                    self.met[np.ix_(who[rows], who[columns] - (0 if self.same else self.first))] |= both
            last[slot], seen[slot] = v[ok], 1.0

    def _apply_many(self, present: list, common: np.ndarray, at: list, pairs: np.ndarray, fade: float) -> None:
        """Many batches at once, where each has few voters of the two blocks.

        All pairs of voters of each batch are made and put in order; a pair's batches that
        follow one of them are counted there.
        """
        every = np.unique(np.concatenate([p.batches for p in present]))
        known = [_Profiles(side, self._electees(side), every, len(self.names)) for side in self.sides]
        width = self.p.shape[1]
        upto = np.cumsum(pairs)
        begin = 0
        while begin < len(common):
            done = upto[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(upto, done + CHUNK_PAIRS, side="right")))
            rows, columns = at[0][begin:end], at[1][begin:end]
            base = upto[begin:end] - pairs[begin:end] - done
            total = int(upto[end - 1] - done)
            sizes = present[-1].sizes[columns]
            first = _ragged(present[0].starts[rows], present[0].sizes[rows])
            of_first = np.repeat(np.arange(end - begin), present[0].sizes[rows])
            second = _ragged(present[-1].starts[columns][of_first], sizes[of_first])
            first, n = np.repeat(first, sizes[of_first]), np.repeat(of_first, sizes[of_first])
            cell = present[0].members[first].astype(np.int64) * width + present[-1].members[second]
            dp, met = np.zeros(total), np.zeros(total, bool)
            ways = [(0, 0, rows, rows)] if self.same else [(0, 1, rows, columns), (1, 0, columns, rows)]
            for mine, theirs, mine_at, theirs_at in ways:
                vote, k, other = present[mine].votes_with(mine_at, present[theirs].sizes[theirs_at])
                who = present[theirs].members[present[theirs].starts[theirs_at][k] + other]
                electee = known[mine].electee[vote]
                own = present[mine].place[vote]
                before, now = known[theirs].at(who, electee, known[mine].time[vote])
                # What both voted in a batch is counted from one side.
                if self.same:
                    now[own >= other] = -1
                elif mine:
                    now[:] = -1
                hit = np.flatnonzero(((before >= 0) | (now >= 0)) & (electee >= 0) & ((own != other) | (mine != theirs)))
                own, other, k = own[hit], other[hit], k[hit]
                low, high = (np.minimum(own, other), np.maximum(own, other)) if self.same else (other, own) if mine else (own, other)
                to = base[k] + low * sizes[k] + high
                votes = known[theirs].votes
                dp += np.bincount(to, self.sides[mine].vote[vote[hit]] * (votes[before[hit]] + votes[now[hit]]), total)
                met[to] = True
            if self.same:
                keep = first < second
                cell, n, dp, met = cell[keep], n[keep], dp[keep], met[keep]
            if len(cell):
                order = np.argsort(cell * (end - begin) + n)
                cell, dp, met = cell[order], dp[order], met[order]
                start = np.flatnonzero(np.concatenate([[True], np.diff(cell) != 0]))
                size = np.diff(np.concatenate([start, [len(cell)]]))
                later = np.repeat(start + size, size) - 1 - np.arange(len(cell))
                faded = fade ** np.arange(size.max() + 1)
                flat = self.p.reshape(-1)
                flat[cell[start]] = np.add.reduceat(dp * faded[later], start) + faded[size] * flat[cell[start]]
                if self.shared:
                    self.met.reshape(-1)[cell[met]] = True
            begin = end
        if self.same:
            self.p += self.p.T
            if self.shared:
                self.met |= self.met.T

    def best(self, size: int) -> Iterator[pa.RecordBatch]:
        """The ``size`` best partners of every voter, by rounded similarity and then id."""
        row, column = self.sides[0], self.sides[-1]
        i, j = self._positive()
        yield from self._best(self.p, row, column, i, j, size)
        if not self.same:
            yield from self._best(self.p.T, column, row, j, i, size)

    def _positive(self) -> tuple[np.ndarray, np.ndarray]:
        """Where products are positive, if that is few of the cells."""
        flat = self.p.reshape(-1)
        found = flat > 0
        if np.count_nonzero(found) > POSITIVE * len(flat):
            found = found[:0]
        i, j = np.divmod(np.flatnonzero(found), self.p.shape[1])
        return (i[i != j], j[i != j]) if self.same else (i, j)

    def _best(self, p: np.ndarray, mine: Block, theirs: Block, i: np.ndarray, j: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
        roots = [np.sqrt(side.q) for side in (mine, theirs)]
        rest = np.arange(len(mine.ids))
        if len(i):
            norm = roots[0][i] * roots[1][j]
            rank = np.rint(np.divide(p[i, j], norm, out=np.zeros(len(norm)), where=norm != 0) * 1e9).astype(np.int64)
            take = rank > 0
            bits = [int(n).bit_length() for n in (len(mine.ids), rank.max(), len(theirs.ids))]
            if sum(bits) < 63:
                key = np.sort((i[take] << bits[1] + bits[2]) | ((1 << bits[1]) - 1 - rank[take] << bits[2]) | j[take])
                i, j = key >> bits[1] + bits[2], key & (1 << bits[2]) - 1
                # Voters with so many positive partners have no others among the best.
                full = np.bincount(i, minlength=len(rest)) >= size
                take = full[i] & (np.arange(len(i)) - np.searchsorted(i, i) < size)
                i, j = i[take], j[take]
                yield _rows(LISTS, mine.ids[i], theirs.ids[j], p[i, j] / (roots[0][i] * roots[1][j]))
                rest = np.flatnonzero(~full)
        inverse, inverses = (np.divide(1.0, root, out=np.zeros(len(root)), where=root != 0) for root in roots)
        for start in range(0, len(rest), max(1, CHUNK_CELLS // len(theirs.ids))):
            rows = rest[start : start + max(1, CHUNK_CELLS // len(theirs.ids))]
            part = np.ascontiguousarray(p[rows[0] : rows[-1] + 1] if len(rows) == rows[-1] + 1 - rows[0] else p[rows])
            # The similarity but for its last digits, by which few are left to be ranked.
            near = part * inverse[rows, None]
            near *= inverses
            if self.same:
                near[np.arange(len(near)), rows] = -np.inf
            least = _least(near, size)[:, None]
            slack = 2e-9 * (1 + np.abs(np.maximum(least, -1e300)))
            i, j = np.divmod(np.flatnonzero(near >= least - slack), near.shape[1])
            if len(i) > 16 * size * len(near) and size < near.shape[1]:
                # Many are alike.
                norm = roots[0][rows, None] * roots[1]
                rank = np.round(np.divide(part, norm, out=np.zeros(norm.shape), where=norm != 0), 9)
                rank[near == -np.inf] = -np.inf
                low = -np.partition(-rank, size - 1, axis=1)[:, size - 1 : size]
                above, equal = rank > low, (rank == low) & (rank > -np.inf)
                i, j = np.nonzero(above | (equal & (np.cumsum(equal, axis=1) <= size - above.sum(axis=1, keepdims=True))))
            norm = roots[0][rows][i] * roots[1][j]
            sim = np.divide(part[i, j], norm, out=np.zeros(len(norm)), where=norm != 0)
            order = np.lexsort((j, -np.round(sim, 9), i))
            take = order[np.arange(len(i)) - np.searchsorted(i, i) < size]
            take = take[near[i[take], j[take]] > -np.inf]
            yield _rows(LISTS, mine.ids[rows][i[take]], theirs.ids[j[take]], sim[take])

    def met_pairs(self) -> Iterator[pa.RecordBatch]:
        """All pairs that shared an electee, each once, the smaller voter first."""
        yield from self._met_pairs(self.p, self.met, self.ids[0], self.ids[-1])
        if not self.same:
            yield from self._met_pairs(self.p.T, self.met.T, self.ids[1], self.ids[0])

    def _met_pairs(self, p: np.ndarray, met: np.ndarray, ids: np.ndarray, others: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Those of which the voter among ``ids`` is the smaller one."""
        for start in range(0, len(ids), max(1, CHUNK_CELLS // len(others))):
            rows = slice(start, start + max(1, CHUNK_CELLS // len(others)))
            i, j = np.nonzero(np.ascontiguousarray(met[rows]) & (ids[rows, None] < others))
            voters, sizes = np.unique(i, return_counts=True)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield _rows(PAIRS, ids[rows][voters], *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in (others[j], p[rows][i, j])))


def _least(near: np.ndarray, size: int) -> np.ndarray:
    """Of each row a value that ``size`` cells or more reach: among the maxima of its parts, which are fewer."""
    width, parts = near.shape[1], max(64, 4 * size)
    if size > width:
        return np.full(len(near), -np.inf)
    if 2 * parts <= width:
        near = near[:, : parts * (width // parts)].reshape(len(near), parts, -1).max(axis=2)
    return np.partition(near, near.shape[1] - size, axis=1)[:, near.shape[1] - size]


class _Presence(NamedTuple):
    """The members of each batch: ``members[start : start + size]``, and the votes of each of them."""

    batches: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    members: np.ndarray
    #: Of each batch its first vote and how many it has; of each vote its member's place in the batch.
    first_vote: np.ndarray
    votes: np.ndarray
    place: np.ndarray

    def votes_with(self, at: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, ...]:
        """Each vote of some batches with each of the other members there.

        Returns the votes, which of the batches they are of, and the places of the others.
        """
        vote, k = _ragged(self.first_vote[at], self.votes[at]), np.repeat(np.arange(len(at)), self.votes[at])
        many = others[k]
        return np.repeat(vote, many), np.repeat(k, many), _ragged(np.zeros(len(many), np.int64), many)


def _presence(side: Block) -> _Presence:
    new_batch = np.concatenate([[True], np.diff(side.batch) != 0])
    new = new_batch | np.concatenate([[True], np.diff(side.member) != 0])
    first_vote = np.flatnonzero(new_batch)
    starts = (np.cumsum(new) - 1)[first_vote]
    sizes = np.diff(np.concatenate([starts, [new.sum()]]))
    votes = np.diff(np.concatenate([first_vote, [len(new)]]))
    place = np.cumsum(new) - 1 - np.repeat(starts, votes)
    return _Presence(side.batch[first_vote], starts, sizes, side.member[new], first_vote, votes, place)


class _Profiles:
    """What the members of a side had voted at any time."""

    def __init__(self, side: Block, electee: np.ndarray, every: np.ndarray, width: int):
        self.electee, self.time = electee, np.searchsorted(every, side.batch)
        self.width, self.times = width, len(every)
        group = side.member.astype(np.int64) * width + electee
        order = np.lexsort((self.time, group, electee < 0))[: np.count_nonzero(electee >= 0)]
        self.group, self.when = group[order], self.time[order]
        # The last vote is nobody's.
        self.votes = np.append(side.vote[order], 0.0)
        self.first = None
        if len(side.ids) * width <= TABLE_CELLS:
            counts = np.bincount(self.group, minlength=len(side.ids) * width)
            if counts.max() <= FEW_TIMES:
                self.first = np.concatenate([[0], np.cumsum(counts)])
        if self.first is None:
            self.keys = self.group * self.times + self.when

    def at(self, member: np.ndarray, electee: np.ndarray, time: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``votes`` of the last vote before the time and of the one at it; -1: there is none."""
        group = member.astype(np.int64) * self.width + electee
        none = len(self.when)
        if not none:
            return np.full((2, len(group)), -1)
        if self.first is None:
            place = np.searchsorted(self.keys, group * self.times + time)
            was = (place > 0) & (self.group[place - 1] == group)
            at = np.minimum(place, none - 1)
            has = (place < none) & (self.group[at] == group) & (self.when[at] == time)
        else:
            start, end = self.first[group], self.first[group + 1]
            place = start.copy()
            left = np.flatnonzero(start < end)
            while len(left):
                left = left[self.when[place[left]] < time[left]]
                place[left] += 1
                left = left[place[left] < end[left]]
            was = place > start
            has = (place < end) & (self.when[np.minimum(place, none - 1)] == time)
        return np.where(was, place - 1, -1), np.where(has, place, -1)


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, one run after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def _meet(now: np.ndarray, before: np.ndarray | None, rows: slice, columns: slice) -> np.ndarray:
    """Votes of a batch with what the others had voted before it, if anything, and with those of the batch."""
    if before is None:
        return now[rows] @ now[columns].T
    return now[rows] @ before[columns].T + (before[rows] + now[rows]) @ now[columns].T


def _finder(keys: np.ndarray, cells: int) -> Callable:
    """Places of keys among sorted ones; -1 for a key that is not there."""
    if cells <= TABLE_CELLS:
        table = np.full(cells, -1, np.int32)
        table[keys] = np.arange(len(keys), dtype=np.int32)
        return table.__getitem__

    def search(wanted: np.ndarray) -> np.ndarray:
        place = np.searchsorted(keys, wanted)
        place[place == len(keys)] = 0
        return np.where(keys[place] == wanted, place, -1) if len(keys) else np.full(len(wanted), -1)

    return search
