"""Neighbour lists out of users' whole lists, where the sums of pairs are far too many to be rows.

Users are packed into one row each. A pass takes some of the items: the products of each of
them with the rest of its users' lists are dealt out by item, packed, and the task that gets
an item sums and ranks all its partners. Nothing else of a pair is shuffled, sorted by Spark
or stored, and a list is whole when its pass ends.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from driftsim.session import durable, few_records

# Products (of both directions) that one task should sum, and that are made or kept at once.
PART_PRODUCTS, CHUNK_PRODUCTS = 2_000_000, 1 << 21
# Lists or packed products that go to Python at once.
RECORDS = 256

DEALT = "part int, items array<bigint>, runs array<int>, others binary, products binary"
LISTS = "item_id long, neighbor_id long, sim double, rank int"


def neighbor_lists(rows: DataFrame, k: int, pairs: float, pass_pairs: int, largest: int, list_rows: int) -> DataFrame:
    """The k most similar items of every item: (item_id, neighbor_id, sim, rank).

    ``rows`` are (user_id, item_id, v), each item once a user and no value missing; ``pairs``
    bounds the pairs that meet, ``largest`` the rows of a user.
    """
    passes = max(1, -(-round(pairs) // pass_pairs))
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, -(-round(2 * pairs) // (passes * PART_PRODUCTS)))
    lists = durable(user_lists(rows, largest, list_rows), last_use=True)
    found = None
    for nth in range(passes):

        def deal(batches: Iterator[pa.RecordBatch], nth=nth) -> Iterator[pa.RecordBatch]:
            yield from _dealt(batches, nth, passes, parts)

        def rank(dealt: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield _ranked(dealt, k)

        with few_records(rows.sparkSession, RECORDS):
            part = lists.mapInArrow(deal, DEALT).repartition(parts, "part").groupBy("part").applyInArrow(rank, LISTS)
            part = durable(part, last_use=True)
        found = part if found is None else found.unionByName(part)
    return found


def user_lists(rows: DataFrame, largest: int, list_rows: int) -> DataFrame:
    """(rated, others): lists of (item_id, v) whose items all meet; those of one list if ``others`` is null.

    A user of more than ``list_rows`` rows is cut into lists by item hash, each of which meets each.
    """
    entry = F.collect_list(F.struct("item_id", "v"))
    if largest <= list_rows:
        own = rows.groupBy("user_id").agg(entry.alias("rated"))
        return own.select("rated", F.lit(None).cast(own.schema["rated"].dataType).alias("others"))
    counted = rows.groupBy("user_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(list_rows)).alias("__g"))
    cut = rows.join(counted, "user_id").withColumn("__chunk", F.pmod(F.xxhash64("item_id"), F.col("__g")))
    lists = durable(cut.groupBy("user_id", "__g", "__chunk").agg(entry.alias("rated")), last_use=True)
    none = F.lit(None).cast(lists.schema["rated"].dataType).alias("others")
    long = lists.filter("__g > 1")
    met = long.select("user_id", "rated").join(long.select("user_id", F.col("rated").alias("others")), "user_id")
    return lists.filter("__g = 1").select("rated", none).unionByName(met.select("rated", "others"))


def _dealt(batches: Iterator[pa.RecordBatch], nth: int, passes: int, parts: int) -> Iterator[pa.RecordBatch]:
    """The products of the items of a pass, so many at once, packed by the part they are dealt to."""
    waiting, many, products = [], 0, 0
    for batch in batches:
        item, v, size, start = _flattened(batch.column("rated"))
        own = batch.column("others").is_null().to_numpy(zero_copy_only=False)
        far_item, far_v, far_size, far_start = _flattened(batch.column("others"))
        # Partners are looked up behind the batch's own rows where they are other lists.
        size_of, start_of = np.where(own, size, far_size), np.where(own, start, far_start + len(item))
        where = _hashed(item) % np.uint64(passes * parts)
        mine = np.flatnonzero(where % np.uint64(passes) == nth)
        lists = np.repeat(np.arange(len(size)), size)[mine]
        waiting.append((item[mine], v[mine], (where[mine] // np.uint64(passes)).astype(np.int64), start_of[lists] + many, size_of[lists], np.concatenate([item, far_item]), np.concatenate([v, far_v])))
        many += len(item) + len(far_item)
        products += int(size_of[lists].sum())
        if products >= CHUNK_PRODUCTS:
            yield from _packed(waiting)
            waiting, many, products = [], 0, 0
    if waiting:
        yield from _packed(waiting)


def _packed(waiting: list) -> Iterator[pa.RecordBatch]:
    item, v, part, start, size, partners, values = (np.concatenate(c) for c in zip(*waiting))
    order = np.lexsort((item, part))
    item, v, part, start, size = item[order], v[order], part[order], start[order], size[order]
    upto = np.cumsum(size)
    begin = 0
    while begin < len(item):
        end = max(begin + 1, int(np.searchsorted(upto, upto[begin] - size[begin] + 2 * CHUNK_PRODUCTS, side="right")))
        runs = size[begin:end]
        at = np.repeat(start[begin:end] - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())
        other, product = partners[at], np.repeat(v[begin:end], runs) * values[at]
        # An item is no partner of its own.
        keep = other != np.repeat(item[begin:end], runs)
        of = np.repeat(np.arange(len(runs)), runs)[keep]
        runs = np.bincount(of, minlength=len(runs))
        other, product = other[keep], product[keep]
        if len(other) and other.min() >= 0 and other.max() < 1 << 32:
            other = other.astype(np.uint32)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(part[begin:end])) + 1, [end - begin]])
        ends = np.concatenate([[0], np.cumsum(runs)])
        columns = [[], [], [], [], []]
        for a, b in zip(edges[:-1], edges[1:]):
            row = (part[begin + a], item[begin + a : begin + b], runs[a:b], other[ends[a] : ends[b]].tobytes(), product[ends[a] : ends[b]].tobytes())
            for column, value in zip(columns, row):
                column.append(value)
        kinds = (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary())
        yield pa.record_batch([pa.array(c, kind) for c, kind in zip(columns, kinds)], [c.split()[0] for c in DEALT.split(", ")])
        begin = end


def _ranked(dealt: Iterator[pa.RecordBatch], k: int) -> pa.RecordBatch:
    """The sums of all items of a part, and the best of each item."""
    some, many = [], 0
    for batch in dealt:
        for r in range(batch.num_rows):
            item, runs = (batch.column(c)[r].values.to_numpy() for c in ("items", "runs"))
            product = np.frombuffer(batch.column("products")[r].as_buffer(), np.float64)
            others = batch.column("others")[r].as_buffer()
            other = np.frombuffer(others, np.uint32 if len(others) < 8 * len(product) else np.int64)
            some.append((np.repeat(item, runs), other.astype(np.int64), product))
            many += len(product)
        if some and many > 2 * CHUNK_PRODUCTS + 2 * len(some[0][0]):
            some, many = [_summed(some)], 0
    if not some:
        return pa.record_batch([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.int32())], [c.split()[0] for c in LISTS.split(", ")])
    item, other, total = _summed(some)
    # As ``clamp`` and ``rank_key`` do it.
    sim = np.clip(np.floor(total * 1e12 + 0.5) / 1e12, -1.0, 1.0)
    order = np.lexsort((-np.floor(sim * 1e9 + 0.5), item))
    item = item[order]
    place = np.arange(len(item)) - np.searchsorted(item, item)
    best = place < k
    order = order[best]
    columns = item[best], other[order], sim[order], (place[best] + 1).astype(np.int32)
    return pa.record_batch([pa.array(c) for c in columns], [c.split()[0] for c in LISTS.split(", ")])


def _summed(some: list) -> tuple[np.ndarray, ...]:
    """Products summed for each (item, other), in that order."""
    item, other, product = (np.concatenate(c) for c in zip(*some))
    if not len(item):
        return item, other, product
    names, of = np.unique(item, return_inverse=True)
    bits = int(other.max()).bit_length()
    if other.min() >= 0 and bits + len(names).bit_length() < 63:
        key = (of << bits) | other
        order = np.argsort(key)
        key = key[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    else:
        order = np.lexsort((other, of))
        start = np.flatnonzero(np.concatenate([[True], (np.diff(of[order]) != 0) | (other[order][1:] != other[order][:-1])]))
    first = order[start]
    return item[first], other[first], np.add.reduceat(product[order], start)


def _flattened(lists: pa.Array) -> tuple[np.ndarray, ...]:
    """Items and values of all lists, and how long each list is and where it starts; a missing list is empty."""
    entries, size = lists.flatten(), pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy().astype(np.int64)
    item, v = (entries.field(c).to_numpy(zero_copy_only=False) for c in ("item_id", "v"))
    return item, v, size, np.cumsum(size) - size


def _hashed(item: np.ndarray) -> np.ndarray:
    """Item numbers well mixed (splitmix64)."""
    x = item.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
