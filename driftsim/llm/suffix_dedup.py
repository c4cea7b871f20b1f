"""Repeated byte strings, by difference-cover suffix sorting of the places that can repeat."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from driftsim.llm.blocks import Kind, block_table, bytes_, counted, covered, hashes_at, repeated_blocks, runs_by_document, spans, with_blocks
from driftsim.llm.text import byte_values, column_at, slices, text_buffer
from driftsim.session import durable

#: Bytes of a string that counts, and of a seed inside it.
LENGTH, SEED = 200, 24
#: Seeds with more places than this are no group of one task: their strings are counted one by one.
SEED_PLACES = 64
#: Bytes of the blocks that are sorted at once: the sorter's arrays stay in a core's cache.
SHARD_BYTES = 64 << 10
#: Runs that are handed on at once.
RUN_ROWS = 10_000
_KIND = Kind(bytes_, LENGTH, SEED)


def _names(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the tuples, and the rank of each (equal tuples share it, from 1)."""
    tops = [int(c.max()) + 1 for c in columns]
    new = np.zeros(len(columns[0]), bool)
    if math.prod(tops) < 1 << 62:
        # The tuples as single numbers, which sort much faster.
        key = columns[0]
        for c, top in zip(columns[1:], tops[1:], strict=True):
            key = key * top + c
        order = np.argsort(key)
        key = key[order]
        new[1:] = key[1:] != key[:-1]
    else:
        order = np.lexsort(columns[::-1])
        for c in columns:
            sorted_c = c[order]
            new[1:] |= sorted_c[1:] != sorted_c[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) + 1
    return order, rank


def suffix_array(symbols: np.ndarray, step: int = 1) -> np.ndarray:
    """Suffix array of positive integers by the difference cover {1, 2} modulo 3.

    The triples at the sampled places are sorted and named. If names repeat, the sampled
    suffixes are sorted by recursion on the names. The other suffixes follow by their
    first symbol and the rank behind it, and the two orders are merged. Small symbols are
    taken by twos, six to a triple, and a name then spans two places of the next recursion,
    whose triples have their symbols ``step`` places apart.
    """
    n = len(symbols)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: symbols[i:].tolist()), np.int64)
    s = np.concatenate([symbols, np.zeros(3 * step + 6, np.int64)])
    # One more sampled place if n is 1 modulo 3, so that the two halves stay apart.
    ends = (n + (n % 3 == 1), n)
    top = int(s.max()) + 2
    small = step == 1 and top**6 < 1 << 62

    def behind(depth: int) -> np.ndarray:
        return np.concatenate([s[1 + depth : ends[0] + depth : 3], s[2 + depth : ends[1] + depth : 3]])

    sampled = np.concatenate([np.arange(1, ends[0], 3), np.arange(2, ends[1], 3)])
    if small:
        pairs = s[:-1] * top + s[1:]
        six = (pairs[:-4] * top**2 + pairs[2:-2]) * top**2 + pairs[4:]
        order, names = _names([np.concatenate([six[1 : ends[0] : 3], six[2 : ends[1] : 3]])])
    else:
        order, names = _names([behind(0), behind(step), behind(2 * step)])
    if names.max() < len(names):
        order = suffix_array(names, 2 if small or step == 2 else 1)
    rank = np.zeros(n + 4, np.int64)
    first = sampled[order]
    rank[first] = np.arange(1, len(order) + 1)
    first = first[first < n]
    zero_order, _ = _names([s[0:n:3], rank[1 : n + 1 : 3]])
    zero = zero_order * 3
    # How many sampled suffixes stand before each other one: those of 1 by (symbol, rank
    # behind), those of 2 by (symbol, symbol, rank behind).
    before = np.zeros(len(zero), np.int64)
    width = int(rank.max()) + 2
    of_one, of_two = first[first % 3 == 1], first[first % 3 == 2]
    if top * width < 1 << 62 and top * top * width < 1 << 62:
        before += np.searchsorted(s[of_one] * width + rank[of_one + 1], s[zero] * width + rank[zero + 1])
        before += np.searchsorted((s[of_two] * top + s[of_two + 1]) * width + rank[of_two + 2], (s[zero] * top + s[zero + 1]) * width + rank[zero + 2])
    else:
        for group, depth in ((of_one, 1), (of_two, 2)):
            both = np.concatenate([group, zero])
            keys = [s[both + d] for d in range(depth)] + [rank[both + depth]]
            order, _ = _names([*keys, np.concatenate([np.ones(len(group), np.int64), np.zeros(len(zero), np.int64)])])
            is_group = order < len(group)
            place = np.cumsum(is_group)[~is_group]
            where = np.empty(len(zero), np.int64)
            where[order[~is_group] - len(group)] = place
            before += where
    out = np.empty(n, np.int64)
    at = np.arange(len(zero)) + before
    out[at] = zero
    free = np.ones(n, bool)
    free[at] = False
    out[free] = first
    return out


def repeated_starts(texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each text, whether the ``length`` bytes at a place also start at another place of any text."""
    size = np.array([len(t) for t in texts], np.int64)
    # Each text ends with a symbol of its own, so that suffixes are compared within texts.
    symbols = np.empty(int(size.sum()) + len(texts), np.int64)
    ends = np.cumsum(size + 1) - 1
    inner = np.ones(len(symbols), bool)
    inner[ends] = False
    symbols[inner] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + len(texts) + 1
    symbols[ends] = np.arange(1, len(texts) + 1)
    order = suffix_array(symbols)
    text = np.repeat(np.arange(len(texts)), size + 1)
    long = ends[text] - np.arange(len(symbols)) >= length
    # Equal beginnings stand side by side: compare each suffix of full length with the next.
    order = order[long[order]]
    hit = np.zeros(len(symbols), bool)
    raw = np.zeros(len(symbols) + 8, np.uint64)
    raw[: len(symbols)][inner] = np.frombuffer(b"".join(texts), np.uint8)
    eight = sum(raw[k : len(symbols) + k] << np.uint64(8 * k) for k in range(8))
    a, b = order[:-1], order[1:]
    # Eight bytes at a time, the last eight of the string last.
    for k in [*range(0, length - 8, 8), length - 8]:
        same = eight[a + k] == eight[b + k]
        a, b = a[same], b[same]
    hit[a] = True
    hit[b] = True
    return [hit[e - s : e] for s, e in zip(size, ends, strict=True)]


_CONTENT = "id long, print long, seed long, places long, is_first boolean, start int, n int, content binary"


def _contents(docs: DataFrame) -> DataFrame:
    """The wanted blocks of each document with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, starts, _ = text_buffer(part.column("text"))
                raw, wanted = data.tobytes(), part.column("wanted")
                flat = wanted.flatten()
                row = np.repeat(np.arange(len(wanted)), np.diff(wanted.offsets.to_numpy()))
                begin = starts[row] + flat.field("start").to_numpy()
                end = begin + flat.field("n").to_numpy() - 1 + LENGTH
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(rows),
                        part.column("print").take(rows),
                        *(flat.field(c) for c in ("seed", "places", "is_first", "start", "n")),
                        pa.array([raw[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary()),
                    ],
                    [f.split()[0] for f in _CONTENT.split(", ")],
                )

    return docs.mapInArrow(run, _CONTENT)


def _sort_shards(blocks: DataFrame) -> DataFrame:
    """Runs of repeated windows in blocks dealt out and sorted by seed: a shard is some whole seeds."""

    def runs(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "print", "start", "n"])

    def shard(rows: list[tuple]) -> Iterator[tuple]:
        for (id_, print_, _, start, _), hit in zip(rows, repeated_starts([r[4] for r in rows]), strict=True):
            for a, b in np.flatnonzero(np.diff(hit, prepend=False, append=False)).reshape(-1, 2).tolist():
                yield id_, print_, start + a, b - a

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, found = [], 0, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("id", "print", "seed", "start", "content")), strict=True):
                if held > SHARD_BYTES and row[2] != rows[-1][2]:
                    found += shard(rows)
                    rows, held = [], 0
                    if len(found) >= RUN_ROWS:
                        yield runs(found)
                        found = []
                rows.append(row)
                held += len(row[4])
        if rows:
            found += shard(rows)
        yield runs(found)

    dealt = blocks.select("id", "print", "seed", "start", "content").repartition("seed").sortWithinPartitions("seed")
    return dealt.mapInArrow(run, "id long, print long, start int, n int")


def _windows(blocks: DataFrame) -> DataFrame:
    """(id, print, seed, start, hash) of every window of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "content"):
                data, starts, ends = text_buffer(part.column("content"))
                n = ends - starts - LENGTH + 1
                row = np.repeat(np.arange(len(n)), n)
                nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                hashes = hashes_at(byte_values(data), starts[row] + nth, LENGTH)
                rows = pa.array(row)
                start = part.column("start").to_numpy().astype(np.int64)[row] + nth
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(rows) for c in ("id", "print", "seed")), pa.array(start.astype(np.int32)), pa.array(hashes)],
                    ["id", "print", "seed", "start", "hash"],
                )

    return blocks.select("id", "print", "seed", "start", "content").mapInArrow(run, "id long, print long, seed long, start int, hash long")


def duplicate_strings(docs: DataFrame) -> DataFrame:
    """(id, print, start, n): runs of places whose LENGTH bytes also start anywhere else.

    Where all blocks of a seed are equal, all of them repeat. A block equal to the first
    of its seed repeats, and so does that first. The others are sorted: blocks are dealt
    out by seed to shards of bounded size, and each shard's suffixes are sorted by the
    difference cover and compared with their neighbours. A seed of very many places is
    no such group; its windows are counted one by one by their hashes, in parts.
    """
    table = repeated_blocks(block_table(docs, _KIND), across=False)
    known = table.filter("(not open) or (same and not is_first)").select("id", "print", "start", "n")
    wanted = table.filter("open and (is_first or not same)")
    contents = durable(_contents(with_blocks(docs, wanted, "seed", "start", "n", "places", "is_first")), last_use=True)
    copied = durable(table.filter("open and same and not is_first").select("seed").distinct(), last_use=True)
    firsts = contents.filter("is_first").join(copied, "seed").select("id", "print", "start", "n")
    few = _sort_shards(contents.filter(F.col("places") <= SEED_PLACES))
    many = _windows(contents.filter(F.col("places") > SEED_PLACES))
    times = many.groupBy("seed", "hash").agg(F.count("*").alias("times"))
    twice = durable(times.filter("times > 1").drop("times"), last_use=True)
    counted = many.join(twice, ["seed", "hash"]).select("id", "print", "start", F.lit(1).alias("n"))
    return known.unionByName(firsts).unionByName(few).unionByName(counted)


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """Remove every byte under a string of LENGTH bytes that also starts anywhere else.

    Returns (document, n_bytes, n_removed, spans, kept) for every row of ``docs`` (doc_id,
    text, ...): ``document`` is the input row as a struct, so columns of any name pass
    through; ``spans`` are the maximal removed byte ranges; ``kept`` are the other bytes,
    which need not be whole characters. Matches never cross documents; both places of a
    match go, overlapping ones too, in one document as well. Strings are judged on the
    input. A null text is empty; a null doc_id is a document like any other; rows that are
    there twice repeat one another. A very long text is cut into blocks by one task, which
    are sorted in many.
    """
    whole = docs.select(F.struct("*").alias("document"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"), F.xxhash64("doc_id", "text").alias("print"))
    texts = docs.filter("text is not null").select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"), F.xxhash64("doc_id", "text").alias("print"), "text"
    )
    added = T.StructType.fromDDL("n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "document.text"):
                data, starts, ends = text_buffer(column_at(part, "document.text"))
                first = np.concatenate([[0], ends]).astype(np.int64)
                gone = covered(part.column("runs"), first, LENGTH)
                removed = counted(gone, first)
                offsets = np.concatenate([[0], np.cumsum(ends - starts - removed)]).astype(np.int32)
                kept = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[~gone])])
                columns = [pa.array(ends - starts), pa.array(removed), spans(gone, first), kept]
                yield pa.RecordBatch.from_arrays([part.column("document"), *columns], ["document", *added.names])

    found = runs_by_document(whole, duplicate_strings(texts))
    return found.mapInArrow(remove, T.StructType([T.StructField("document", found.schema["document"].dataType), *added.fields]))
