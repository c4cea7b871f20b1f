"""Blocks of windows around shared seeds, and what the first block of each seed settles.

A unit is a word or a byte. Every window of ``window`` units has one seed, the run of
``seed`` units in it with the smallest hash (the first on ties), which depends on the
window alone. Neighbouring windows mostly share their seed's place: they are a block. Equal
windows have equal seeds at the same distance, so only blocks of one seed can hold equal
windows, and a seed that stands in one place alone leads nowhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from driftsim.llm.text import NOT_BLANK, byte_values, find_words, prefix_sums, sliding_argmin, slices, span_hashes, text_buffer, word_hashes
from driftsim.session import durable

_BASE = 0xC2B2AE3D27D4EB4F


@dataclass
class Units:
    """Units of the rows of a slice: their hashes; row r has those from first[r] to first[r + 1]."""

    values: np.ndarray
    row: np.ndarray
    first: np.ndarray


@dataclass(frozen=True)
class Kind:
    cut: Callable[[pa.Array], Units]
    window: int
    seed: int


def words(column: pa.Array) -> Units:
    found = find_words(*text_buffer(column), NOT_BLANK)
    return Units(word_hashes(found), found.row, found.first)


def bytes_(column: pa.Array) -> Units:
    data, starts, ends = text_buffer(column)
    return Units(byte_values(data), np.repeat(np.arange(len(starts)), ends - starts), np.append(starts, len(data)))


@dataclass
class Blocks:
    """Blocks of a slice: first window, number of windows, distance of the seed, seed, hash of all their units."""

    row: np.ndarray
    start: np.ndarray
    n: np.ndarray
    gap: np.ndarray
    seed: np.ndarray
    whole: np.ndarray
    prefix: np.ndarray
    base: np.ndarray


def blocks_of(units: Units, kind: Kind) -> Blocks:
    none, size = np.zeros(0, np.int64), len(units.values)
    if size < kind.window:
        return Blocks(none, none, none, none, none, none, none, none)
    prefix = prefix_sums(units.values, _BASE)
    at = np.arange(size - kind.seed + 1)
    grams = span_hashes(prefix, at, at + kind.seed, _BASE)
    place = sliding_argmin(grams, kind.window - kind.seed + 1)
    start = np.flatnonzero(units.row[: size - kind.window + 1] == units.row[kind.window - 1 :])
    if not len(start):
        return Blocks(none, none, none, none, none, none, none, none)
    place = place[start]
    lo = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)]))
    n = np.diff(np.append(lo, len(start)))
    begin = start[lo]
    whole = span_hashes(prefix, begin, begin + n - 1 + kind.window, _BASE)
    row = units.row[begin]
    return Blocks(row, begin - units.first[row], n, place[lo] - begin, grams[place[lo]].view(np.int64), whole.view(np.int64), prefix, begin)


def window_hashes(blocks: Blocks, which: np.ndarray, kind: Kind) -> np.ndarray:
    """Hashes of all windows of the blocks ``which``, one after another."""
    n = blocks.n[which]
    start = np.repeat(blocks.base[which], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return span_hashes(blocks.prefix, start, start + kind.window, _BASE).view(np.int64)


def hashes_at(values: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the ``length`` values from each start."""
    return span_hashes(prefix_sums(values, _BASE), start, start + length, _BASE).view(np.int64)


def block_table(docs: DataFrame, kind: Kind) -> DataFrame:
    """Every block of ``docs`` (id, print, text), without its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = blocks_of(kind.cut(part.column("text")), kind)
                rows = pa.array(found.row)
                small = [pa.array(x.astype(np.int32)) for x in (found.start, found.gap, found.n)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(rows), part.column("print").take(rows), pa.array(found.seed), *small, pa.array(found.whole)],
                    ["id", "print", "seed", "start", "gap", "n", "whole"],
                )

    return docs.select("id", "print", "text").mapInArrow(run, "id long, print long, seed long, start int, gap int, n int, whole long")


def repeated_blocks(table: DataFrame, across: bool) -> DataFrame:
    """The blocks of a ``block_table`` whose seeds stand in two places, next to the first block of their seed.

    ``across``: the two places must be in documents of different ids. Adds ``first_id``,
    ``is_first``, ``same`` (equal to the first block), ``open`` (not all blocks of the
    seed are equal) and ``places`` (how many there are). The seed's figures are summed
    in parts before they meet, and joined back, so a frequent seed is one row on one side.
    """
    seeds = table.groupBy("seed").agg(
        F.min(F.struct("id", "start", "gap", "n", "whole")).alias("one"),
        F.max("id").alias("last_id"),
        F.count("*").alias("places"),
        F.min("whole").alias("low"),
        F.max("whole").alias("high"),
    )
    # Written, so that the join is one of two plain tables, whose hot keys Spark can split.
    seeds = durable(
        seeds.filter(F.col("one.id") < F.col("last_id") if across else F.col("places") > 1).select(
            "seed", "one", "places", (F.col("low") < F.col("high")).alias("open")
        ),
        last_use=True,
    )
    same = (F.col("gap") == F.col("one.gap")) & (F.col("n") == F.col("one.n")) & (F.col("whole") == F.col("one.whole"))
    return durable(
        table.join(seeds, "seed").select(
            "id",
            "print",
            "seed",
            "start",
            "gap",
            "n",
            "places",
            "open",
            F.col("one.id").alias("first_id"),
            same.alias("same"),
            (same & (F.col("id") == F.col("one.id")) & (F.col("start") == F.col("one.start"))).alias("is_first"),
        ),
        last_use=True,
    )


def with_blocks(docs: DataFrame, wanted: DataFrame, *columns: str) -> DataFrame:
    """``docs`` (id, print, text) that have rows in ``wanted``, with their ``columns`` in an array ``wanted``.

    ``wanted`` has (id, print) too; a document's rows are no more than its own blocks.
    """
    listed = (
        wanted.groupBy(F.col("id").alias("id2"), F.col("print").alias("print2"))
        .agg(F.collect_set(F.struct(*columns)).alias("wanted"))
    )
    return docs.join(listed, (F.col("id") == F.col("id2")) & (F.col("print") == F.col("print2"))).select("id", "print", "text", "wanted")


def pick(found: Blocks, wanted: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The blocks of a slice that its rows want, with the ``places`` and ``is_first`` wanted with them."""
    offsets = wanted.offsets.to_numpy()
    flat = wanted.flatten()
    row = np.repeat(np.arange(len(wanted)), np.diff(offsets))
    start = flat.field("start").to_numpy().astype(np.int64)
    key, mine = row << 36 | start, found.row << 36 | found.start
    order = np.argsort(key)
    if not len(key) or not len(mine):
        return (np.zeros(0, np.int64),) * 3
    at = np.minimum(np.searchsorted(key[order], mine), len(key) - 1)
    which = np.flatnonzero(key[order][at] == mine)
    taken = order[at[which]]
    return which, flat.field("places").to_numpy()[taken], flat.field("is_first").to_numpy(zero_copy_only=False)[taken]


def runs_by_document(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """``docs`` (document, id, print) with an array ``runs`` of (start, n), null if there are none."""
    listed = runs.groupBy(F.col("id").alias("id2"), F.col("print").alias("print2")).agg(F.collect_set(F.struct("start", "n")).alias("runs"))
    return docs.join(listed, (F.col("id") == F.col("id2")) & (F.col("print") == F.col("print2")), "left").select("document", "runs")


def covered(runs: pa.ListArray, first: np.ndarray, window: int) -> np.ndarray:
    """Which units of a slice stand under a window of their row's runs; row r has those from first[r]."""
    per_row = pc.fill_null(pc.list_value_length(runs), 0).to_numpy()
    flat = runs.flatten()
    start = flat.field("start").to_numpy().astype(np.int64) + np.repeat(first[:-1], per_row)
    end = start + flat.field("n").to_numpy() + window - 1
    cover = np.bincount(start, minlength=first[-1] + 1) - np.bincount(end, minlength=first[-1] + 1)
    return np.cumsum(cover[:-1]) > 0


def spans(gone: np.ndarray, first: np.ndarray) -> pa.ListArray:
    """The maximal runs of ``gone`` units of every row, as (start, end) within the row."""
    border = np.zeros(len(gone) + 1, bool)
    border[first] = True
    before, after = np.zeros_like(gone), np.zeros_like(gone)
    before[1:], after[:-1] = gone[:-1], gone[1:]
    start = np.flatnonzero(gone & (~before | border[:-1]))
    end = np.flatnonzero(gone & (~after | border[1:])) + 1
    row = np.searchsorted(first[1:], start, "right")
    offsets = np.searchsorted(row, np.arange(len(first))).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(start - first[row]), pa.array(end - first[row])], names=["start", "end"])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def counted(gone: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many units of each row are gone."""
    total = np.zeros(len(gone) + 1, np.int64)
    np.cumsum(gone, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
