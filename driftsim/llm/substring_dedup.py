"""Repeated passages of many words, by relative Lempel-Ziv factors against indexed blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from driftsim.llm.blocks import Kind, block_table, blocks_of, counted, covered, pick, repeated_blocks, runs_by_document, spans, window_hashes, with_blocks, words
from driftsim.llm.text import NOT_BLANK, Words, column_at, find_words, slices, text_buffer
from driftsim.session import durable

#: Words of a window, and of a seed inside it.
WINDOW, SEED = 50, 16
_KIND = Kind(words, WINDOW, SEED)


def _open_blocks(docs: DataFrame) -> DataFrame:
    """(id, print, seed, is_first, start, gap, hashes): the wanted blocks with their windows' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = blocks_of(words(part.column("text")), _KIND)
                which, _, first = pick(found, part.column("wanted"))
                offsets = np.concatenate([[0], np.cumsum(found.n[which])]).astype(np.int32)
                hashes = window_hashes(found, which, _KIND) if len(which) else np.zeros(0, np.int64)
                rows = pa.array(found.row[which])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(rows),
                        part.column("print").take(rows),
                        pa.array(found.seed[which]),
                        pa.array(first.astype(bool)),
                        pa.array(found.start[which].astype(np.int32)),
                        pa.array(found.gap[which].astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes)),
                    ],
                    ["id", "print", "seed", "is_first", "start", "gap", "hashes"],
                )

    return docs.mapInArrow(run, "id long, print long, seed long, is_first boolean, start int, gap int, hashes array<long>")


def _factors(met: DataFrame) -> DataFrame:
    """Compare open blocks with the reference block of their seed, aligned at the seed.

    Windows that agree are a factor: one row (id, print, start, n) where the reference
    stands in a smaller document. A window over the border of the factor, or one that
    differs, is given with its hash, to be looked for elsewhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.diff(batch.column("hashes").offsets.to_numpy()).astype(np.int64)
            m = np.diff(batch.column("ref_hashes").offsets.to_numpy()).astype(np.int64)
            mine = batch.column("hashes").flatten().to_numpy()
            theirs = batch.column("ref_hashes").flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), n)
            nth = np.arange(len(mine)) - np.repeat(np.cumsum(n) - n, n)
            shift = batch.column("ref_gap").to_numpy().astype(np.int64) - batch.column("gap").to_numpy()
            other = nth + shift[row]
            inside = (other >= 0) & (other < m[row])
            at = np.where(inside, (np.cumsum(m) - m)[row] + other, 0)
            agree = inside & (theirs[at] == mine) if len(theirs) else inside
            smaller = batch.column("ref_id").to_numpy() < batch.column("id").to_numpy()
            start = batch.column("start").to_numpy().astype(np.int64)[row] + nth
            edge = np.ones(len(mine) + 1, bool)
            edge[1:-1] = (agree[1:] != agree[:-1]) | (row[1:] != row[:-1])
            begin = np.flatnonzero(edge)[:-1]
            size = np.diff(np.flatnonzero(edge))
            use = agree[begin] & smaller[row[begin]] if len(begin) else np.zeros(0, bool)
            begin, size = begin[use], size[use]
            rest = np.flatnonzero(~agree)
            rows = pa.array(np.concatenate([row[begin], row[rest]]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(rows),
                    batch.column("print").take(rows),
                    batch.column("seed").take(rows),
                    pa.array(np.concatenate([start[begin], start[rest]]).astype(np.int32)),
                    pa.array(np.concatenate([size, np.ones(len(rest), np.int64)]).astype(np.int32)),
                    pa.concat_arrays([pa.nulls(len(begin), pa.int64()), pa.array(mine[rest])]),
                ],
                ["id", "print", "seed", "start", "n", "hash"],
            )

    return met.mapInArrow(run, "id long, print long, seed long, start int, n int, hash long")


def duplicate_windows(docs: DataFrame) -> DataFrame:
    """(id, print, start, n): runs of windows whose words also start in a document of smaller id.

    ``docs`` has (id: not null, print, text). The first block of a seed, in the order of
    ids, is its reference. A block equal to it as a whole is one factor. The others are
    compared window by window; what the factors leave over at their borders is looked up
    by hash among all windows that were left over.
    """
    table = repeated_blocks(block_table(docs, _KIND), across=True)
    whole = table.filter("same and id > first_id").select("id", "print", "start", "n")
    blocks = durable(_open_blocks(with_blocks(docs, table.filter("open and (is_first or not same)"), "start", "places", "is_first")))
    refs = durable(
        blocks.filter("is_first")
        .groupBy("seed")
        .agg(F.min(F.struct("id", "gap", "hashes")).alias("ref"))
        .select("seed", F.col("ref.id").alias("ref_id"), F.col("ref.gap").alias("ref_gap"), F.col("ref.hashes").alias("ref_hashes"))
    )
    others = blocks.filter("not is_first").join(refs, "seed")
    found = durable(_factors(others.select("id", "print", "seed", "start", "gap", "hashes", "ref_id", "ref_gap", "ref_hashes")))
    rest = found.filter("hash is not null")
    least = durable(rest.groupBy("seed", "hash").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most"))
    elsewhere = rest.join(least, ["seed", "hash"]).filter("id > least").select("id", "print", "start", "n")
    return whole.unionByName(found.filter("hash is null").select("id", "print", "start", "n")).unionByName(elsewhere)


def _joined(words: Words, keep: np.ndarray) -> pa.Array:
    """For each row its kept words, joined by one space."""
    which = np.flatnonzero(keep)
    size = words.end[which] - words.start[which] + 1  # with the space after it
    out = np.cumsum(size)
    at = np.arange(out[-1] if len(out) else 0) + np.repeat(words.start[which] - (out - size), size)
    flat = np.append(words.data, np.uint8(32))[at]
    flat[out - 1] = 32
    # The last word of a row has no space after it.
    row = words.row[which]
    last = np.ones(len(which), bool)
    last[:-1] = row[1:] != row[:-1]
    stay = np.ones(len(flat), bool)
    stay[out[last] - 1] = False
    sizes = np.bincount(row, size - last, len(words.first) - 1).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(flat[stay]))


def _remove(found: DataFrame) -> DataFrame:
    """``found`` (document, runs) with the covered words taken out."""
    added = T.StructType.fromDDL("n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "document.text"):
                at = find_words(*text_buffer(column_at(part, "document.text")), NOT_BLANK)
                gone = covered(part.column("runs"), at.first, WINDOW)
                columns = [pa.array(np.diff(at.first)), pa.array(counted(gone, at.first)), spans(gone, at.first), _joined(at, ~gone)]
                yield pa.RecordBatch.from_arrays([part.column("document"), *columns], ["document", *added.names])

    return found.mapInArrow(run, T.StructType([T.StructField("document", found.schema["document"].dataType), *added.fields]))


def substring_dedup(docs: DataFrame) -> DataFrame:
    """Remove the words under a window of WINDOW words that also starts in a smaller doc_id.

    Returns (document, n_words, n_removed, spans, kept) for every row of ``docs`` (doc_id,
    text, ...): ``document`` is the input row as a struct, so columns of any name pass
    through; ``spans`` are the removed word ranges, ``kept`` the other words joined by one
    space. Windows are judged on the input. A null or empty text has no words. A null
    doc_id is neither smaller nor larger: such a row stays whole and removes nothing.
    Rows of one doc_id do not remove from one another, and equal ones get equal results.
    A task works through a megabyte of text at once, or through one longer text.
    """
    whole = docs.select(F.struct("*").alias("document"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("print"))
    texts = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("print"), "text")
    return _remove(runs_by_document(whole, duplicate_windows(texts)))
