"""Benchmark passages in documents, found through an FM-index of every shard of text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from driftsim.llm.text import ALNUM, LOWER, Words, column_at, find_words, slices, text_buffer, trimmed, word_hashes
from driftsim.session import durable

WINDOW = 13
#: Every so many places of a shard keep their suffix position.
SAMPLE = 8
#: Text bytes of one shard, and items and bytes of the benchmark that one pass carries.
SHARD_BYTES, BLOCK_ITEMS, BLOCK_BYTES = 4 << 20, 50_000, 16 << 20
#: Passes over the documents after which what they found is written.
WRITTEN = 4


class WaveletMatrix:
    """Ranks of symbols: how many of them stand before a place."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels = []
        for level in range(max(1, int(top).bit_length()) - 1, -1, -1):
            one = ((symbols >> level) & 1).astype(bool)
            zeros = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(~one, out=zeros[1:], dtype=np.int32)
            self.levels.append((level, zeros))
            symbols = np.concatenate([symbols[~one], symbols[one]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        low, high = np.zeros_like(place), place
        for level, zeros in self.levels:
            one = ((symbol >> level) & 1).astype(bool)
            n = zeros[-1]
            low = np.where(one, n + low - zeros[low], zeros[low])
            high = np.where(one, n + high - zeros[high], zeros[high])
        return high - low


class FMIndex:
    """Index of runs of symbols (1 to top); a 0 stands before each run and at the end.

    Each 0 counts as a symbol of its own, so the suffixes are compared within their run
    only. Kept are the wavelet ranks of the last column, the first places of the symbols,
    and the positions of every SAMPLE-th symbol and of each run's first.
    """

    def __init__(self, symbols: np.ndarray, top: int):
        n = len(symbols)
        stops = np.flatnonzero(symbols == 0)
        rank = symbols + len(stops) - 1
        rank[stops] = np.arange(len(stops))
        reach, order = 1, None
        while True:
            after = np.zeros(n, np.int64)
            after[: n - reach] = rank[reach:] + 1
            key = rank * (int(rank.max()) + 2) + after
            order = np.argsort(key, kind="stable")
            found = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], found[1:] != found[:-1]]))
            if rank[order[-1]] == n - 1:
                break
            reach *= 2
        self.last = symbols[order - 1]
        self.ranks = WaveletMatrix(self.last, top)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top + 1))])
        kept = (order % SAMPLE == 0) | (symbols[order - 1] == 0) | (order == 0)
        self.position = np.where(kept, order, -1)

    def _before(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        return self.first[symbol] + self.ranks.rank(symbol, place)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each phrase (one per row, equal lengths)."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), len(self.last))
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[live, k]
            low[live], high[live] = self._before(symbol, low[live]), self._before(symbol, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes, by stepping back to the nearest kept one."""
        out, steps = np.zeros(len(rows), np.int64), 0
        at, which = rows, np.arange(len(rows))
        while len(at):
            known = self.position[at] >= 0
            out[which[known]] = self.position[at[known]] + steps
            at, which = at[~known], which[~known]
            at = self._before(self.last[at], at)
            steps += 1
        return out


@dataclass
class Phrases:
    """Windows of a block of items: by length, their symbols and numbers; and whose they are."""

    vocabulary: np.ndarray
    by_length: dict[int, tuple[np.ndarray, np.ndarray]]
    items: list[str]
    owner_of: np.ndarray  # windows and items, as pairs sorted by window
    owner: np.ndarray


def words_of(column: pa.Array) -> Words:
    data, starts, ends = text_buffer(column)
    return find_words(LOWER[data], starts, ends, ALNUM)


def phrases(items: list[str], texts: list[str], window: int = WINDOW) -> Phrases | None:
    words = words_of(pa.array(texts, pa.string()))
    if not len(words.start):
        return None
    hashes = word_hashes(words)
    vocabulary = np.unique(hashes)
    symbols = np.searchsorted(vocabulary, hashes) + 1
    names = sorted(set(items))
    number = {name: k for k, name in enumerate(names)}
    found: dict[tuple, set[int]] = {}
    for r, item in enumerate(items):
        row = symbols[words.first[r] : words.first[r + 1]].tolist()
        for k in range(max(1, len(row) - window + 1) if row else 0):
            found.setdefault(tuple(row[k : k + window]), set()).add(number[item])
    by_length: dict[int, tuple[list, list]] = {}
    pairs = []
    for k, (phrase, owners) in enumerate(found.items()):
        rows, ids = by_length.setdefault(len(phrase), ([], []))
        rows.append(phrase)
        ids.append(k)
        pairs += [(k, o) for o in sorted(owners)]
    split = np.array(pairs)
    return Phrases(vocabulary, {m: (np.array(a), np.array(b)) for m, (a, b) in by_length.items()}, names, split[:, 0], split[:, 1])


def occurrences(words: Words, wanted: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, length, phrase) of every occurrence of a phrase in a shard.

    Words outside the phrases' vocabulary cannot be in one, nor can a run of known words
    that is shorter than the shortest phrase; the index is built on the other runs.
    """
    none = np.zeros(0, np.int64)
    if not len(words.start):
        return none, none, none
    hashes = word_hashes(words)
    at = np.searchsorted(wanted.vocabulary, hashes)
    at[at == len(wanted.vocabulary)] = 0
    known = wanted.vocabulary[at] == hashes
    edge = np.ones(len(known) + 1, bool)
    edge[1:-1] = (known[1:] != known[:-1]) | (words.row[1:] != words.row[:-1])
    edges = np.flatnonzero(edge)
    begin, size = edges[:-1], np.diff(edges)
    use = known[begin] & (size >= min(wanted.by_length))
    begin, size = begin[use], size[use]
    if not len(begin):
        return none, none, none
    # 0, run, 0, run, ..., 0; origin: the word of each symbol.
    place = np.cumsum(size + 1) - size
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    symbols = np.zeros(int(size.sum()) + len(size) + 1, np.int64)
    origin = np.zeros_like(symbols)
    target = np.repeat(place, size) + inner
    origin[target] = np.repeat(begin, size) + inner
    symbols[target] = at[origin[target]] + 1
    index = FMIndex(symbols, len(wanted.vocabulary))
    starts, lengths, which = [none], [none], [none]
    for m, (rows, ids) in wanted.by_length.items():
        low, high = index.search(rows)
        n = high - low
        flat = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        starts.append(origin[index.locate(flat)])
        lengths.append(np.full(len(flat), m))
        which.append(np.repeat(ids, n))
    return np.concatenate(starts), np.concatenate(lengths), np.concatenate(which)


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _add_block(found: DataFrame, wanted: Phrases) -> DataFrame:
    """``found`` with the spans and items of one block of phrases merged into its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "document.text", SHARD_BYTES):
                words = words_of(column_at(part, "document.text"))
                start, length, phrase = occurrences(words, wanted)
                cover = np.zeros(len(words.start) + 1, np.int64)
                np.add.at(cover, start, 1)
                np.add.at(cover, start + length, -1)
                earlier = part.column("spans").to_pylist()
                for r, spans in enumerate(earlier):
                    for s in spans:
                        cover[words.first[r] + s["start"]] += 1
                        cover[words.first[r] + s["end"]] -= 1
                hit = np.zeros(len(words.start) + 2, bool)
                hit[1:-1] = np.cumsum(cover[:-1]) > 0
                new_row = np.ones(len(words.start) + 1, bool)
                new_row[1:-1] = words.row[1:] != words.row[:-1]
                begin = np.flatnonzero(hit[1:-1] & (~hit[:-2] | new_row[:-1]))
                end = np.flatnonzero(hit[1:-1] & (~hit[2:] | new_row[1:])) + 1
                row = words.row[begin]
                begin, end = begin - words.first[row], end - words.first[row]
                spans = pa.StructArray.from_arrays([pa.array(begin), pa.array(end)], names=["start", "end"])
                bounds = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                # Items of each row: its phrases without repeats, then their owners.
                pair = np.unique(np.stack([words.row[start], phrase], axis=1), axis=0) if len(start) else np.zeros((0, 2), np.int64)
                lo = np.searchsorted(wanted.owner_of, pair[:, 1], "left")
                n = np.searchsorted(wanted.owner_of, pair[:, 1], "right") - lo
                owner = wanted.owner[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                owned: list[set] = [set(x) for x in part.column("items").to_pylist()]
                for r, o in {*zip(np.repeat(pair[:, 0], n).tolist(), owner.tolist(), strict=True)}:
                    owned[r].add(wanted.items[o])
                columns = {
                    "n_words": pa.array(np.diff(words.first)),
                    "spans": pa.ListArray.from_arrays(pa.array(bounds), spans),
                    "items": pa.array([sorted(x) for x in owned], pa.list_(pa.string())),
                }
                yield pa.RecordBatch.from_arrays([part.column("document"), *columns.values()], ["document", *columns])

    return found.mapInArrow(trimmed(run), T.StructType([T.StructField(f.name, f.dataType) for f in found.schema.fields]))


def benchmark_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(document, n_words, spans, items) for every row of ``docs`` (text, ...).

    ``benchmark`` (item_id, text) is the stated query set. It is carried to the documents
    in blocks of at most about BLOCK_ITEMS items and BLOCK_BYTES bytes, one pass over the
    documents each; there is no shuffle. A window is WINDOW words of an item, or the whole
    of a shorter one. ``spans`` are the word ranges [start, end) under an occurrence of a
    window, overlapping ones merged; neighbours that only touch are one span as well.
    ``items`` are the item_ids, as sorted text, that have an occurring window: rows of one
    item_id count as one item, a null item_id as the item ''. Null and empty texts have no
    words. ``document`` is the input row as a struct, so columns of any name pass through.
    Repeated rows get equal results. A very long text is a shard of its own, with memory in
    proportion to it. After every WRITTEN blocks the rows found so far are written, so that
    no plan carries all blocks of a large benchmark.
    """
    known = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").filter("text is not null")
    n, size = known.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = 1 + max(n // BLOCK_ITEMS, size // BLOCK_BYTES)
    found = docs.select(
        F.struct("*").alias("document"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast(_SPANS).alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    for block in range(blocks):
        rows = known.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).orderBy("item", "text").collect()
        wanted = phrases([r["item"] for r in rows], [r["text"] for r in rows])
        found = _add_block(found, wanted or Phrases(np.zeros(1, np.uint64), {1: (np.zeros((0, 1), np.int64), np.zeros(0, np.int64))}, [], np.zeros(0, np.int64), np.zeros(0, np.int64)))
        if (block + 1) % WRITTEN == 0 and block + 1 < blocks:
            found = durable(found)
    return found


def n_hit() -> Column:
    """Number of words under a span of ``benchmark_hits``."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def contaminated() -> Column:
    """The rule for a document of ``benchmark_hits``: a twentieth of its words or more is hit."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col("n_words"))
