"""Quality of texts: plain rules, and a likelihood ratio of hashed n-grams."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from driftsim.llm.text import NOT_BLANK, Words, column_at, find_words, mix, prefix_sums, slices, span_hashes, text_buffer, word_hashes
from driftsim.session import durable

#: Slots of the hashed n-grams; a model is so many counts, whatever the corpus holds.
SLOTS = 1 << 16
#: A text with fewer words fails, and one with over so many per cent of its words repeated.
LEAST_WORDS, MOST_REPEATED = 10, 20
WINDOW = 5
#: So many ids of labelled rows travel at once; more take further passes over the texts.
TRUSTED_ROWS = 2_000_000
#: One labelled row of so many sets the threshold; the others are learned from.
FOLDS = 4
#: This share of the trusted texts that set the threshold may fall below it.
BELOW = 0.01
#: Steps of a score in which the threshold is sought.
GRID = 1024

_CLASS = np.where(NOT_BLANK, np.uint8(2), np.uint8(0))
_CLASS[[c for c in range(256) if c >= 128 or chr(c).isalnum()]] = 1
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NOT_NEWLINE = np.arange(256) != 10
_BYTE_BASE, _WORD_BASE = 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F
_LEFT = np.uint64(0x9E3779B97F4A7C15)


def _tokens(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Words:
    """Runs of letters and digits, and runs of other marks."""
    kind = _CLASS[data]
    border = np.zeros(len(data) + 1, bool)
    border[starts] = True
    border[ends] = True
    change = border.copy()
    change[1:-1] |= kind[1:] != kind[:-1]
    start = np.flatnonzero(change[:-1] & (kind > 0))
    edges = np.append(np.flatnonzero(change), len(data))
    end = edges[np.searchsorted(edges, start, "right")] if len(start) else start
    row = np.searchsorted(ends, start, "right")
    return Words(data, start, end, row, np.searchsorted(row, np.arange(len(starts) + 1)))


def ngram_slots(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(slot, row, rows) of every token and every two neighbouring tokens of each text."""
    tokens = _tokens(*text_buffer(column))
    one = word_hashes(tokens)
    pair = tokens.row[1:] == tokens.row[:-1]
    two = mix(one[:-1][pair] * _LEFT + one[1:][pair])
    slot = (np.concatenate([one, two]) >> np.uint64(48)).astype(np.int64)
    return slot, np.concatenate([tokens.row, tokens.row[1:][pair]]), len(column)


def ngram_counts(docs: DataFrame) -> np.ndarray:
    """How often each slot is met in all texts (column ``text``): SLOTS numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                total += np.bincount(ngram_slots(part.column("text"))[0], minlength=SLOTS)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], ["slot", "n"])

    out = np.zeros(SLOTS, np.int64)
    for r in docs.select("text").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        out[r["slot"]] = r["n"]
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Per slot the log of its probability in the target over that in the raw corpus.

    The raw counts are smoothed by one for each slot, the target's by as much again, spread
    as in the raw corpus: a slot that neither tells about has ratio one.
    """
    p = (raw + 1) / (raw.sum() + len(raw))
    return np.log((target + len(raw) * p) / ((target.sum() + len(raw)) * p))


def mean_ratio(column: pa.Array, ratios: np.ndarray) -> np.ndarray:
    """Sum of the ratios over a text's n-grams, by their number; 0 for a text without any."""
    slot, row, rows = ngram_slots(column)
    total = np.bincount(row, ratios[slot], rows)
    return total / np.maximum(np.bincount(row, minlength=rows), 1)


def _per_row(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[ends] - total[starts]


def _first_of_equals(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of which different key each one is, and how many each has."""
    _, of, times = np.unique(keys, return_inverse=True, return_counts=True)
    return of, times


def plain_figures(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of the plain rules for each text."""
    data, starts, ends = text_buffer(column)
    words = find_words(data, starts, ends, NOT_BLANK)
    rows = len(starts)
    salt = mix(np.arange(rows, dtype=np.uint64) + np.uint64(1))
    in_words = NOT_BLANK[data]
    # Lines with a word that are not the first of their kind in the text.
    lines = find_words(data, starts, ends, _NOT_NEWLINE)
    full = np.flatnonzero(_per_row(in_words, lines.start, lines.end) > 0)
    prefix = prefix_sums(data.astype(np.uint64) + np.uint64(1), _BYTE_BASE)
    of_row = lines.row[full]
    hashes = span_hashes(prefix, lines.start[full], lines.end[full], _BYTE_BASE)
    _, one = np.unique(mix(hashes + salt[of_row]), return_index=True)
    n_dup_lines = np.bincount(of_row, minlength=rows) - np.bincount(of_row[one], minlength=rows)
    # Words under a window that is met twice in the text.
    n = len(words.start)
    begin = np.flatnonzero(words.row[: max(n - WINDOW + 1, 0)] == words.row[WINDOW - 1 :])
    prefix = prefix_sums(word_hashes(words), _WORD_BASE)
    windows = span_hashes(prefix, begin, begin + WINDOW, _WORD_BASE)
    of, times = _first_of_equals(mix(windows + salt[words.row[begin]]))
    again = begin[times[of] > 1]
    cover = np.bincount(again, minlength=n + 1) - np.bincount(again + WINDOW, minlength=n + 1)
    repeated = np.cumsum(cover[:n]) > 0
    return {
        "n_words": np.diff(words.first),
        "word_chars": _per_row(in_words & (data & 0xC0 != 0x80), starts, ends),
        "n_symbols": _per_row(_SYMBOL[data], starts, ends),
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": np.bincount(words.row[repeated], minlength=rows),
    }


def base_failed(figures: dict[str, np.ndarray]) -> np.ndarray:
    return (figures["n_words"] < LEAST_WORDS) | (100 * figures["n_repeat_words"] > MOST_REPEATED * figures["n_words"])


def threshold(trusted: list[DataFrame], ratios: np.ndarray) -> float:
    """The highest step of the grid that at most BELOW of the trusted texts (``text``) of all frames lie under.

    Texts that fail the plain rules have no say. Scores are counted by step, so the
    result is one number whatever way the rows are dealt; without rows it is -infinity.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                text = part.column("text")
                score = mean_ratio(text, ratios)[~base_failed(plain_figures(text))]
                step, n = np.unique(np.floor(score * GRID).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(step), pa.array(n)], ["step", "n"])

    # A ratio is within some 50 either way: the steps are bounded however many rows there are.
    steps = Counter()
    for part in trusted:
        for r in part.select("text").mapInArrow(run, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).collect():
            steps[r["step"]] += r["n"]
    room = int(BELOW * steps.total())
    for step, n in sorted(steps.items()):
        room -= n
        if room < 0:
            return step / GRID
    return -np.inf


def rate_quality(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """Rate every row of ``docs`` (doc_id, text, ...) by plain rules and by what trusted texts look like.

    Returns (document, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, ratio, kept): ``document`` is the input row as a struct, so columns of
    any name pass through. The n-grams of a text are its tokens and pairs of neighbouring
    tokens, hashed into SLOTS; two multinomials over the slots are counted, one over all
    of ``docs``, one over all documents named in ``trusted`` (doc_id). ``ratio`` is the
    text's log-likelihood under the second less that under the first, by its number of
    n-grams. ``kept``: the plain rules hold and the ratio reaches ``threshold``, which is
    set on the trusted documents whose crc32(doc_id as text) modulo FOLDS is 0; the
    others are learned from. The same text is always judged alike: nothing is drawn.

    A null or empty text has no words, so it fails. Repeated rows count and are rated
    each; a null doc_id is never trusted. Without trusted documents the ratio is 0 or
    less and all that hold the plain rules are kept. An empty table gives an empty one.
    Lines, windows and n-grams are compared by 64-bit hashes. A task works through a
    megabyte of text at once, or through one longer text.
    """
    ids = trusted.select(F.col("doc_id").cast("long").alias("trusted_id")).filter("trusted_id is not null").distinct()
    ids = durable(ids)
    parts = max(1, -(-ids.count() // TRUSTED_ROWS))
    part = F.pmod(F.xxhash64("trusted_id"), F.lit(parts))
    fold = F.crc32(F.col("trusted_id").cast("string").cast("binary")) % FOLDS
    texts = docs.select(F.col("doc_id").cast("long").alias("trusted_id"), "text").filter("text is not null")

    def of(which) -> list[DataFrame]:
        # About TRUSTED_ROWS ids travel for a pass, so no text is shuffled to find its label.
        return [texts.join(F.broadcast(ids.filter(which & (part == n))), "trusted_id", "left_semi") for n in range(parts)]

    ratios = log_ratios(sum(map(ngram_counts, of(fold != 0))), ngram_counts(texts))
    least = threshold(of(fold == 0), ratios)
    added = T.StructType.fromDDL(
        "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, kept boolean"
    )
    whole = docs.select(F.struct("*").alias("document"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "document.text"):
                text = column_at(part, "document.text")
                figures = plain_figures(text)
                failed, ratio = base_failed(figures), mean_ratio(text, ratios)
                columns = [*figures.values(), failed, ratio, ~failed & (ratio >= least)]
                yield pa.RecordBatch.from_arrays([part.column("document"), *map(pa.array, columns)], ["document", *added.names])

    return whole.mapInArrow(run, T.StructType([*whole.schema.fields, *added.fields]))
