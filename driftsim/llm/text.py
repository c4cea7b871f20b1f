"""Words of many documents at once, as byte positions in one numpy buffer.

The functions run inside Arrow tasks. A batch is worked through in slices of a few
megabytes of text, so memory does not follow the batch; one very long text is a slice of
its own.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
#: Bytes of words that are hashed at once; the steps of a hash take some fifty bytes for each.
HASH_BYTES = 1 << 18


def _byte_set(pattern: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(pattern)] = True
    return table


#: A word is a run of bytes other than blank and the controls 9 to 13.
NOT_BLANK = ~_byte_set(b" \t\n\v\f\r")
#: A word is a run of digits, small letters and bytes beyond ASCII (after lower-casing).
ALNUM = _byte_set(b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RANDOM = np.random.default_rng(20240229)
_BYTE_VALUES = _RANDOM.integers(0, 1 << 64, 256, dtype=np.uint64)
_BYTE_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ``limit`` text bytes, or of one row."""
    _, starts, ends = text_buffer(column_at(batch, column))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + limit, "right")))
        last = min(last, batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


def trimmed(run: Callable) -> Callable:
    """``run`` as a function of batches that gives freed memory back to the system when it ends.

    Python workers live on from task to task; without this the largest arrays of every
    stage so far would stay counted to them.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return work


def column_at(batch: pa.RecordBatch, path: str) -> pa.Array:
    """A column, or a field of a struct column by a path with dots."""
    column, *fields = path.split(".")
    found = batch.column(column)
    return pc.struct_field(found, fields) if fields else found


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a string or binary column, and where each row starts and ends (null: empty)."""
    binary = pa.types.is_binary(column.type)
    wide = column.fill_null(b"" if binary else "") if column.null_count else column
    wide = wide.cast(pa.large_binary() if binary else pa.large_string())
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = wide.buffers()[2]
    if data is None or not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(len(wide), np.int64), np.zeros(len(wide), np.int64)
    base = offsets[0]
    flat = np.frombuffer(data, np.uint8)[base : offsets[-1]]
    return flat, offsets[:-1] - base, offsets[1:] - base


@dataclass
class Words:
    """``data``: the bytes; word k is data[start[k]:end[k]] and lies in row row[k].

    The words of row r are those from first[r] to first[r + 1].
    """

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray


def find_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, is_word: np.ndarray) -> Words:
    inside = is_word[data]
    border = np.zeros(len(data) + 1, bool)
    border[starts] = True
    border[ends] = True
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    start = np.flatnonzero(inside & (~before | border[:-1]))
    end = np.flatnonzero(inside & (~after | border[1:])) + 1
    row = np.searchsorted(ends, start, "right")
    first = np.searchsorted(row, np.arange(len(starts) + 1))
    return Words(data, start, end, row, first)


def joined_by_space(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, is_word: np.ndarray) -> Words:
    """The same words over a buffer in which one space stands between neighbours."""
    inside = is_word[data]
    border = np.zeros(len(data) + 1, bool)
    border[starts] = True
    keep = inside.copy()
    keep[1:] |= inside[:-1] & ~border[1:-1]
    new = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=new[1:])
    flat = np.where(inside, data, np.uint8(32))[keep]
    return find_words(flat, new[starts], new[ends], is_word)


def powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i below n."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        # Kept for the next slice; those of one very long text go with it.
        if n <= 2 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """A 64-bit hash of values[start:end] for every pair, the same wherever they stand."""
    inverse = powers(pow(base, -1, 1 << 64), len(prefix))
    length = (end - start).astype(np.uint64)
    return mix((prefix[end] - prefix[start]) * inverse[start] + length)


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of every word, HASH_BYTES of text or one longer word at a time."""
    out = np.empty(len(words.start), np.uint64)
    first = 0
    while first < len(out):
        base = words.start[first]
        last = max(first + 1, int(np.searchsorted(words.end, base + HASH_BYTES, "right")))
        prefix = prefix_sums(_BYTE_VALUES[words.data[base : words.end[last - 1]]], _BYTE_BASE)
        out[first:last] = span_hashes(prefix, words.start[first:last] - base, words.end[first:last] - base, _BYTE_BASE)
        first = last
    return out


def byte_values(data: np.ndarray) -> np.ndarray:
    """A 64-bit value for each byte, to take prefix sums of."""
    return _BYTE_VALUES[data]


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values, the place of its smallest one, leftmost on ties.

    Takes minima of doubling widths; values are compared with their places.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    place, best, reach = np.arange(len(values)), values, 1
    while reach < width:
        step = min(reach, width - reach)
        left, right = best[: len(best) - step], best[step:]
        take = right < left
        best = np.where(take, right, left)
        place = np.where(take, place[step:], place[: len(place) - step])
        reach += step
    return place[:n]
