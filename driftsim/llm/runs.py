"""Periodic runs of words, by the branching tandem test on an enhanced suffix array."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from driftsim.llm.text import NOT_BLANK, Words, column_at, find_words, slices, text_buffer, word_hashes

#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_TIMES = 6, 4
#: Suffixes tested at once.
TESTED = 1 << 20


@dataclass
class SuffixArray:
    """Suffixes of the documents of a slice; those of different documents share nothing.

    ``order``: suffixes in sorted order, ``place``: their places in it, ``lcp[p]``: words
    shared by the suffixes at places p - 1 and p (-1 at both ends). ``same[m]`` numbers
    the strings of 2**m words: equal at two places if and only if the words are.
    """

    order: np.ndarray
    place: np.ndarray
    lcp: np.ndarray
    same: list[np.ndarray]
    begin: np.ndarray
    end: np.ndarray


def suffix_array(words: np.ndarray, first: np.ndarray) -> SuffixArray:
    """The suffix array of ``words`` (any numbers); document r has those from first[r] to first[r + 1].

    Ties are sorted again by the doubled number of words until none is left.
    """
    n = len(words)
    sizes = np.diff(first)
    begin, end = np.repeat(first[:-1], sizes), np.repeat(first[1:], sizes)
    _, ids = np.unique(words, return_inverse=True)
    key = np.repeat(np.arange(len(sizes)), sizes) * (int(ids.max(initial=0)) + 1) + ids
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(n + 1, bool)
    new[1:n] = key[1:] != key[:-1]
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new[:n], np.arange(n), 0))
    same, width = [rank], 1
    # Where suffixes share their first word, and where they are tied so far.
    shared = np.flatnonzero(~new[:n])
    while True:
        at = np.flatnonzero(~new[:n] | ~new[1:])
        if not len(at):
            break
        tied = order[at]
        behind = tied + width
        inside = behind < end[tied]
        key = rank[tied].astype(np.int64) * (n + 1)
        key[inside] += rank[behind[inside]] + 1
        again = np.argsort(key, kind="stable")
        key = key[again]
        order[at] = tied[again]
        new[at[1:]] |= key[1:] != key[:-1]
        rank = rank.copy()
        rank[order[at]] = np.maximum.accumulate(np.where(new[at], at, 0))
        same.append(rank)
        width *= 2
    place = np.empty(n, np.int32)
    place[order] = np.arange(n)
    lcp = np.zeros(n + 1, np.int32)
    lcp[[0, n]] = -1
    a, b = order[shared - 1], order[shared]
    total = np.zeros(len(shared), np.int32)
    for m in range(len(same) - 1, -1, -1):
        x, y = a + total, b + total
        inside = np.flatnonzero((x < end[a]) & (y < end[b]))
        equal = inside[same[m][x[inside]] == same[m][y[inside]]]
        total[equal] += 1 << m
    lcp[shared] = total
    return SuffixArray(order, place, lcp, same, begin, end)


def _intervals(lcp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place p of ``at`` the interval of places around it that share lcp[p] words.

    Returned as (lo, hi): the suffixes at lo to p - 1 are those before it whose
    neighbours share more than lcp[p], the suffixes at p to hi - 1 those behind it whose
    neighbours share no less. So each pair of suffixes is parted at exactly one place.
    """
    d, tables = lcp[at], [lcp]
    bounds = np.flatnonzero(lcp <= 0)
    widest = int(np.diff(bounds).max(initial=1))
    while 2 << (len(tables) - 1) <= widest:
        last, step = tables[-1], 1 << (len(tables) - 1)
        tables.append(np.minimum(last[:-step], last[step:]))
    lo, hi = at.copy(), at + 1
    for m in range(len(tables) - 1, -1, -1):
        step, table = 1 << m, tables[m]
        back = lo - step
        ok = back >= 0
        ok[ok] = table[back[ok]] > d[ok]
        lo[ok] = back[ok]
        ok = hi < len(table)
        ok[ok] = table[hi[ok]] >= d[ok]
        hi[ok] += step
    return lo - 1, hi


def branching_tandems(found: SuffixArray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of every square that its next word does not carry on.

    The two halves of such a square are suffixes that share exactly its period, so they
    lie on the two sides of one place of their interval. Only the smaller side is looked
    at: for a suffix i of it the suffixes i + depth and i - depth are sought on the other.
    """
    at = np.flatnonzero(found.lcp > 0)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lo, hi = _intervals(found.lcp, at)
    left = at - lo <= hi - at
    start, size = np.where(left, lo, at), np.where(left, at - lo, hi - at)
    other_lo, other_hi = np.where(left, at, lo), np.where(left, hi, at)
    total = np.cumsum(size)
    starts, periods = [], []
    done = 0
    while done < len(at):
        upto = max(done + 1, int(np.searchsorted(total, total[done] - size[done] + TESTED, "right")))
        part = slice(done, upto)
        of = np.repeat(np.arange(done, upto), size[part])
        nth = np.arange(len(of)) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
        i = found.order[start[of] + nth]
        depth = found.lcp[at[of]].astype(np.int64)
        for step in (depth, -depth):
            j = i + step
            ok = np.flatnonzero((j >= found.begin[i]) & (j < found.end[i]))
            place = found.place[j[ok]]
            ok = ok[(place >= other_lo[of[ok]]) & (place < other_hi[of[ok]])]
            starts.append(np.minimum(i[ok], j[ok]))
            periods.append(depth[ok])
        done = upto
    return np.concatenate(starts), np.concatenate(periods)


def periodic_runs(words: np.ndarray, first: np.ndarray, least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of every run of ``times`` periods and ``least`` words, in order.

    Each branching square is the last one of its run: it is turned back word by word
    (2**m words at a time) as far as its words go on. Squares of a multiple of the
    smallest period end up with the same borders and give way to it.
    """
    found = suffix_array(words, first)
    start, period = branching_tandems(found)
    end, begin = start + 2 * period, found.begin[start]
    for m in range(len(found.same) - 1, -1, -1):
        back = start - (1 << m)
        ok = np.flatnonzero(back >= begin)
        same = found.same[m]
        ok = ok[same[back[ok]] == same[back[ok] + period[ok]]]
        start[ok] = back[ok]
    enough = end - start >= np.maximum(least, times * period)
    start, end, period = start[enough], end[enough], period[enough]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    one = np.ones(len(start), bool)
    one[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[one], end[one], period[one]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _joined(words: Words, kept: np.ndarray) -> pa.Array:
    """The kept words of each row, with one space between two."""
    which = np.flatnonzero(kept)
    row = words.row[which]
    rows = len(words.first) - 1
    last = np.ones(len(which), bool)
    last[:-1] = row[1:] != row[:-1]
    size = words.end[which] - words.start[which]
    room = size + ~last
    at = np.cumsum(room) - room
    out = np.full(int(room.sum()), 32, np.uint8)
    from_ = np.repeat(words.start[which] - np.cumsum(size) + size, size) + np.arange(size.sum())
    into = np.repeat(at - np.cumsum(size) + size, size) + np.arange(size.sum())
    out[into] = words.data[from_]
    offsets = np.append(0, np.cumsum(np.bincount(row, room, rows).astype(np.int64)))
    return pa.LargeStringArray.from_buffers(rows, pa.py_buffer(offsets), pa.py_buffer(out)).cast(pa.string())


def collapse_runs(docs: DataFrame) -> DataFrame:
    """Find the periodic runs of words of every row of ``docs`` (text, ...) and cut them to one period.

    Returns (document, n_words, runs, collapsed): ``document`` is the input row as a
    struct, so columns of any name pass through. Words are runs of characters other than
    blank and the controls 9 to 13. A run is a stretch with smallest period q, of at least
    LEAST_WORDS words and LEAST_TIMES periods, that no neighbouring word carries on;
    ``runs`` has (start, length, period) by start, then period. Words that stand behind
    the first period of any run go; ``collapsed`` has the others, one space between two.
    A null or empty text has no words and no runs. Repeated rows are worked out each, ties
    cannot arise, an empty table gives an empty one. Words are compared by 64-bit hashes.
    Rows stay where they are: nothing is shuffled. A task works through a megabyte of text
    at once, or through one longer text, with memory of some 200 bytes a word.
    """
    added = T.StructType.fromDDL("n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    docs = docs.select(F.struct("*").alias("document"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "document.text"):
                words = find_words(*text_buffer(column_at(part, "document.text")), NOT_BLANK)
                first = words.first
                start, end, period = periodic_runs(word_hashes(words), first)
                row = words.row[start]
                edge = np.bincount(start + period, minlength=first[-1] + 1) - np.bincount(end, minlength=first[-1] + 1)
                kept = np.cumsum(edge[:-1]) == 0
                fields = [pa.array(start - first[row]), pa.array(end - start), pa.array(period)]
                offsets = np.searchsorted(row, np.arange(len(first))).astype(np.int32)
                runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, names=["start", "length", "period"]))
                columns = [part.column("document"), pa.array(np.diff(first)), runs, _joined(words, kept)]
                yield pa.RecordBatch.from_arrays(columns, ["document", *added.names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added.fields]))
