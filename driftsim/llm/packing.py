"""Best-fit packing of documents into sequences, planned on the histogram of lengths."""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from driftsim.llm.text import column_at, slices, text_buffer, trimmed
from driftsim.session import durable

SEQUENCE = 2048
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
_BLANKS = np.zeros(256, bool)
_BLANKS[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(maxsize=2)
def _whole(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _plain(path: str) -> tiktoken.Encoding | None:
    """A faster form of the tokenizer, for texts without runs of blanks.

    It holds the same merges as ranks. Its split pattern leaves out the rule for blanks
    that more blanks follow, which no such text needs; without that rule the pattern has
    no look-ahead and runs in linear time.
    """
    if not path.endswith(TOKENIZER):
        return None
    to_byte = {c: b for b, c in _byte_letters().items()}
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    ranks = {bytes(to_byte[c] for c in piece): rank for piece, rank in vocabulary.items() if piece != "<|endoftext|>"}
    pattern = public_tokenizers.PATTERN.replace(r"|\s+(?!\S)", "")
    return tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if printable, else the next from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _needs_whole(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows that may hold two blanks in a row, a blank beyond ASCII, or a special token."""
    odd = np.zeros(len(data) + 1, np.int64)
    if len(data):
        blank = _BLANKS[data]
        mark = (data == 0xE1) | (data == 0xE2) | (data == 0xE3)
        mark[:-1] |= blank[:-1] & blank[1:]
        mark[:-1] |= (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))
        mark[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
        np.cumsum(mark, out=odd[1:])
    return odd[ends] > odd[starts]


_PIECE = ["doc_id", "piece", "start", "length", "ids_crc32"]
_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, length: int = SEQUENCE, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document of ``docs`` (doc_id, text).

    A document is its token ids and one END_ID; a null text is empty. Only a document of
    more than ``length`` ids is cut; its first piece takes what full pieces leave over.
    """
    return _numbered_pieces(docs, length, tokenizer).select(*_PIECE)


def _numbered_pieces(docs: DataFrame, length: int, tokenizer: str) -> DataFrame:
    """``pieces`` with the task that made a piece, and its number among the task's of that length."""
    place = public_tokenizers.path(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, task, met = _plain(place), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                texts = column_at(part, "text")
                slow = _needs_whole(*text_buffer(texts))
                rows: list[tuple] = []
                for doc_id, text, full in zip(part.column("doc_id").to_pylist(), texts.to_pylist(), slow.tolist(), strict=True):
                    if full or plain is None:
                        found = _whole(place).encode(text or "", add_special_tokens=False).ids
                    else:
                        found = plain.encode_ordinary(text or "")
                    found.append(END_ID)
                    ids = np.array(found, dtype="<u4")
                    first = len(ids) % length or length if len(ids) > length else len(ids)
                    cuts = [0, *range(first, len(ids) + 1, length)]
                    for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        rows.append((doc_id, n, a, b - a, zlib.crc32(ids[a:b].tobytes()), task, met[b - a]))
                        met[b - a] += 1
                columns = list(zip(*rows, strict=True)) or [[]] * 7
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*_PIECE, "task", "nth"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(run), f"{_SCHEMA}, task int, nth long")


def plan(counts: dict[int, int], capacity: int = SEQUENCE) -> list[tuple[int, int, int, int]]:
    """Best fit over counts: (length, first rank, first sequence, offset) of every range of slots.

    Longest first; each length goes to the sequences with the least room that still holds
    it, as many at once as there are. Sequences filled alike are one group, and a step
    either uses up a length or a whole group, so there are at most two groups per length
    and the plan does not grow with the number of documents.
    """
    room: list[int] = []  # the sizes of room there are, ascending
    groups: dict[int, list[tuple[int, int]]] = {}  # room: (first sequence, how many)
    slots, opened = [], 0

    def add(left: int, first: int, n: int) -> None:
        if left > 0 and n > 0:
            if left not in groups:
                insort(room, left)
                groups[left] = []
            groups[left].append((first, n))

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            at = bisect_left(room, size)
            if at < len(room):
                space = room[at]
                first, n = groups[space].pop()
                if not groups[space]:
                    del groups[space]
                    room.pop(at)
            else:
                # As many new sequences as this length fills alone.
                space, first, n = capacity, opened, -(-left // (capacity // size))
                opened += n
            used = min(n, left)
            slots.append((size, rank, first, capacity - space))
            add(space, first + used, n - used)
            add(space - size, first, used)
            rank, left = rank + used, left - used
    return slots


def ranked(found: DataFrame) -> DataFrame:
    """``found`` with ``rank``, from 0 without gaps within each length.

    The task that read a document numbered its pieces of each length; the counts of the
    tasks before are added. A frequent length is a row per task, and no group of pieces.
    """
    sizes = found.groupBy("length", "task").agg((F.max("nth") + 1).alias("n"))
    ahead = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "task", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    return found.join(starts, ["length", "task"]).withColumn("rank", F.col("ahead") + F.col("nth")).drop("task", "nth", "ahead")


def pack(docs: DataFrame, length: int = SEQUENCE, tokenizer: str = TOKENIZER) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of at most ``length`` tokens.

    Returns ``pieces`` with sequence_id and offset. Only the histogram of lengths (at most
    ``length`` rows) comes to the driver and only its plan goes back; each piece finds its
    slot by its rank within its length. An empty table gives no rows. Repeated rows and
    null doc_ids are documents like any other. Other columns are not used. A very long text
    is tokenised by itself, and its pieces are rows of their own from then on.
    """
    found = durable(_numbered_pieces(docs, length, tokenizer))
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = sorted(plan(counts, length))
    lengths, ranks, firsts, offsets = (np.array(x, np.int64) for x in zip(*slots, strict=True)) if slots else (np.zeros(0, np.int64),) * 4
    order = (lengths << 44) | ranks

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(order, (size << 44) | rank, "right") - 1
            kept = [c for c in batch.schema.names if c != "rank"]
            new = [pa.array(firsts[at] + rank - ranks[at]), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new], [*kept, "sequence_id", "offset"])

    columns = ranked(found).select(*_PIECE, "rank")
    return columns.mapInArrow(trimmed(place), f"{_SCHEMA}, sequence_id long, offset long")
