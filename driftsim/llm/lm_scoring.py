"""Marginal likelihood of texts under a unigram model of subword pieces."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from driftsim.llm.text import LOWER, NOT_BLANK, Words, find_words, slices, text_buffer, trimmed, word_hashes
from driftsim.session import durable

VOCABULARY = "piece_bpe_32k.model"
#: At most so many frequent words travel to every task, as a hash and two numbers each; the
#: others, and every word of more bytes than HEAD_BYTES, are joined.
HEAD_WORDS, HEAD_BYTES = 1 << 18, 32
#: Bytes of the words whose lattices are worked through at once.
LATTICE_BYTES = 1 << 17
_SPACE = "▁"
_NONE = -np.inf


@dataclass
class Pieces:
    """The pieces of a vocabulary as bytes; a blank at the front marks the start of a word.

    ``log_p`` are natural logs of their probabilities, from the vocabulary's own scores:
    these are ranks (0, -1, ...), read as frequencies by Zipf's law. Every single byte is
    a piece, so every word has a segmentation.
    """

    number: dict[bytes, int]
    log_p: np.ndarray
    longest: int


@lru_cache(maxsize=2)
def pieces(vocabulary: str = VOCABULARY) -> Pieces:
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(vocabulary))
    rank: dict[bytes, float] = {}
    low = max(-model.get_score(i) for i in range(model.get_piece_size()))
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            rank.setdefault(bytes([int(piece[1:-1], 16)]), low)
        elif not (model.is_control(i) or model.is_unknown(i)):
            text = piece.replace(_SPACE, " ").encode()
            if b" " not in text[1:]:
                rank[text] = min(rank.get(text, low), -model.get_score(i))
    weight = 1.0 / (10.0 + np.array(list(rank.values())))
    return Pieces({p: k for k, p in enumerate(rank)}, np.log(weight / weight.sum()), max(map(len, rank)))


@dataclass
class Lattices:
    """The segmentations of some words: word k has nodes base[k] to base[k] + size[k]."""

    size: np.ndarray
    base: np.ndarray
    #: By length m: the node at which a piece begins, and the piece's number.
    begin: dict[int, np.ndarray]
    piece: dict[int, np.ndarray]


def lattices(words: list[bytes], known: Pieces) -> Lattices:
    words = [b" " + w for w in words]
    size = np.array([len(w) for w in words], np.int64)
    base = np.cumsum(size + 1) - size - 1
    begin: dict[int, list[int]] = {}
    piece: dict[int, list[int]] = {}
    get, longest, prefixes = known.number.get, known.longest, _prefixes()
    for word, at in zip(words, base.tolist(), strict=True):
        n = len(word)
        for i in range(n):
            for j in range(i + 1, min(n, i + longest) + 1):
                part = word[i:j]
                if part not in prefixes:
                    break
                found = get(part)
                if found is not None:
                    begin.setdefault(j - i, []).append(at + i)
                    piece.setdefault(j - i, []).append(found)
    return Lattices(size, base, {m: np.array(x) for m, x in begin.items()}, {m: np.array(x) for m, x in piece.items()})


@lru_cache(maxsize=1)
def _prefixes() -> frozenset[bytes]:
    """All beginnings of pieces: a search stops where none goes on."""
    return frozenset(p[:k] for p in pieces().number for k in range(1, len(p) + 1))


def _log_sum(rows: list[np.ndarray]) -> np.ndarray:
    stack = np.stack(rows)
    top = np.maximum(stack.max(axis=0), -1e300)
    return top + np.log(np.exp(stack - top).sum(axis=0))


def forward(found: Lattices, log_p: np.ndarray, reverse: bool = False) -> np.ndarray:
    """For each node the log of the summed probability of all ways from the word's start to it.

    All words advance by one node at a time, longest first, so that the words still going
    are a prefix. ``reverse`` sums the ways from the node to the word's end.
    """
    total = int((found.size + 1).sum())
    weight = {}
    for m, begin in found.begin.items():
        table = np.full(total, _NONE)
        table[begin] = log_p[found.piece[m]]
        weight[m] = table
    order = np.argsort(-found.size, kind="stable")
    size, base = found.size[order], found.base[order]
    out = np.full(total, _NONE)
    out[base + size if reverse else base] = 0.0
    longest = int(size[0]) if len(size) else 0
    going = np.searchsorted(-size, -np.arange(longest + 1), "right")
    with np.errstate(divide="ignore"):
        for j in range(1, longest + 1):
            live = base[: going[j]]
            node = live + size[: going[j]] - j if reverse else live + j
            rows = []
            for m, table in weight.items():
                if m <= j:
                    other = node + m if reverse else node - m
                    rows.append(out[other] + table[node if reverse else other])
            out[node] = _log_sum(rows) if rows else _NONE
    return out


def word_log_p(words: list[bytes], log_p: np.ndarray, known: Pieces) -> np.ndarray:
    found = lattices(words, known)
    return forward(found, log_p)[found.base + found.size]


def expected_counts(words: list[bytes], times: np.ndarray, known: Pieces) -> np.ndarray:
    """How often each piece is used in all segmentations of the words, weighted by probability."""
    found = lattices(words, known)
    ahead, behind = forward(found, known.log_p), forward(found, known.log_p, reverse=True)
    owner = np.repeat(np.arange(len(words)), found.size + 1)
    whole = ahead[found.base + found.size]
    out = np.zeros(len(known.log_p))
    for m, begin in found.begin.items():
        piece = found.piece[m]
        share = np.exp(ahead[begin] + known.log_p[piece] + behind[begin + m] - whole[owner[begin]])
        out += np.bincount(piece, share * times[owner[begin]], len(out))
    return out


def words_of(column: pa.Array) -> Words:
    data, starts, ends = text_buffer(column)
    return find_words(LOWER[data], starts, ends, NOT_BLANK)


def fold() -> Column:
    """crc32 of the doc_id as text, modulo 7; rows of remainder 2 are held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7


def _held() -> Column:
    return F.coalesce(fold() == 2, F.lit(False))


def _spell(words: Words, which: np.ndarray) -> list[bytes]:
    raw = words.data.tobytes()
    return [raw[a:b] for a, b in zip(words.start[which].tolist(), words.end[which].tolist(), strict=True)]


def _hashes(words: pa.Array) -> np.ndarray:
    data, starts, ends = text_buffer(words)
    return word_hashes(Words(data, starts, ends, starts, starts))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word: binary, trained, total): occurrences in the rows learned from, and in all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                words = words_of(part.column("text"))
                held = part.column("held").to_numpy(zero_copy_only=False).astype(bool)[words.row]
                _, one, of = np.unique(word_hashes(words), return_index=True, return_inverse=True)
                total = np.bincount(of, minlength=len(one))
                trained = np.bincount(of[~held], minlength=len(one))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_spell(words, one), pa.binary()), pa.array(trained), pa.array(total)], ["word", "trained", "total"]
                )

    found = docs.select("text", _held().alias("held")).mapInArrow(trimmed(run), "word binary, trained long, total long")
    return found.groupBy("word").agg(F.sum("trained").alias("trained"), F.sum("total").alias("total"))


@dataclass
class Model:
    log_p: np.ndarray
    log_end: float


def fit(counts: DataFrame, ends: int, known: Pieces) -> Model:
    """One round of expectation over the lattices of all training words.

    Each word counts as often as it occurs; what comes back is a row per piece, bounded by
    the vocabulary. Expected counts are smoothed by the starting weights, one for each
    piece; the end of a text is a symbol of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = pieces(), np.zeros(len(known.log_p))
        for batch in batches:
            for part in slices(batch, "word", LATTICE_BYTES):
                total += expected_counts(part.column("word").to_pylist(), part.column("trained").to_numpy(), own)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["piece", "n"])

    rows = counts.filter("trained > 0").select("word", "trained").mapInArrow(trimmed(run), "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(len(known.log_p))
    for r in rows:
        n[r["piece"]] = r["n"]
    whole = n.sum() + len(n) + ends + 1
    return Model(np.log((n + len(n) * np.exp(known.log_p)) / whole), float(np.log((ends + 1) / whole)))


def score(docs: DataFrame) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text) by what its other rows teach.

    Returns (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score). Tokens
    are the words in lower case (A-Z only) and one end; a null or empty text is the end
    alone. ``base_score`` is the word model with one added to every count. ``score`` is
    log10 of the text's probability: a text is a row of pieces drawn independently and an
    end, each word begins with a piece that carries the blank, and the probability of a
    word is summed over all its segmentations. Each distinct word's lattice is worked out
    once. The most frequent words (at most HEAD_WORDS, of at most HEAD_BYTES bytes) are looked
    up inside the tasks that read the texts; all others are joined with the written
    weights, a row for each text that has the word, so that Spark can split one that many
    texts have. A very long text is worked through by itself; a word's lattice needs some
    hundred bytes for each of its bytes. Repeated rows
    are scored each; a null doc_id is learned from.
    """
    known = pieces()
    counts = durable(word_counts(docs))
    ends = docs.filter(~_held()).count()
    n, v = counts.filter("trained > 0").agg(F.coalesce(F.sum("trained"), F.lit(0)), F.count("*")).first()
    train_tokens, kinds = n + ends, v + (1 if ends else 0)
    model = fit(counts, ends, known)
    floor = float(np.log10(train_tokens + kinds + 1))
    to_log10 = float(np.log10(np.e))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces()
        for batch in batches:
            for part in slices(batch, "word", LATTICE_BYTES):
                value = word_log_p(part.column("word").to_pylist(), model.log_p, own) * to_log10
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(value), pa.array(_hashes(part.column("word")).view(np.int64))], [*part.schema.names, "log10_p", "hash"]
                )

    weighed = durable(counts.mapInArrow(trimmed(weigh), "word binary, trained long, total long, log10_p double, hash long"))
    short = F.octet_length("word") <= HEAD_BYTES
    # The least count of a head word: bands of counts, an eighth of a doubling wide.
    band = F.floor(F.log2("total") * 8).cast("int")
    bands = weighed.filter(short).groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.min("total").alias("least")).orderBy(F.desc("band")).collect()
    least, taken = 1 << 62, 0
    for r in bands:
        taken += r["n"]
        if taken > HEAD_WORDS:
            break
        least = r["least"]
    is_head = short & (F.col("total") >= least)
    head = weighed.filter(is_head).select("hash", "trained", "log10_p").toArrow()
    hashes = head.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    keys = np.append(hashes[order], np.uint64(0))
    trained = np.append(head.column("trained").to_numpy()[order], 0)
    log10_p = np.append(head.column("log10_p").to_numpy()[order], 0.0)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nth = TaskContext.get().partitionId() << 40, 0
        base = np.log10(trained + 1) - floor
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column("text"))
                found = word_hashes(words)
                at = np.searchsorted(keys[:-1], found)
                known = (keys[at] == found) & (words.end - words.start <= HEAD_BYTES) if len(keys) > 1 else np.zeros(len(found), bool)
                of, hit, rows = words.row[known], at[known], part.num_rows
                number = task + nth + np.arange(rows)
                nth += rows
                sums = [np.bincount(of, x[hit], rows).astype(float) for x in (trained > 0, base, log10_p)]
                # The rare words of each text, without repeats.
                rest = np.flatnonzero(~known)
                pair = np.stack([words.row[rest].astype(np.uint64), found[rest]])
                _, one, times = np.unique(pair, axis=1, return_index=True, return_counts=True)
                one = rest[one]
                key = [f" {x}".encode() for x in number.tolist()]  # no word: each text's own row
                lone = pa.nulls(len(one), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key + _spell(words, one), pa.binary()),
                        pa.array(np.concatenate([number, number[words.row[one]]])),
                        pa.concat_arrays([part.column("doc_id"), pa.nulls(len(one), pa.int64())]),
                        pa.concat_arrays([part.column("held"), pa.nulls(len(one), pa.bool_())]),
                        pa.array(np.concatenate([np.diff(words.first) + 1, times])),
                        pa.array(np.concatenate([sums[0], np.zeros(len(one))]).astype(np.int64)),
                        pa.concat_arrays([pa.array(sums[1]), lone]),
                        pa.concat_arrays([pa.array(sums[2]), lone]),
                    ],
                    ["word", "number", "doc_id", "held", "n", "n_known", "base", "log10_p"],
                )

    schema = "word binary, number long, doc_id long, held boolean, n long, n_known long, base double, log10_p double"
    rows = docs.select(F.col("doc_id").cast("long"), "text", _held().alias("held")).mapInArrow(trimmed(look_up), schema)
    rare = weighed.filter(~is_head).select("word", "trained", F.col("log10_p").alias("rare_p"))
    joined = rows.join(rare, "word", "left")
    own = F.col("held").isNotNull()
    end_base = np.log10((ends + 1)) - floor if ends else -floor
    return (
        joined.select(
            "number",
            "doc_id",
            "held",
            F.when(own, F.col("n")).alias("n_tokens"),
            F.when(own, F.col("n_known")).otherwise(F.when(F.col("trained") > 0, F.col("n")).otherwise(0)).alias("n_known"),
            F.when(own, F.col("base")).otherwise(F.col("n") * (F.log10(F.col("trained") + 1) - floor)).alias("base"),
            F.when(own, F.col("log10_p")).otherwise(F.col("n") * F.col("rare_p")).alias("log10_p"),
        )
        .groupBy("number")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("held").alias("held_out"),
            F.max("n_tokens").alias("n_tokens"),
            (F.sum("n_known") + (1 if ends else 0)).alias("n_known"),
            F.lit(train_tokens).cast("long").alias("train_tokens"),
            (F.sum("base") + float(end_base)).alias("base_score"),
            (F.sum("log10_p") + model.log_end * to_log10).alias("score"),
        )
        .drop("number")
    )
