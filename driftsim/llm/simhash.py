"""SimHash fingerprints, and near-duplicate groups found by pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from driftsim.llm.components import components
from driftsim.llm.text import LOWER, NOT_BLANK, column_at, joined_by_space, slices, text_buffer, trimmed
from driftsim.session import durable

SHINGLE = 4
DISTANCE = 4
#: Bits of the five segments on the ring, lowest first.
SEGMENTS = (13, 13, 13, 13, 12)


def _fingerprint_rows(texts: pa.Array, shingle: int) -> np.ndarray:
    data, starts, ends = text_buffer(texts)
    words = joined_by_space(LOWER[data], starts, ends, NOT_BLANK)
    raw, digest = words.data.tobytes(), xxhash.xxh64_intdigest
    out = np.zeros(len(starts), np.int64)
    for r in range(len(starts)):
        a, b = words.first[r], words.first[r + 1]
        if a == b:
            continue
        n = max(1, b - a - shingle + 1)
        begin, end = words.start[a : a + n].tolist(), words.end[b - n : b].tolist()
        hashes = np.array([digest(raw[i:j], 42) for i, j in zip(begin, end, strict=True)], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = bits.sum(axis=0, dtype=np.int64)
        out[r] = np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0]
    return out


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "print", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with the fingerprint of ``text`` (a column or a struct's field) in a long column ``name``: bit b is set if it is in over half of the shingle hashes.

    Shingles are ``shingle`` consecutive words in lower case (A-Z only), repeats included;
    fewer words make one shingle; a text without words, or a null text, has fingerprint 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                prints = pa.array(_fingerprint_rows(column_at(part, text), shingle))
                yield pa.RecordBatch.from_arrays([*part.columns, prints], [*part.schema.names, name])

    return docs.mapInArrow(trimmed(run), T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def _segment(place: int, at: str = "print") -> Column:
    """Segment ``place`` of the ring as a small number."""
    low, bits = sum(SEGMENTS[:place]), SEGMENTS[place]
    return F.shiftrightunsigned(at, low).bitwiseAND(F.lit((1 << bits) - 1))


def _chain_keys() -> Column:
    """Index keys of one fingerprint.

    A pair within the distance has a segment from which every chain of l segments holds at
    most 4 l / 5 differences. Its first segment is then equal, and the next two hold at
    most two differences, so of their four halves two are equal. A key is the number of
    the start and the halves, the first segment, and the two halves.
    """
    keys = []
    for start in range(len(SEGMENTS)):
        halves = []
        for place in ((start + 1) % 5, (start + 2) % 5):
            seg = _segment(place)
            halves += [seg.bitwiseAND(F.lit(63)), F.shiftright(seg, 6)]
        for n, (i, j) in enumerate(combinations(range(4), 2)):
            parts = F.shiftleft(_segment(start), 14) + F.shiftleft(halves[i], 7) + halves[j]
            keys.append(F.lit((start * 6 + n) << 32) + parts)
    return F.array(*keys)


def _chain_holds(key: Column, a: Column, b: Column) -> Column:
    """Whether every chain from the key's start keeps its budget."""
    diff = a.bitwiseXOR(b)
    start = F.floor(F.shiftright(key, 32) / 6)
    out = F.lit(False)
    for first in range(5):
        total, ok = F.lit(0), start == first
        for l in range(1, 6):
            place = (first + l - 1) % 5
            low, bits = sum(SEGMENTS[:place]), SEGMENTS[place]
            mask = ((1 << bits) - 1) << low
            total = total + F.bit_count(diff.bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask)))
            ok = ok & (total <= DISTANCE * l // 5)
        out = out | ok
    return out


def link_groups(prints: DataFrame) -> DataFrame:
    """(print, root) for the fingerprints of ``prints`` (print: long, distinct) that have a partner.

    First every fingerprint is compared with the smallest one under each of its keys; the
    links found give groups. Then all pairs under a key are compared that are not yet in
    one group, so that a large group of close fingerprints costs no row per pair, and no
    link between groups is lost. Both are joins on the key that Spark splits when skewed.
    """
    keyed = durable(prints.select("print", F.explode(_chain_keys()).alias("key")))
    # Written, so that the join is one of two plain tables, whose hot keys Spark can split.
    shared = durable(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("print").alias("least")).filter("n > 1").drop("n"))
    shared = durable(keyed.join(shared, "key"))
    star = shared.filter(
        (F.col("print") != F.col("least")) & (F.bit_count(F.col("print").bitwiseXOR(F.col("least"))) <= DISTANCE)
    ).select(F.col("print").alias("a"), F.col("least").alias("b"))
    groups = durable(components(star))
    rest = durable(
        shared.select("key", "print")
        .join(groups.withColumnRenamed("node", "print"), "print", "left")
        .select("key", "print", F.coalesce("root", "print").alias("root"))
    )
    # A key whose fingerprints are all in one group has no pair left to compare.
    open_keys = durable(rest.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key"))
    rest = rest.join(open_keys, "key", "left_semi")
    left, right = rest.alias("x"), rest.alias("y")
    a, b = F.col("x.print"), F.col("y.print")
    between = (
        left.join(
            right,
            (F.col("x.key") == F.col("y.key"))
            & (F.col("x.root") < F.col("y.root"))
            & _chain_holds(F.col("x.key"), a, b)
            & (F.bit_count(a.bitwiseXOR(b)) <= DISTANCE),
        )
        .select(F.col("x.root").alias("a"), F.col("y.root").alias("b"))
        .distinct()
    )
    merged = durable(components(between))
    return groups.select(F.col("node").alias("print"), "root").unionByName(
        merged.select(F.col("node").alias("print"), F.col("node").alias("root"))
    ).distinct().join(merged.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select(
        "print", F.coalesce("top", "root").alias("root")
    ).distinct()


def simhash_groups(prints: DataFrame) -> DataFrame:
    """(print, component_id, first_row) for each distinct fingerprint of ``prints`` (doc_id, print[, row]).

    component_id is the smallest doc_id among all documents reachable by links of at most
    4 differing bits (null if all of them are null). Fingerprints that are equal are one
    class, so copies are never paired; each class needs one row.
    """
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row") if "row" in prints.columns else F.struct(F.col("doc_id").isNull(), "doc_id")
    classes = durable(prints.groupBy("print").agg(F.min(order).alias("first")))
    groups = durable(link_groups(classes.select("print")))
    tops = classes.join(groups, "print").groupBy("root").agg(F.min("first").alias("top"))
    found = groups.join(tops, "root").select("print", "top")
    return durable(classes.join(found, "print", "left").select("print", F.coalesce("top", "first").alias("top")))


def simhash_components(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every document of ``docs`` (doc_id, text).

    Null and empty texts have fingerprint zero and link like any other. A null doc_id
    takes part and gets the component of its group. Repeated rows are equal fingerprints.
    A task works through a megabyte of text at once, or through one longer text.
    """
    prints = durable(with_fingerprint(docs.select("doc_id", "text")).select("doc_id", "print"))
    return prints.join(simhash_groups(prints), "print").select(
        "doc_id",
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.col("top.doc_id").alias("component_id"),
    )


def simhash_dedup(docs: DataFrame) -> DataFrame:
    """One row of each group of near duplicates: the one of smallest doc_id.

    All columns of ``docs`` pass through. A null doc_id comes last; of rows that tie, one
    stays.
    """
    whole = docs.select(F.struct("*").alias("document"), F.monotonically_increasing_id().alias("row"))
    marked = durable(with_fingerprint(whole, "document.text"))
    prints = marked.select(F.col("document.doc_id").alias("doc_id"), "row", "print")
    stay = simhash_groups(prints).select(F.col("top.row").alias("row")).distinct()
    return marked.join(stay, "row", "left_semi").select("document.*")
