"""Removal of repeated passages of three lines (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from driftsim.session import durable

LINES = 3


def line_dedup(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """Remove the lines of every window of ``lines`` lines that stood somewhere before.

    A text is cut at line feeds. A window is ``lines`` consecutive lines of one document;
    "before" is the order of (doc_id, place in the document), and windows are judged on
    the input. All lines under a later occurrence go, overlaps are merged, and the rest is
    joined by line feeds again.

    Returns (document, n_lines, n_removed, kept): ``document`` is the whole input row as
    a struct, so extra columns of any name pass through. A null text has no lines and
    stays null; an empty text is one empty line; fewer than ``lines`` lines are never
    removed; a document with nothing left gets an empty text. A null doc_id comes before
    all others. Rows with equal doc_id are told apart by their text; a row that is
    there twice is one document and both rows get the same result. A very long text is one
    row while it is cut and joined again; its windows are spread like any others.
    """
    whole = docs.select(F.struct("*").alias("document"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("print"))
    keyed = whole.withColumn("all", F.split("document.text", "\n", -1))

    def key(i):
        parts = [F.get("all", i + F.lit(j)) for j in range(lines)]
        return F.struct(i.alias("place"), F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(lines), *parts).alias("h2"))

    starts = F.sequence(F.lit(0), F.size("all") - lines)
    windows = (
        keyed.filter(F.size("all") >= lines)
        .select("id", "print", F.explode(F.transform(starts, key)).alias("w"))
        .select("id", "print", "w.*")
    )
    where = F.struct("id", "print", "place")
    # Written, so that the join is one of two plain tables, whose hot keys Spark can split.
    repeated = durable(
        windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(where).alias("first")).filter("n > 1")
    )
    later = windows.join(repeated, ["h1", "h2"]).filter(where > F.col("first"))
    covered = (
        later.groupBy("id", "print")
        .agg(F.collect_set("place").alias("places"))
        .select(
            F.col("id").alias("id2"),
            F.col("print").alias("print2"),
            F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + (lines - 1))))).alias("gone"),
        )
    )
    left = F.array_except(F.sequence(F.lit(0), F.size("all") - 1), F.col("gone"))
    kept = F.array_join(F.transform(left, lambda i: F.get("all", i)), "\n")
    met = whole.join(covered, F.col("id").eqNullSafe(F.col("id2")) & (F.col("print") == F.col("print2")), "left")
    return met.withColumn("all", F.split("document.text", "\n", -1)).select(
        "document",
        F.when(F.col("all").isNull(), 0).otherwise(F.size("all")).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("document.text")).otherwise(kept).alias("kept"),
    )
