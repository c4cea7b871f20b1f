"""From raw documents to packed training sequences, in five stages.

A stage takes the documents its predecessor kept and returns those it keeps, with the
columns of ``documents``; the last one returns the packing. Between stages the rows are
written as Parquet and read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftsim.llm import decontamination, language_id, line_dedup, packing, simhash
from driftsim.session import durable

#: Under this mean probability of its best language a text is in none of them.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those whose language is not clear.

    A null or empty text has no letter. Repeated rows share their fate; further columns
    pass through under any name, here and in the stages below.
    """
    found = language_id.identify(docs)
    return found.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("document.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of three lines that stood before; no document is dropped.

    Of equal documents the one of smallest doc_id keeps its lines, the others end up
    empty; a row that is there twice is one document. A null text stays null.
    """
    found = line_dedup.line_dedup(docs)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return found.select(*[new.get(c, F.col("document").getField(c)).alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest id of each group of near duplicates.

    Null and empty texts are one group; of rows that tie, one stays; a null doc_id is last.
    """
    return simhash.simhash_dedup(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth or more stands in the benchmark.

    Null and empty texts have no words and stay; repeated rows share their fate.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.benchmark_hits(docs, items).filter(~decontamination.contaminated()).select("document.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place the documents in training sequences.

    Null and empty texts are one end token; an empty table gives no rows.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("line_dedup", lines),
    ("simhash_dedup", near_copies),
    ("decontamination", benchmark),
    ("packing", packed),
]

#: Learned predictions, fingerprints and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
