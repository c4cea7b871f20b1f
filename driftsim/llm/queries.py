"""The numbered queries: each applies its operator to whole tables and derives digests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftsim.llm import (
    decontamination,
    embedding_dedup,
    language_id,
    line_dedup,
    lm_scoring,
    packing,
    pii,
    quality,
    runs,
    simhash,
    substring_dedup,
    suffix_dedup,
    whitening,
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = line_dedup.line_dedup(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "document.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256")
    )


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return language_id.identify(docs).select(
        "document.doc_id",
        F.coalesce(F.crc32(F.col("document.doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
    )


def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substring_dedup.substring_dedup(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("document.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, folder, "documents").select("doc_id", "text"), keep=("doc_id",))
    counts = [pii.count_of(kind, "base").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select(
        "document.doc_id", *counts, F.sha2(pii.span_list("base"), 256).alias("base_sha256"), pii.span_list("spans").alias("spans")
    )


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontamination.benchmark_hits(docs, table(spark, folder, "benchmark"))
    return found.select(
        "document.doc_id",
        "n_words",
        decontamination.n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontamination.contaminated().alias("contaminated"),
    )


def op6_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_dedup.suffix_dedup(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("document.doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.embedding_links(table(spark, folder, "embeddings").select("vec_id", "embedding"))


def op8_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents").select("doc_id", "text"))


def op9_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scoring.score(table(spark, folder, "documents").select("doc_id", "text"))


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_components(table(spark, folder, "documents"))


def op11_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    trusted = table(spark, folder, "labels").filter("quality = 1 and toxic = 0").select("doc_id")
    return quality.rate_quality(docs, trusted).select(
        "document.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio"
    )


def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    found = whitening.whiten(table(spark, folder, "embeddings").select("vec_id", "embedding"))
    rows = found.select("document.vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        "n",
        # Null where the exact number needs more than a long; the operator has it whole.
        F.col("deviation").try_cast("long").alias("deviation"),
        "whitened",
        F.col("explained")[F.col("at")].alias("explained"),
        "identity_error",
    )


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """Where h % 10 = 0, with h the crc32 of the doc_id as text, the words from a on repeat p words of the text."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    cut = docs.select(
        "doc_id", "text", g.alias("g"), F.when((h % 10 == 0) & F.col("text").isNotNull(), F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)).alias("w")
    )
    n = F.size("w")
    some = F.when(n > 0, n)
    a = (F.col("g") % some).cast("int")
    placed = cut.select("*", some.alias("n"), a.alias("a"), (1 + F.floor((some - a) / (3 + F.col("g") % 8))).cast("int").alias("p"))
    times, rest = F.floor((F.col("n") - F.col("a")) / F.col("p")).cast("int"), ((F.col("n") - F.col("a")) % F.col("p")).cast("int")
    period = F.slice("w", F.col("a") + 1, F.col("p"))
    tail = F.concat(F.flatten(F.array_repeat(period, times)), F.slice("w", F.col("a") + 1, rest))
    planted = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")
    return placed.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = runs.collapse_runs(with_planted_periods(table(spark, folder, "documents")))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    # The runs stand by start, then period, so the first of the greatest stays.
    best = F.aggregate("runs", none, lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    rows = found.select("document.doc_id", "runs", best.alias("best"), F.array_join(lines, "").alias("lines"), "collapsed")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").cast("long").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_language_id": op2_language_id,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_personal_data": op4_personal_data,
    "op5_decontamination": op5_decontamination,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_simhash": op10_simhash,
    "op11_quality_rules": op11_quality_rules,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_periodic_runs": op13_periodic_runs,
    "pipeline": pipeline,
}
