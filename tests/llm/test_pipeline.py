"""The pipeline's stages: columns, decisions, and the driver's entry."""

import __spark_entry__
import corpus_pipeline
from driftsim.llm.queries import LLM_QUERIES
from tests.llm.helpers import awkward, table

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, FOLDER)
        assert kept.columns == docs.columns
        assert kept.dtypes == docs.dtypes
        docs = spark.createDataFrame(kept.collect(), kept.schema)
        assert {r.doc_id for r in docs.collect()} <= ids
        assert docs.count() > 100, name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}


def test_stages_take_awkward_rows(spark):
    docs = table(spark, awkward()).drop("document").withColumnRenamed("spans", "stage")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() >= 0
    none = table(spark, [])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        none = stage(spark, none, FOLDER)
    assert none.count() == 0


def test_entry_has_all_queries():
    assert set(LLM_QUERIES) <= set(__spark_entry__.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in LLM_QUERIES if n.startswith("op")) == list(range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
