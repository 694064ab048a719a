from pathlib import Path

import pytest

import corpus_pipeline
from corpusloom.llm import queries
from tests.test_entry import TABLES, compare, needs_tables


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.ORACLES[name])


@needs_tables
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_queries_without_sql_return_every_document(spark, name):
    got = queries.QUERIES[name](spark, str(TABLES))
    n = spark.read.parquet(f"{TABLES}/documents.parquet").count()
    assert 0 < got.count() and (name.startswith("op4") or got.count() == n)


@needs_tables
def test_pipeline_stages_keep_columns_and_decide(spark, tmp_path):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    columns, ids = docs.columns, set()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.count()
        stage(spark, docs, str(TABLES)).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and docs.count() <= before
    assert {"doc_id", "text", "shard", "slot"} <= set(docs.columns) and docs.count() == before
    ids = [r["doc_id"] for r in docs.collect()]
    assert len(ids) == len(set(ids)) > 50


def test_pipeline_on_an_empty_table(spark, tmp_path):
    for t, schema in (("documents", "doc_id bigint, text string, lang string, source string, n_chars bigint"), ("labels", "doc_id bigint, quality int, toxic int"), ("benchmark", "item_id bigint, text string")):
        spark.createDataFrame([], schema).write.parquet(str(Path(tmp_path) / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
