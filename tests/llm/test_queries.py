"""The registered queries against their SQL, and the pipeline against its stages."""

import os

import pytest

import corpus_pipeline
import oracle
from textforge.llm import queries

FOLDER = f"/root/testdata/sf{os.environ.get('ORACLE_SF', '0.001')}"


@pytest.fixture(scope="module")
def connection():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, connection, name):
    df = queries.QUERIES[name](spark, FOLDER)
    if name in queries.ORACLES:
        assert oracle.compare(df, connection, queries.ORACLES[name]) is None
    else:
        assert df.count() > 0


def test_registered():
    import __spark_entry__ as contract

    assert {*queries.QUERIES, "pipeline"} <= set(contract.queries()) and len(queries.QUERIES) == 13


def test_pipeline_stages(spark):
    """Each stage works on what the one before kept, and all but the last keep the columns of documents."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = queries_written(spark, stage(spark, before, FOLDER))
        assert after.schema.names == docs.schema.names
        kept = {r.doc_id for r in after.select("doc_id").collect()}
        assert kept <= ids and (kept == ids or name != "line dedup")
        assert name == "line dedup" or all(r.text.strip() for r in after.collect())
        assert after.where("n_chars <> length(text)").count() == 0
        ids, before = kept, after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, FOLDER)
    assert sorted(r.doc_id for r in packed.collect()) == sorted(ids)
    assert corpus_pipeline.run(spark, FOLDER).count() == len(ids)


def queries_written(spark, df):
    from textforge.llm.common import materialise

    return materialise(df, "test-stage")
