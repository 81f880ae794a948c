"""The corpus pipeline, stage by stage, and queries against SQL."""

import duckdb
import pytest

import corpus_pipeline
from tracewright.llm import queries as q
from tracewright.llm.common import materialise


def test_stages_in_turn(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialise(stage(spark, before, sf_dir), name)
        assert after.columns == docs.columns
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()} and len(ids) > 0.5 * before.count()
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == ids
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(tuple, packed.select("doc_id", "piece", "length", "ids_crc32").collect()))


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    ours, theirs = q.queries()[name](spark, sf_dir), con.sql(q.oracle_sql()[name])
    order = sorted(ours.columns)
    assert order == sorted(theirs.columns)
    at = [theirs.columns.index(c) for c in order]
    assert sorted(str(tuple(r)) for r in ours.select(*order).collect()) == sorted(str(tuple(r[i] for i in at)) for r in theirs.fetchall())
