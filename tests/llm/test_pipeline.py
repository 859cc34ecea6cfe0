"""The pipeline's stages one by one, and the registered queries against their SQL."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from newsmill.llm import queries
from newsmill.llm.common import stored, table

TABLES = "documents embeddings pages benchmark labels".split()


def test_stages_keep_the_columns_and_drop_what_they_should(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    extra = docs.withColumns({"row": F.lit("r"), "version": F.lit(1), "kept": F.lit(False), "number": F.lit(2)})
    extra = extra.unionAll(extra.limit(3)).unionAll(extra.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    extra = extra.unionAll(extra.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(-1).cast("long")))
    before = extra
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stored(stage(spark, before, sf_dir), "test")
        assert after.columns == before.columns, name
        assert after.dtypes == before.dtypes, name
        assert 0 < after.count() <= before.count()
        assert after.filter("n_chars <> coalesce(char_length(text), 0)").count() == 0
        before = after
    assert before.filter("doc_id is not null").count() == before.filter("doc_id is not null").select("doc_id").distinct().count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, sf_dir)
    assert pieces.filter("piece = 0").count() == before.count()
    none = before.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0


def test_run_returns_pieces(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    found = queries.QUERIES[name](spark, sf_dir)
    names = sorted(found.columns)
    expected = con.execute(f"select {', '.join(names)} from ({queries.ORACLES[name]})").fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found.select(*names).collect()), key=key) == sorted(expected, key=key)
