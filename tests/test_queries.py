"""Every registered query builds; the flagship has rows; plans are what they should be."""

from __future__ import annotations

import contextlib
import io

import duckdb
import pytest

import __spark_entry__ as entry_point
from newsmill.plans import load

OWN = dict(load().QUERIES)
EAGER = {"landed_json", "landed_json_rejects", "landed_tsv", "landed_tsv_rejects", "manifest_file", "collect", "collect_funnel", "dedup_in_batch", "title_similarity_join", "dedup_against_history", "fts_indexed", "fts_stemmed", "index_stems", "table_status", "table_read_marks", "table_logs_of_days"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", sorted(set(OWN) - EAGER))
def test_query_builds(spark, sf_dir, name):
    assert OWN[name](spark, sf_dir).columns


def test_oracles_bind(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    for name, sql in load().ORACLES.items():
        con.execute(f"describe {sql}"), name


def test_entry_has_rows(spark):
    assert entry_point.entry(spark).count() == 20
    assert set(OWN) <= set(entry_point.queries())


def test_category_join_does_not_shuffle_news(spark, sf_dir):
    assert "SortMergeJoin" not in plan(OWN["news_with_category"](spark, sf_dir))


def test_model_answers_are_parsed_once(spark, sf_dir):
    assert plan(OWN["save_summary"](spark, sf_dir)).count("regexp_extract(") <= 12


@pytest.mark.parametrize("name", ["news_page", "unread_counts", "classify_article", "collect", "collect_funnel", "seen_except", "title_similarity_join", "dedup_against_history", "dedup_in_batch", "source_health", "score_article", "manifest_summary", "llm_responses", "obsolete_categories", "run_messages", "decode_pages", "landed_json", "landed_json_rejects", "landed_tsv", "landed_tsv_rejects", "manifest_file", "fts_indexed", "table_status", "table_read_marks", "table_logs_of_days"])
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    found = OWN[name](spark, sf_dir)
    names = sorted(found.columns)
    expected = con.execute(f"select {', '.join(names)} from ({load().ORACLES[name]})").fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found.select(*names).collect()), key=key) == sorted(map(tuple, expected), key=key)
