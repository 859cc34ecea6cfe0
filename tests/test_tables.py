"""Typed tables: constraints, versions, which files a change writes and a read opens."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from newsmill.operators import lifecycle as Y, reader_state as R
from newsmill.plans import fixtures as X
from newsmill.sources.tables import FAVORITES, NEWS, PARSING_LOGS, READ_STATUS, DayTable, KeyedTable, Spec, conform
from tests.test_queries import plan

SMALL = Spec("id BIGINT NOT NULL, url STRING NOT NULL, n INT, status STRING NOT NULL", ("id",), {"url_http": "url rlike '^https?://'"}, {"status": "'pending'"})


def rows(spark, *data, ddl="id long, url string, n int"):
    return spark.createDataFrame(list(data), ddl)


def found(d):
    return sorted(map(tuple, d.collect()))


def files(folder) -> set[str]:
    return {str(p) for p in Path(folder).rglob("*.parquet")}


def test_rows_take_types_and_defaults(spark):
    d = conform(spark.createDataFrame([("7", "https://a", "x", 5)], "id string, url string, status_ string, other int"), SMALL)
    assert found(d) == [(7, "https://a", None, "pending")] and [f.dataType.simpleString() for f in d.schema] == ["bigint", "string", "int", "string"]


@pytest.mark.parametrize("bad", [(None, "https://a", 1), (1, None, 1), (1, "ftp://a", 1)])
def test_a_broken_constraint_leaves_the_table_as_it_was(spark, tmp_path, bad):
    t = KeyedTable(spark, str(tmp_path / "t"), SMALL, 4)
    assert t.version() == 0 and found(t.read()) == []
    t.overwrite(rows(spark, (1, "https://a", 1), (2, "http://b", None)))
    before = found(t.read())
    with pytest.raises(Exception, match="constraint"):
        t.overwrite(rows(spark, bad, (9, "https://z", 1)))
    with pytest.raises(Exception, match="(?s)constraint"):
        t.update(rows(spark, (1, "https://a", 5)), lambda old, new: new.withColumn("url", F.lit("gopher://a")))
    assert t.version() == 1 and found(t.read()) == before


def test_keys_stay_unique_and_inside_their_buckets(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), SMALL, 4)
    with pytest.raises(ValueError, match="key met twice"):
        t.overwrite(rows(spark, (1, "https://a", 1), (1, "https://b", 2)))
    t.overwrite(rows(spark, *[(i, "https://a", i) for i in range(20)]))
    with pytest.raises(Exception, match="outside"):
        t.update(rows(spark, (1, "https://a", 1)), lambda old, new: t.read().drop("status"))
    assert t.version() == 1 and t.read().count() == 20


def test_a_change_writes_the_buckets_of_its_keys_only(spark, sf_dir, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), NEWS, 32)
    news = X.news(spark, sf_dir)
    t.overwrite(news)
    old_files, old_rows = files(tmp_path / "t/rows"), found(t.read().select("id", "status"))
    assert t.update(rows(spark, (3, None, None), (None, None, None)).select("id"), lambda old, ids: Y.set_status(old, ids, "published", X.now())) == 2
    new_files = files(tmp_path / "t/rows") - old_files
    bucket = t.rows().filter("id = 3").first()["bucket"]
    assert len(new_files) == 1 and f"bucket={bucket}/" in next(iter(new_files)) and old_files <= files(tmp_path / "t/rows")
    wanted = Y.set_status(news.select("id", "status", "updated_at", "platform_published_at"), rows(spark, (3, None, None)), "published", X.now())
    assert found(t.read().select(*wanted.columns)) == found(wanted)
    assert found(t.read(version=1).select("id", "status")) == old_rows  # the earlier version is still readable
    assert found(t.lookup((3,), (5,)).select("id", "status")) == sorted((r.id, r.status) for r in wanted.filter("id in (3, 5)").collect())
    shown = plan(t.lookup((3,)))
    assert re.search(r"PartitionFilters: \[[^\n]*bucket", shown) and re.search(r"PushedFilters: \[[^\n]*EqualTo\(id,3\)", shown)
    assert t.update(rows(spark).select("id"), lambda old, ids: old) == 2  # nothing changed, no new version


def test_inserts_deletes_and_upserts(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), SMALL, 3, files=2)
    add = lambda old, new: Y.upsert(old, conform(new, SMALL), "id", ["n"])
    t.update(rows(spark, (1, "https://a", 1), (2, "https://b", 2)), add)
    t.update(rows(spark, (2, "https://other", 22), (3, "https://c", 3)), add)
    assert found(t.read()) == [(1, "https://a", 1, "pending"), (2, "https://b", 22, "pending"), (3, "https://c", 3, "pending")]
    for i in (1, 2, 3):
        t.update(rows(spark, (i, None, None)).select("id"), lambda old, ids: old.join(ids, "id", "left_anti"))
    assert found(t.read()) == [] and t.version() == 5


def test_of_two_writers_from_one_version_the_second_fails(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), SMALL, 2)
    t.overwrite(rows(spark, (1, "https://a", 1)))

    def slow(old, new):
        t.overwrite(rows(spark, (1, "https://a", 100)))  # another writer commits in between
        return new

    with pytest.raises(RuntimeError, match="another writer"):
        t.update(rows(spark, (1, "https://a", 7)), slow)
    assert found(t.read()) == [(1, "https://a", 100, "pending")]


def test_pairs_as_keys(spark, sf_dir, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), READ_STATUS, 8)
    status = X.read_status(spark, sf_dir)
    t.overwrite(status)
    marks = status.filter("not read").select("user_id", "news_id").unionAll(spark.createDataFrame([(10**9, 1)], "user_id long, news_id long"))
    t.update(marks, lambda old, m: R.mark_read(old, m, X.now()))
    assert found(t.read()) == found(R.mark_read(status, marks, X.now()).select(*t.read().columns))
    f = KeyedTable(spark, str(tmp_path / "f"), FAVORITES, 8)
    f.overwrite(X.favorites(spark, sf_dir))
    first = f.read().orderBy("user_id", "news_id").first()
    assert found(f.lookup((first.user_id, first.news_id))) == [tuple(first)]


def test_logs_by_day(spark, sf_dir, tmp_path):
    t, logs = DayTable(spark, str(tmp_path / "t"), PARSING_LOGS), X.parsing_logs(spark, sf_dir)
    assert found(t.read()) == []
    assert t.append(0, logs.filter("id % 2 = 0")) and t.append(1, logs.filter("id % 2 = 1")) and not t.append(1, logs)
    assert t.append(2, logs.limit(0))
    assert found(t.read()) == found(logs.select(*t.read().columns))
    some = t.read("2024-01-03", "2024-01-04")
    assert found(some) == found(logs.select(*some.columns).filter("date(created_at) between date'2024-01-03' and date'2024-01-04'")) and some.count()
    assert {re.search("day=([^/]+)", f).group(1) for f in some.inputFiles()} == {"2024-01-03", "2024-01-04"}
    with pytest.raises(Exception, match="constraint"):
        t.append(3, logs.withColumn("created_at", F.lit(None).cast("timestamp_ntz")))
    assert t.read().count() == logs.count()
