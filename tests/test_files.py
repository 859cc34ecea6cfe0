"""Landed files with rejects, JSON files under commit records."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsmill.plans import fixtures as X, load
from newsmill.sources import files as A


def test_payload_lines_and_their_rejects(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"articles": [{"title": " one ", "url": "u1"}, {"title": null}]}\n{"articles": \n\n', encoding="utf-8")
    (tmp_path / "b.json").write_text('[1, 2]\n{"articles": []}\n{"articles": "none"}\nnull\n', encoding="utf-8")
    lines = A.landed_lines(spark, str(tmp_path))
    rows, rejects = A.read_json_payloads(lines)
    assert sorted((r.title, r.url, r.file.rsplit("/", 1)[1]) for r in rows.collect()) == [("", "", "a.json"), ("one", "u1", "a.json")]
    assert sorted((r.line, r.reason) for r in rejects.collect()) == [("[1, 2]", "no-items"), ("null", "no-items"), ('{"articles": ', "not-json"), ('{"articles": "none"}', "no-items")]


def test_listing_lines_and_their_rejects(spark, tmp_path):
    (tmp_path / "list.tsv").write_text("v1\tOne\t20240102\thttps://y/1\nv2\tTwo\tsoon\thttps://y/2\n\tThree\t20240102\thttps://y/3\nv4\n", encoding="utf-8")
    rows, rejects = A.read_tsv_listing(A.landed_lines(spark, str(tmp_path)))
    assert sorted((r.video_id, str(r.published_at)) for r in rows.collect()) == [("v1", "2024-01-02 00:00:00"), ("v2", "None")]
    assert sorted((r.line, r.reason) for r in rejects.collect()) == [("\tThree\t20240102\thttps://y/3", "no-id"), ("v4", "no-title")]


def test_a_large_file_is_read_by_several_tasks(spark, tmp_path):
    line = '{"articles": [{"title": "' + "t" * 1000 + '"}]}\n'
    (tmp_path / "large.json").write_text(line * 2000, encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        rows, rejects = A.read_json_payloads(A.landed_lines(spark, str(tmp_path)))
        assert rows.rdd.getNumPartitions() >= 4
        assert rows.count() == 2000 and rejects.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_json_is_seen_once_committed(spark, tmp_path):
    sink = A.JsonSink(spark, str(tmp_path))
    assert sink.read() is None
    rows = spark.createDataFrame([(1, "а\n\"б\"", None), (2, None, "x")], "id long, title string, note string")
    rows.write.json(f"{tmp_path}/files/cut-short")  # a write whose driver was lost before the record
    assert sink.read() is None
    record = sink.write(rows, "one", titled=F.count("title"))
    assert (record["rows"], record["titled"]) == (2, 1)
    assert sink.write(rows.limit(1), "one") == record
    sink.write(rows.limit(0), "two")
    assert sorted(map(tuple, sink.read().collect())) == [(1, "а\n\"б\"", None), (2, None, "x")]
    assert sink.read("two").count() == 0 and sink.read("none") is None


def test_legacy_pages_are_decoded(spark, sf_dir):
    pages = {r.page_id: r.html for r in X.table(spark, sf_dir, "pages").collect()}
    found = {r.page_id: r.text for r in load().QUERIES["decode_pages"](spark, sf_dir).collect()}
    legacy = {i: h.encode("latin-1").decode("cp1251") for i, h in pages.items() if i % 2 == 0}
    assert any(text != pages[i] for i, text in legacy.items())
    assert found == {i: "<!-- Новости науки № 7 — ёлка --> " + legacy.get(i, h) for i, h in pages.items()}
