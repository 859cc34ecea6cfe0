"""Literal cases of the digest, of captions, listings and encodings."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from newsmill.operators import digest as G
from newsmill.sources import landed as A
from tests.test_queries import plan


def split(spark, text, n):
    return spark.createDataFrame([(text,)], "t string").select(G.split_text(F.col("t"), n)).first()[0]


def test_split_text(spark):
    text = "\n".join(f"line {i}" for i in range(20))
    parts = split(spark, text, 30)
    assert all(len(p) <= 30 for p in parts) and "\n".join(parts) == text
    assert split(spark, "x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]
    assert split(spark, "short", 10) == ["short"] and split(spark, "", 10) == [""]
    assert split(spark, "ab\n\n\ncdefghijkl", 4) == ["ab\n\n", "cdef", "ghij", "kl"]


def test_digest_text(spark):
    at = "2024-01-05 10:00:00"
    rows = [(1, "a *b* [c]", "https://e.com/1", "ai-news", [], "Sum `x`", at)] + [(10 + k, f"t{k}", "u", "science", ["one", "two"], "s", at) for k in range(9)] + [(30, "old", "u", "ai-news", [], "", at)]
    news = spark.createDataFrame(rows, "id long, title string, original_url string, section string, sphere_tags array<string>, summary string, t string")
    news = news.withColumns({"platform_published_at": F.col("t").cast("timestamp_ntz"), "updated_at": F.col("t").cast("timestamp_ntz"), "status": F.lit("published"), "is_science": F.lit(False)})
    out = G.digest_text(G.digest_sections(G.digest_items(news))).collect()
    assert len(out) == 1 and str(out[0].day) == "2024-01-06"
    text = out[0].text
    assert "опубликовано: *10*" in text and "_6 января 2024 г._" in text
    assert "🛠 *ИИ-новости* — 1\n▫️ [a \\*b\\* \\[c\\]](https://e.com/1) — Sum \\`x\\`" in text
    assert "🔬 *ИИ для науки* — 9" in text and "Ещё 2 новостей про one, two — в дашборде." in text
    assert text.index("ИИ-новости") < text.index("ИИ для науки")


def test_captions(spark):
    vtt = "WEBVTT\nKind: captions\n\n00:01 --> 00:02\n<c>Tom &amp; Ann</c>\nTom &amp; Ann\n\n00:02 --> 00:03\nit&#39;s &quot;on&quot;\nTom &amp; Ann"
    json3 = '{"events": [{"segs": [{"utf8": "a "}, {"utf8": "b"}]}, {"segs": [{"utf8": "\\n"}]}, {}, {"segs": [{"utf8": "c"}]}]}'
    d = spark.createDataFrame([(1, vtt, "vtt"), (2, json3, "json3"), (3, None, "vtt"), (4, "broken", "json3")], "i int, raw string, kind string")
    assert {r.i: r.text for r in A.with_caption_text(d, "raw", "kind", min_chars=1).collect()} == {1: 'Tom & Ann it\'s "on" Tom & Ann', 2: "a b c", 3: None, 4: None}
    assert {r.text for r in A.with_caption_text(d, "raw", "kind").collect()} == {None}


def test_decoding_and_listing(spark):
    word = "Новости №1 «ё»"
    d = spark.createDataFrame([(bytearray(word.encode("cp1251")), "text/html; charset=windows-1251"), (bytearray(word.encode()), "text/html")], "b binary, k string")
    assert [r[0] for r in d.select(A.decoded(F.col("b"), F.col("k"))).collect()] == [word, word]
    lines = spark.createDataFrame([("a\t T \t20240102\t u",), ("b\tT\tnever\tu",), ("c\t\t20240102\tu",), ("d\tT\t20241399\tu",), ("",)], "line string")
    assert [(r.video_id, r.title, r.published_at and str(r.published_at.date())) for r in A.tsv_listing(lines).collect()] == [("a", "T", "2024-01-02"), ("b", "T", None), ("d", "T", None)]


def test_json_path(spark):
    d = spark.createDataFrame([(1, '{"data": {"rows": [{"a": {"b": " x "}}, {"imageUrl": "i"}]}}'), (2, "not json"), (3, '{"data": {"rows": 5}}')], "i int, p string")
    found = A.json_path_extract(d, "p", "data.rows", {"title": "a.b", "image_url": "imageUrl"}).collect()
    assert [tuple(r) for r in found] == [(1, "x", None), (1, "", "i")]


def test_language_of_held_out_documents(spark, sf_dir):
    from newsmill.operators import language as N

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("n_chars >= 100")
    profiles = N.language_profiles(docs.filter("doc_id % 2 = 0"))
    held = docs.filter("doc_id % 2 = 1")
    found = N.detect_language(held, profiles).join(held.select("doc_id", "lang"), "doc_id")
    right, n = found.agg(F.count_if(F.col("language") == F.col("lang")), F.count("*")).first()
    assert right / n >= 0.95
    short = spark.createDataFrame([(1, "too short"), (2, None), (3, "12345 67890 12345 67890")], "doc_id long, text string")
    assert {r.language for r in N.detect_language(short, profiles).collect()} == {"unknown"}
    assert "Exchange" not in plan(N.detect_language(held, profiles)) and "Subquery" not in plan(N.detect_language(held, profiles))
    # the end of a text counts as its beginning does, and rows may repeat
    mixed = [(4, "el camino de la casa y los perros de la ciudad " * 3 + "the house and the dogs of the town with their friends " * 300)] * 2
    assert [r.language for r in N.detect_language(spark.createDataFrame(mixed, "doc_id long, text string"), profiles).collect()] == ["en", "en"]
    none = N.language_profiles(docs.limit(0))
    assert {r.language for r in N.detect_language(held, none).collect()} == {"unknown"}


def test_language_weights_equal_a_plain_count(spark):
    import math

    from newsmill.operators import language as N

    texts = [(1, "xx", "aaab aab"), (2, "yy", "aaac caa"), (3, "xx", None), (4, None, "zzz")]
    profiles = N.language_profiles(spark.createDataFrame(texts, "doc_id long, lang string, text string"))
    grams = {"xx": Counter(), "yy": Counter()}
    for _, lang, t in texts:
        padded = f" {t or ''} "
        if lang:
            grams[lang].update(g for g in (padded[i: i + 3] for i in range(max(len(padded) - 2, 0))) if g.strip())
    total = {k: sum(c.values()) for k, c in grams.items()}
    assert {(r.lang, r.gram): (r.n, r.total) for r in profiles.collect()} == {(k, g): (n, total[k]) for k, c in grams.items() for g, n in c.items()}
    asked = ["aab aab aab aab aab aab", "caa aac caa aac caa aac", "aaa aaa aaa aaa aaa aaa", "qqq www eee rrr ttt yyy"]
    known = set().union(*grams.values())
    weight = lambda k, g: math.floor(1000 * math.log((grams[k][g] + 0.5) / total[k]))

    def brute(t):
        padded = f" {t} "
        met = [g for g in (padded[i: i + 3] for i in range(len(padded) - 2)) if g in known]
        return max((sum(weight(k, g) for g in met), k) for k in grams)[1] if met else "unknown"

    found = N.detect_language(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), profiles)
    assert [r.language for r in sorted(found.collect())] == [brute(t) for t in asked]
