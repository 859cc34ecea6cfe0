"""Literal cases of rule functions: patterns, URLs, titles, model answers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from newsmill import rules
from newsmill.functions import score as Z, text as T, urls as U
from newsmill.operators import prompts as P


def patterns() -> list[str]:
    tables = [p for _, p in [*rules.SCIENCE_RULES, *rules.TECH_RULES]] + [p for *_, p in rules.SPHERES]
    return [*rules.SCIENCE_AI_PATTERNS, *rules.INVENTION_TERMS, rules.AI_TERMS, rules.TECH_TREND_TERMS, rules.SCIENCE_DOMAIN_TERMS, rules.YOUTUBE_AI_TERMS, *tables]


def test_prefilter_never_changes_a_match(spark):
    """For every pattern of the tables, has_any is the plain match: its own words make up the texts."""
    import re

    words = sorted({w for p in patterns() for w in re.findall(r"[A-Za-zЀ-ӿ]{2,}(?:[ -][A-Za-zЀ-ӿ]+)*", p)})
    texts = [(w.lower(),) for w in words] + [(f"x{w.lower()}y",) for w in words] + [(f"about {w.lower()}, and more",) for w in words] + [("",), ("nothing here",)]
    df = spark.createDataFrame(texts, "t string")
    lower = [p if r"\p" in p else p.lower() for p in patterns()]
    checks = [F.count_if(T.has_any(F.col("t"), p) != F.col("t").rlike(T.pattern(p, False))) for p in lower]
    assert set(df.agg(*[c.alias(f"c{k}") for k, c in enumerate(checks)]).first()) == {0}


def test_alternatives_and_needles():
    assert T._alternatives(r"(a|b)") == ["a", "b"]
    assert T._alternatives(r"(^|[^\p{L}])ии([^\p{L}]|$)") == [r"(^|[^\p{L}])ии([^\p{L}]|$)"]
    assert T._needle(r"(^|[^\p{L}])ии([^\p{L}]|$)") == "ии"
    assert T._needle(r"materials? science") == "material"
    assert T._needle(r"[a|b]+x\.y") == "x.y"
    assert T._needle(r"(a|b)") == ""


@pytest.mark.parametrize(("url", "reason"), [
    ("http://[0:0:0:0:0:0:0:1]/", "private/internal host blocked: [::1]"), ("http://[::1]/", "private/internal host blocked: [::1]"), ("http://[::]/", "private/internal host blocked: [::]"),
    ("http://[fe80::1]/", "private/internal host blocked: [fe80::1]"), ("http://[2001:db8::1]/", None), ("http://[1::2::3]/", "invalid URL"),
    ("http://0x" + "0" * 20 + "7f000001/", "private/internal host blocked: 127.0.0.1"), ("http://0x" + "0" * 20 + "08080808/", None),
    ("http://2130706433/", "private/internal host blocked: 127.0.0.1"), ("http://127.1/", "private/internal host blocked: 127.0.0.1"), ("https://example.com/", None), ("javascript:x", "scheme not allowed: javascript:"),
])
def test_url_safety(spark, url, reason):
    assert U.with_url_safety(spark.createDataFrame([(url,)], "u string"), "u", "r").first().r == reason


@pytest.mark.parametrize(("url", "key"), [
    ("https://www.Example.com/Path/?utm_source=x#top", "example.com/path"), ("http://e.com/a/../b", "e.com/b"), ("http://e.com/a/./b/", "e.com/a/b"), ("http://e.com/..", "e.com"),
    ("ftp://e.com/a?utm_source=1", "ftp://e.com/a"), (" Not a URL ", "not a url"), ("https://e.com:443/x", "e.com/x"), ("http://e.com:443/x", "e.com:443/x"),
])
def test_normalize_url(spark, url, key):
    assert spark.createDataFrame([(url,)], "u string").select(U.normalize_url(F.col("u"))).first()[0] == key


@pytest.mark.parametrize(("raw", "reason"), [
    ('{"x": {"title_ru": "s"}, "title_ru": 5, "summary": "y"}', "missing fields"), ("no object", "no JSON object"), ('{"title_ru": "a", "summary": }', "invalid JSON"),
    ('{"title_ru": " ", "summary": "b"}', "missing fields"), ('{"title_ru": "short", "summary": "short"}', "unusable text"),
    ('x ```json\n{"title_ru": "' + "t" * 50 + '", "summary": "' + "s" * 50 + '"}\n``` y', None), (None, None),
])
def test_model_answers(spark, raw, reason):
    row = P.with_parsed_response(spark.createDataFrame([(1, raw)], "id int, raw string"), "raw").first()
    assert row.reason == (reason if raw is not None else row.reason)
    if raw and reason is None:
        assert (row.title_ru, row.summary) == ("t" * 50, "s" * 50)


def test_prompts_lose_no_text(spark):
    queue = spark.createDataFrame([(1, "t", "s", "x" * 95), (2, "t", "s", None)], "id int, title string, source string, original_content string")
    rows = P.prompt_requests(queue, max_tokens=10).orderBy("id", "chunk_no").collect()
    assert [(r.id, r.chunk_no, r.n_chunks) for r in rows] == [(1, 1, 3), (1, 2, 3), (1, 3, 3), (2, 1, 1)]
    assert sum(r.prompt.count("x") for r in rows) == 95


@pytest.mark.parametrize(("has", "seconds", "dedicated", "relevant", "score", "eligible"), [
    (False, 600, True, True, 0, False), (True, 600, True, False, 80, True), (True, 100, False, False, 55, False), (True, 240, False, True, 80, True), (True, 2701, False, True, 70, True), (True, None, False, False, 55, False),
])
def test_score_youtube(spark, has, seconds, dedicated, relevant, score, eligible):
    df = spark.createDataFrame([(has, seconds, dedicated, relevant)], "h boolean, s int, d boolean, r boolean")
    row = df.select(*[v.alias(k) for k, v in Z.score_youtube(F.col("h"), F.col("s"), F.col("d"), F.col("r")).items()]).first()
    assert (row.score, row.eligible) == (score, eligible)
