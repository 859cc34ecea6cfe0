"""Operators against brute force on small fixtures, and invariants."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from newsmill.functions import score as Z, text as T
from newsmill.operators import collect as K, dedup as D, evaluation as V, health as H, lifecycle as Y
from newsmill.operators.skew import bucketed_rank
from newsmill.plans import evaluation_queries as EV


def lev(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def similar(a: str, b: str) -> bool:
    return a == b or 100 * (1 - lev(a, b) / max(len(a), len(b))) >= 85


def titles(n: int, seed: int) -> list[str]:
    rng, out = random.Random(seed), []
    while len(out) < n:
        base = "".join(rng.choice("abcdeé ") for _ in range(rng.choice([2, 5, 7, 12, 14, 20, 40])))
        out.append(base)
        for _ in range(rng.randint(0, 3)):
            t = list(base)
            for _ in range(rng.randint(1, 1 + len(base) // 6)):
                k = rng.randrange(len(t))
                t[k : k + 1] = rng.choice([[], ["x"], [t[k], "y"]])
                t = t or ["z"]
            out.append("".join(t))
    return out[:n]


def test_similar_keys_equal_all_pairs(spark):
    keys = sorted({t for t in titles(120, 3) if t})
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    found = {(r.left_key, r.right_key) for r in D.similar_keys(df, df).collect()}
    assert found == {(a, b) for a in keys for b in keys if similar(a, b)}


def greedy(rows: list[tuple]) -> set[int]:
    """Numbers of the (number, title, URL) that stay when they are gone through in order."""
    kept: list[tuple] = []
    for n, t, u in sorted(rows, key=lambda r: r[0]):
        if all((not u or u != b) and not (t and a and similar(t, a)) for _, a, b in kept):
            kept.append((n, t, u))
    return {n for n, _, _ in kept}


@pytest.mark.parametrize("sweep_rows", [0, 25, 200_000])
def test_batch_dedup_is_the_greedy_choice(spark, sweep_rows):
    rng = random.Random(9)
    rows = [(i, t, f"u{rng.randrange(60)}") for i, t in enumerate(titles(100, 5))]
    rows += [(100, None, None), (101, "", ""), (102, None, "u1"), (103, rows[0][1], None), (104, "", "alone"), (105, *rows[3][1:])]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "n long, title string, url string")
    found = {r.n: r.keep for r in D.dedup_in_batch(df, "n", F.col("url"), F.col("title"), sweep_rows=sweep_rows).collect()}
    assert len(found) == len(rows)
    assert {n for n, k in found.items() if k} == greedy(rows)


def test_a_long_chain_of_conflicts_ends(spark):
    """Each row shares its URL with the one before it or its title with the one after it."""
    n = 10_000
    df = spark.range(n).select("id", F.floor(F.col("id") / 2).alias("u"), F.substring(F.md5(F.floor((F.col("id") + 1) / 2).cast("string")), 1, 12).alias("t"))
    found = sorted(r.id for r in D.dedup_in_batch(df, "id", F.col("u").cast("string"), F.col("t")).filter("keep").collect())
    assert found == list(range(0, n, 2))


def test_batch_dedup_of_nothing(spark):
    df = spark.createDataFrame([], "n long, title string, url string, _n string, keep boolean").drop("keep")
    out = D.dedup_in_batch(df, "n", F.col("url"), F.col("title"))
    assert out.columns == ["n", "title", "url", "_n", "keep"] and out.count() == 0


def test_collect_is_the_sequential_choice(spark):
    rng = random.Random(4)
    at = lambda k: f"2024-01-{k:02} 12:00:00"
    pool = [(t + " story " + t[::-1]) for t in titles(60, 8)]
    rows = [(i, "cell", rng.choice(pool), f"https://a.example/{rng.randrange(90)}", rng.choice([at(30), at(29), at(20), None]), rng.choice([None, "protein folding with deep learning", "sports report"])) for i in range(150)]
    rows.append((150, "lancet", "AI tool: " + "x" * 600, "https://a.example/long", at(30), "machine learning for molecules and chemistry"))
    known, past = ["https://a.example/1", "https://a.example/2"], [(k, t) for k, t in enumerate(pool[:6])]
    schema = "item_id long, source string, title string, link string, d string, description string"
    candidates = spark.createDataFrame(rows, schema).withColumn("date", F.col("d").cast("timestamp_ntz")).drop("d")
    decided = K.collect(
        candidates, spark.createDataFrame([(u,) for u in known], "link string"), F.lit(at(31)).cast("timestamp_ntz"),
        history=spark.createDataFrame(past, "match_id long, title string"), categories=spark.createDataFrame([(7, "biology", "science"), (8, "medicine", "science")], "id long, slug string, type string"),
    )
    counted, funnel = K.observed_funnel(decided)
    found = {r.item_id: r for r in counted.collect()}

    keys = dict(enumerate(r.k for r in candidates.orderBy("item_id").select(T.normalize_title(F.col("title")).alias("k")).collect()))
    old = {m: r.k for m, r in zip((m for m, _ in past), spark.createDataFrame(past, "m long, t string").orderBy("m").select(T.normalize_title(F.col("t")).alias("k")).collect(), strict=True)}
    expected, inserted = {}, []
    for i, _, _, link, d, _ in rows:
        match = [(lev(keys[i], k) / max(len(k), len(keys[i])), m) for m, k in old.items() if keys[i] and k and similar(keys[i], k)]
        if d not in (at(30), at(29)):
            expected[i] = ("stale", None)
        elif link in known:
            expected[i] = ("url-exists", None)
        elif match:
            expected[i] = ("semantic-title", min(match)[1])
        elif any(link == b or (keys[i] and k and similar(keys[i], k)) for k, b in inserted):
            expected[i] = ("duplicate-in-batch", None)
        else:
            expected[i] = ("inserted", None)
            inserted.append((keys[i], link))
    assert {i: (r.decision, r.match_id) for i, r in found.items()} == expected
    assert {w for w, _ in expected.values()} == {"stale", "url-exists", "semantic-title", "duplicate-in-batch", "inserted"}
    long = found[150]
    assert (len(long.stored_title), len(long.title), long.is_science, long.category_slug, long.category_id) == (500, 609, True, "medicine", 8)
    assert all(r.section is None and r.sphere_tags is None and r.stored_title is None for r in found.values() if r.decision != "inserted")
    counts = funnel.get
    assert counts["raw"] == len(rows) and counts["inserted"] == len(inserted) and counts["duplicate_titles"] == sum(w == "semantic-title" for w, _ in expected.values())
    assert counts == K.collect_funnel(decided).first().asDict()


def test_history_is_searched_whole(spark):
    history = spark.createDataFrame([(i, f"story number {i} about something else entirely {i * i}") for i in range(50)], "match_id long, t string")
    new = spark.createDataFrame([(1, "a", "story number 7 about something else entirely 49!"), (2, "known", "fresh"), (3, "c", "nothing like it at all")], "id long, url string, title string")
    known = spark.createDataFrame([("known",)], "url string")
    out = {r.id: (r.reason, r.match_id) for r in D.dedup_against_history(new, history, known, F.col("title"), F.col("t")).collect()}
    assert out == {1: ("semantic-title", 7), 2: ("url-exists", None), 3: ("unique", None)}


def test_bucketed_rank_is_the_rank(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.8 else "k", rng.randrange(1000), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, v long, i long")
    found = {r.i: r.rank for r in bucketed_rank(df, ["k"], ["v", "i"], F.floor(F.col("v") / 50)).collect()}
    for key in ("hot", "k"):
        order = sorted((v, i) for k, v, i in rows if k == key)
        assert [found[i] for _, i in order] == list(range(1, len(order) + 1))


def test_source_health_equals_the_fold(spark):
    rng = random.Random(6)
    rows = [(s, e, f"2024-01-01 00:{e % 60:02d}:00", rng.random() < 0.6, rng.random() < 0.8, None, float(e)) for s in range(5) for e in range(20)]
    df = spark.createDataFrame(rows, "source_id long, event_id long, t string, accessible boolean, selector_works boolean, error string, response_ms double").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    found = {r.source_id: (r.status, r.consecutive_fails) for r in H.source_health(df).collect()}
    for s in range(5):
        fails, status = 0, None
        for _, _, _, ok, works, *_ in sorted((r for r in rows if r[0] == s), key=lambda r: (r[2], r[1])):
            status = "failed" if not ok else "degraded" if not works else "healthy"
            fails = 0 if status == "healthy" else fails + 1
        assert found[s] == (status, fails)


def test_failure_policy(spark):
    rows = [(1, "fetch", "x", False, 1, "2024-01-01"), (1, "fetch", "y", False, 2, "2024-01-02"), (1, "fetch", "z", False, 3, "2024-01-03"), (2, "zen", "x", False, 4, "2024-01-01"), (2, "zen", "x", False, 5, "2024-01-01"),
            (2, "zen", "x", False, 6, "2024-01-01"), (3, "fetch", "youtube-transcript-unavailable", True, 7, "2024-01-01"), (4, "fetch", "x", False, 8, "2024-01-01")]
    df = spark.createDataFrame(rows, "article_id long, stage string, reason string, is_youtube boolean, event_id long, t string").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    found = {r.article_id: (r.attempts, r.reject, r.last_reason) for r in Y.failure_policy(df).collect()}
    assert found == {1: (3, True, "z"), 2: (3, False, "x"), 3: (1, True, "youtube-transcript-unavailable"), 4: (1, False, "x")}


def test_upsert_and_cap(spark):
    old = spark.createDataFrame([(1, "a", "c1"), (2, "b", "c2")], "id long, name string, made string")
    new = spark.createDataFrame([(2, "B", "c9"), (3, "C", "c3")], "id long, name string, made string")
    assert sorted(map(tuple, Y.upsert(old, new, "id", ["name"]).collect())) == [(1, "a", "c1"), (2, "B", "c2"), (3, "C", "c3")]
    rows = spark.createDataFrame([(i, s, "2024-01-01") for i, s in enumerate([90, 80, 80, 40, None, 70])], "id long, score int, created_at string")
    found = {r.id: r.decision for r in V.gate_and_cap(rows, F.lit(1), 3).collect()}
    assert found == {0: "approved", 2: "approved", 1: "rejected-daily-cap", 5: "rejected-daily-cap", 3: "rejected-low-score", 4: "rejected-low-score"}


def test_large_caps_are_the_rank(spark):
    rng = random.Random(12)
    rows = [(i, rng.choice([None, 40, 50, 55, 55, 55, 80]), f"2024-01-{rng.randint(1, 9):02} 0{rng.randint(0, 9)}:00:00") for i in range(400)]
    df = spark.createDataFrame(rows, "id long, score int, t string").select("id", "score", F.col("t").cast("timestamp_ntz").alias("created_at"))
    order = sorted((r for r in rows if r[1] is not None and r[1] >= 50), key=lambda r: (r[1], r[2], r[0]), reverse=True)
    for cap in (1, 7, 60, 150, 1_000_000):
        found = {r.id: r.decision for r in V.gate_and_cap(df, F.lit(1), cap).collect()}
        assert len(found) == len(rows)
        assert {i for i, d in found.items() if d == "approved"} == {r[0] for r in order[: max(0, cap - 1)]}
        assert {i for i, d in found.items() if d == "rejected-low-score"} == {r[0] for r in rows if r[1] is None or r[1] < 50}


def test_whole_titles_are_compared(spark, sf_dir):
    from newsmill.plans import fixtures as X, load

    titles_ = {r.id: (r.title, r.original_title) for r in X.news(spark, sf_dir).select("id", "title", "original_title").collect()}
    found = load().QUERIES["title_similarity_whole"](spark, sf_dir).collect()
    short = {r.id: r.similarity for r in found if len(titles_[r.id][0] or "") <= 200}
    assert len(found) == len(titles_) and any("ИИ" in (titles_[i][0] or "") for i in short)
    blank = " \t\n\x0b\f\r"
    for i, similarity in short.items():
        a, b = ((t or "").strip(blank).lower() for t in titles_[i])
        longest = max(len(a), len(b))
        assert abs(similarity - (1.0 if longest == 0 else 1 - lev(a, b) / longest)) < 1e-5, (a, b)


def test_criteria_counts_build_each_evidence_text_once(spark):
    article = {"section": "ai-news", "source": "src0", "is_science": False, "original_url": "https://e.com/1", "page_text": None, "links": [], "repo_found": False, "sphere_tags": []}
    rows = [
        {"title": "GPT", "trending_rank": 5, "page_text": "an AI agent with RAG over MCP"}, {"title": "GPT", "trending_rank": 5, "page_text": "an AI agent with RAG over MCP"},
        {"title": "Football", "trending_rank": 20, "license": "MIT", "stars": 20000}, {"title": "Football", "trending_rank": 60}, {"title": None, "section": None},
        {"title": "A protein", "source": "nature", "section": "science", "is_science": True, "altmetric": 70},
    ]
    types = "title string, section string, source string, is_science boolean, original_url string, page_text string, links array<string>, repo string, repo_found boolean, stars int, license string, " \
        "repo_created_at timestamp_ntz, repo_description string, repo_topics array<string>, trending_rank int, hn_points int, altmetric int, sphere_tags array<string>"
    names = [t.split()[0] for t in types.split(", ")]
    df = spark.createDataFrame([tuple((article | r).get(n) for n in names) for r in rows], types)
    scored = Z.score_articles(df, F.lit("2024-01-31").cast("timestamp_ntz"))
    counts = Z.criteria_counts(scored)
    expected = Counter(b.criterion for r in scored.select("breakdown").collect() for b in r.breakdown)
    assert expected["github-trending-top10"] == expected["tech-trend-bonus"] == 2 and expected["tier1-source"] == expected["invention-reroute"] == expected["open-license"] == 1
    assert sorted(map(tuple, counts.collect())) == sorted(expected.items())
    assert counts._jdf.queryExecution().optimizedPlan().toString().count("concat_ws") == 2  # the evidence and the invention text


def test_score_sum_looks_for_terms_in_texts_built_before(spark, tmp_path):
    tables = {
        "documents": ([(i, f"Title {i}\nabout an agent", "en", "src0") for i in range(10)], "doc_id long, text string, lang string, source string"),
        "pages": ([(i, f"https://e.com/{i}", "<article>an agent</article>") for i in range(5)], "page_id long, url string, html string"),
        "events": ([(1, None, 1, "click", 9.0)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"),
        "embeddings": ([(1,)], "vec_id long"), "part": ([(1, "a part", "T", 50)], "p_partkey long, p_name string, p_type string, p_size int"),
    }
    for name, (rows, types) in tables.items():
        spark.createDataFrame(rows, types).write.parquet(f"{tmp_path}/{name}.parquet")
    found = EV.score_sum(spark, str(tmp_path))
    assert dict(map(tuple, found.collect()))["tier1-source"] == 3  # items 1, 5 and 9
    assert found._jdf.queryExecution().optimizedPlan().toString().count("page_text") < 30


def test_articles_without_doi_and_repository_are_spread(spark):
    none = "cast(array() as array<string>)"
    keyed = "id % 8 = 0 and id < 400"
    articles = spark.range(800).selectExpr(
        "id", "if(id % 3 = 0, null, 'https://e.com/' || id) as original_url", "if(id % 3 = 1, null, 'Title ' || id) as title", "cast(null as int) as hn_points",
        f"{none} as links", f"if({keyed}, array('10.1234/A.' || id % 16), {none}) as dois", f"if({keyed}, 'o/r' || id % 16, null) as repo",
    ).unionAll(spark.sql(f"select cast(null as bigint), cast(null as string), cast(null as string), cast(null as int), {none}, {none}, cast(null as string)"))
    hits = spark.createDataFrame([("https://e.com/1", None, 7), ("https://e.com/1", None, 9), (None, "Title 3", 5), (None, None, 99)], "url string, title string, points int")
    scores = spark.createDataFrame([("10.1234/a.8", 60.5), ("10.1234/A.8", 70.5), (None, 90.5)], "doi string, score double")
    repos = spark.createDataFrame([("o/r8", 600, "MIT", None, "a repo", ["llm"]), (None, 5, None, None, None, None)], "full_name string, stars int, license string, created_at timestamp_ntz, description string, topics array<string>")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = V.enrich_signals(articles, hits, scores, repos).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(rows) == 801
    assert {r.id: r.hn_points for r in rows if r.hn_points is not None} == {1: 9, 3: 5}
    eights = set(range(8, 400, 16))
    assert {r.id for r in rows if r.altmetric is not None} == {r.id for r in rows if r.repo_found} == {r.id for r in rows if r.stars == 600} == eights
    assert {r.altmetric for r in rows} == {None, 71}
    assert max(Counter(r.task for r in rows).values()) < 200  # one task had all 751 without a repository
