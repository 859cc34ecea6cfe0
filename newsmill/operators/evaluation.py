"""Evaluation: page signals, enrichment, gate and cap, the manifest for the language model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsmill import rules
from newsmill.functions import text as T, urls as U
from newsmill.operators.skew import bucketed_rank, left_join_known


def page_signals(pages: DataFrame) -> DataFrame:
    """(page_id, url, links, dois, repo, page_text): distinct http links and DOIs in order, the first repository, the text without tags."""
    links = F.array_distinct(F.regexp_extract_all("html", F.lit(r"""(?i)href=["'](http[^"']*)["']"""), F.lit(1)))
    repo = F.get(F.filter(F.transform(links, U.github_repo), lambda r: r.isNotNull()), F.lit(0))
    text = T.collapse_ws(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>[\s\S]*?</(script|style)>|<[^>]*>", " "))
    return pages.select("page_id", "url", links.alias("links"), U.all_dois(F.col("html")).alias("dois"), repo.alias("repo"), text.alias("page_text"))


def with_signals(articles: DataFrame, signals: DataFrame) -> DataFrame:
    """All articles with their page's signals (id, links, dois, repo, page_text); one without a fetched page has no links, DOIs, repository or text."""
    none = F.array().cast("array<string>")
    return articles.join(signals, "id", "left").withColumns({"links": F.coalesce("links", none), "dois": F.coalesce("dois", none)})


def enrich_signals(articles: DataFrame, hits: DataFrame, doi_scores: DataFrame, repos: DataFrame) -> DataFrame:
    """Adds hn_points, altmetric and the repository's figures to articles (id, original_url, title, hn_points, links, dois, repo).

    Hits are reduced to one row per URL and per title before they are joined.
    Points collected before are never replaced; hits by title count where
    those by URL give nothing.  Most articles have no DOI and no repository, so
    rows without a key are spread in each join.
    """
    points = lambda key, name: hits.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias(name)).agg(F.max("points").alias(f"_{key}_points"))
    by = ["id", "original_url", "title"]
    d = left_join_known(articles, points("url", "original_url"), "original_url", by)
    d = left_join_known(d, points("title", "title"), "title", by)
    found = F.coalesce(F.nullif("_url_points", F.lit(0)), "_title_points", "_url_points")
    doi = F.coalesce(U.extract_doi(F.col("original_url")), F.get("dois", F.lit(0)))
    d = d.withColumns({"hn_points": F.coalesce("hn_points", found), "_doi": F.lower(doi), "repo": F.coalesce(U.github_repo(F.col("original_url")), "repo")})
    scores = doi_scores.groupBy(F.lower("doi").alias("_doi")).agg(F.floor(F.max("score") + 0.5).cast("int").alias("altmetric"))
    known = repos.select(
        F.col("full_name").alias("repo"), F.lit(True).alias("repo_found"), "stars", "license", F.col("created_at").alias("repo_created_at"),
        F.col("description").alias("repo_description"), F.col("topics").alias("repo_topics"),
    )
    d = left_join_known(left_join_known(d, scores, "_doi", by), known, "repo", by)
    return d.withColumn("repo_found", F.coalesce("repo_found", F.lit(False))).drop("_url_points", "_title_points", "_doi")


def gate_and_cap(scored: DataFrame, approved_today: Column, cap: int = 0, gate: int = rules.SCORE_GATE) -> DataFrame:
    """Adds ``decision`` to all rows: approved, rejected-daily-cap or rejected-low-score.

    Without a cap nothing is ranked.  With one, the rows of each score are counted;
    scores that fit whole are approved whole, and only the rows of the one score at
    which the room ends are ranked, day by day, newest first.  What is broadcast has one
    row for each whole score.
    """
    passes = F.coalesce(F.col("score") >= gate, F.lit(False))
    if cap <= 0:
        return scored.withColumn("decision", F.when(passes, "approved").otherwise("rejected-low-score"))
    room = F.lit(cap) - approved_today
    passing = scored.filter(passes).select("id", "score", "created_at")
    before = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    counts = passing.groupBy("score").agg(F.count("*").alias("_n")).withColumn("_above", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    last = counts.filter((F.col("_above") < room) & (F.col("_above") + F.col("_n") > room)).select("score", "_above")
    day = -F.unix_date(F.col("created_at").cast("date"))
    ranked = bucketed_rank(passing.join(F.broadcast(last), "score"), [], [F.col("created_at").desc(), F.col("id").desc()], day)
    within = ranked.filter(F.col("rank") <= room - F.col("_above")).select("id", F.lit(True).alias("_in"))
    d = scored.join(within, "id", "left").join(F.broadcast(counts), "score", "left")
    approved = passes & (F.coalesce(F.col("_above") + F.col("_n") <= room, F.lit(False)) | F.col("_in").isNotNull())
    decision = F.when(approved, "approved").when(passes, "rejected-daily-cap").otherwise("rejected-low-score")
    return d.withColumn("decision", decision).drop("_in", "_n", "_above")


def approved_today(news: DataFrame, now: Column, gate: int = rules.SCORE_GATE) -> Column:
    """How many rows of the day that ``now`` falls on have passed already."""
    day = F.date_trunc("day", now).cast("timestamp_ntz")
    states = F.col("status").isin("pending", "summarized", "translated", "published")
    return news.filter((F.col("score") >= gate) & states & (F.col("created_at") >= day)).agg(F.count("*")).scalar()


def pending_for_eval(news: DataFrame) -> DataFrame:
    """All rows without a score, newest first; a caller may page."""
    return news.filter((F.col("status") == "pending") & F.col("score").isNull()).orderBy(F.col("created_at").desc(), F.col("id").desc())


def manifest(news: DataFrame, min_score: int = rules.MANIFEST_MIN_SCORE, science: bool | None = None) -> DataFrame:
    """All rows that wait for a summary, newest first; a caller may page."""
    d = news.filter((F.col("status") == "pending") & F.col("content").isNull() & (F.col("score") >= min_score))
    return (d if science is None else d.filter(F.col("is_science") == science)).orderBy(F.col("published_at").desc(), F.col("id").desc())


def manifest_summary(rows: DataFrame) -> DataFrame:
    """(kind, value, n): total and counts by status, language (unknown ones left out) and source."""
    cube = rows.groupingSets([["status"], ["language"], ["source"], []], "status", "language", "source").agg(
        F.grouping_id().alias("_g"), F.count("*").alias("n")
    )
    kind = F.when(F.col("_g") == 3, "status").when(F.col("_g") == 5, "language").when(F.col("_g") == 6, "source").otherwise("total")
    value = F.coalesce("status", "language", "source")
    return cube.select(kind.alias("kind"), value.alias("value"), "n").filter("kind <> 'language' or value is not null")
