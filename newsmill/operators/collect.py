"""Collection: landed rows to candidates, freshness, caps, merges and the funnel."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from newsmill import rules
from newsmill.functions import classify as C, text as T
from newsmill.operators.dedup import dedup_against_history, dedup_in_batch
from newsmill.operators.listing import hours
from newsmill.operators.skew import bucketed_rank
from newsmill.session import cut_lineage


def feed_candidates(items: DataFrame, missing_date: Column | None = None) -> DataFrame:
    """Trimmed rows with a title and an http link; a missing date becomes ``missing_date`` (stays missing by default)."""
    d = items.withColumns({"title": T.trim_ws(F.col("title")), "link": T.trim_ws(F.col("link"))})
    d = d.filter((T.or_empty(F.col("title")) != "") & F.col("link").startswith("http"))
    date = F.col("iso_date") if missing_date is None else F.coalesce("iso_date", missing_date)
    return d.withColumns({"date": date, "has_description": F.length(T.or_empty(F.col("description"))) > 0})


def time_guard(rows: DataFrame, now: Column, date: str = "date", min_hours: int = 0, max_hours: int = rules.MAX_AGE_HOURS) -> DataFrame:
    """Rows whose age lies between the bounds, both included; rows without a date, or of the epoch, don't pass."""
    d = F.col(date)
    return rows.filter(d.isNotNull() & (d != F.lit("1970-01-01").cast("timestamp_ntz")) & d.between(now - hours(max_hours), now - hours(min_hours)))


def per_source_cap(items: DataFrame, cap: Column, width: int = 100_000) -> DataFrame:
    """All rows with their rank in the source's order of position, and ``keep`` for the first ``cap`` of them."""
    ranked = bucketed_rank(items, ["source"], ["position", "item_id"], F.floor(F.col("position") / width))
    return ranked.withColumn("keep", F.col("rank") <= cap)


def hot_stories(hits: DataFrame, now: Column, min_points: int = rules.HOT_MIN_POINTS) -> DataFrame:
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("story_title"))
    d = hits.withColumn("title", title)
    return d.filter((T.or_empty(F.col("title")) != "") & F.col("url").isNotNull() & (F.col("points") >= min_points) & (F.col("ts") >= now - hours(rules.MAX_AGE_HOURS)))


def trending_rank(repos: DataFrame, now: Column, top: int = rules.TRENDING_TOP, min_stars: int = rules.TRENDING_MIN_STARS, days: int = rules.TRENDING_DAYS) -> DataFrame:
    """Young repositories with enough stars: all with their rank by stars, and ``keep`` for the first ``top``."""
    d = repos.filter((F.col("created_at").cast("date") >= F.date_sub(now.cast("date"), days)) & (F.col("stars") >= min_stars))
    described = F.when(T.or_empty(F.col("description")) != "", F.concat_ws(" — ", "full_name", "description")).otherwise(F.col("full_name"))
    ranked = bucketed_rank(d.withColumn("title", described), [], [F.col("stars").desc(), "full_name"], F.floor(-F.col("stars") / 100))
    return ranked.withColumn("keep", F.col("rank") <= top)


def merge_last_wins(streams: Sequence[DataFrame], key: str) -> DataFrame:
    """Union of streams; of rows with the same key the one of the latest stream stays, in it the last by position."""
    columns = streams[0].columns
    tagged = [s.select(*columns).withColumn("_stream", F.lit(k)) for k, s in enumerate(streams)]
    rest = [c for c in columns if c != key]
    last = reduce(DataFrame.unionByName, tagged).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("_stream", "position")).alias("_row"))
    return last.select(key, "_row.*")


def candidate_union(tech: DataFrame, science: DataFrame, choice: str = "both") -> DataFrame:
    """Rows of the chosen streams (tech, science or both), all of them."""
    chosen = {"tech": [tech], "science": [science], "both": [tech, science]}[choice]
    return reduce(DataFrame.unionByName, chosen)


def route_category(rows: DataFrame, categories: DataFrame, slug: str) -> DataFrame:
    """Adds ``category_id`` for a predicted slug; the category table is a constant of eleven rows, so it is broadcast."""
    names = categories.select(F.col("id").alias("category_id"), F.col("slug").alias("_slug"))
    return rows.join(F.broadcast(names), F.col(slug) == F.col("_slug"), "left").drop("_slug")


def first_per_title(rows: DataFrame, order: str = "position") -> DataFrame:
    """Of a source's rows with the same trimmed lower-case title, the first."""
    rest = [c for c in rows.columns if c != "source"]
    first = rows.groupBy("source", F.lower(T.trim_ws(F.col("title"))).alias("_key")).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return first.select("source", "_row.*")


def insert_ignore(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The rows of ``new`` to append: the first of each key that isn't there yet."""
    rest = [c for c in new.columns if c != key]
    first = new.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_row")).select(key, "_row.*")
    return first.join(existing.select(key).distinct(), key, "left_anti").select(*new.columns)


def collect(
    candidates: DataFrame, known_urls: DataFrame, now: Column, url: str = "link", order: str = "item_id",
    history: DataFrame | None = None, categories: DataFrame | None = None, title_chars: int = rules.MAX_TITLE_CHARS,
) -> DataFrame:
    """Every candidate with its ``decision``, and the fields of the article for those that are inserted.

    Decisions, in this order: ``stale`` (outside the age window or without a date),
    ``url-exists``, ``semantic-title`` (similar to a title of ``history``, a table of
    match_id and title; ``match_id`` and ``similarity`` name the best match),
    ``duplicate-in-batch`` (the URL or a similar title of an earlier row that is
    inserted) and ``inserted``.  Equal to going through the candidates in rising
    ``order``, which must tell them apart.  Science articles get the category of
    their text, if ``categories`` (id, slug, type) has it; titles are clipped.
    """
    d = candidates.withColumn("_story", T.normalize_title(F.col("title")))
    fresh = F.coalesce(F.col("date").between(now - hours(rules.MAX_AGE_HOURS), now), F.lit(False))
    none = {"match_id": F.lit(None).cast("long"), "similarity": F.lit(None).cast("double")}
    stale = d.filter(~fresh).withColumns({"decision": F.lit("stale"), **none})
    if history is None:
        known = known_urls.select(F.col(known_urls.columns[0]).alias(url)).distinct().withColumn("_known", F.lit(True))
        judged = d.filter(fresh).join(known, url, "left").withColumns({"reason": F.when(F.col("_known"), "url-exists").otherwise("unique"), **none}).drop("_known")
    else:
        judged = dedup_against_history(d.filter(fresh), history, known_urls, F.col("_story"), T.normalize_title(F.col("title")), url)
    judged = cut_lineage(judged)
    seen = judged.filter("reason <> 'unique'").withColumnRenamed("reason", "decision")
    new = dedup_in_batch(judged.filter("reason = 'unique'"), order, F.col(url), F.col("_story"))
    new = new.withColumn("decision", F.when(F.col("keep"), "inserted").otherwise("duplicate-in-batch")).drop("reason", "keep")
    decided = reduce(DataFrame.unionByName, [stale, seen, new]).drop("_story")
    return _article_fields(decided, categories, title_chars)


def _article_fields(decided: DataFrame, categories: DataFrame | None, title_chars: int) -> DataFrame:
    """Section, spheres, science field, category and clipped title of the rows to insert; null for all others."""
    d = decided.withColumn("_text", F.when(F.col("decision") == "inserted", C.article_text(F.col("title"), F.col("description"))))
    found = C.classify_article(F.col("_text"))
    d = d.withColumns({"_science": found["is_science"], "science_field": found["science_field"]})
    d = d.withColumn("_invention", F.lower(C.invention_context(F.col("title"), F.col("description"))))
    d = d.withColumn("_counts", F.when(F.col("_science"), C.keyword_counts(F.col("_text"), rules.SCIENCE_RULES)))
    slug = F.when(F.col("_science"), C.classify_science(F.col("_counts"), F.col("source"), F.col("science_field")))
    inserted = F.col("decision") == "inserted"
    d = d.withColumns({
        "is_science": F.when(inserted, F.col("_science")), "section": F.when(inserted, C.section_of(C.is_invention(F.col("_invention")), F.col("_science"))),
        "sphere_tags": F.when(inserted, C.sphere_tags(F.col("_invention"))),
        "stored_title": F.when(inserted, T.clip(F.col("title"), title_chars)), "category_slug": slug,
    })
    if categories is not None:
        d = route_category(d, categories.filter("type = 'science'"), "category_slug")
        d = d.withColumn("category_slug", F.when(F.col("category_id").isNotNull(), F.col("category_slug")))
    return d.drop("_text", "_science", "_invention", "_counts")


def _funnel() -> dict[str, Column]:
    n = lambda *what: F.count_if(F.col("decision").isin(*what))
    return {
        "raw": F.count("*"), "fresh": F.count_if(F.col("decision") != "stale"), "stale_dropped": n("stale"), "inserted": n("inserted"),
        "duplicate_urls": n("url-exists"), "duplicate_titles": n("semantic-title"), "duplicate_in_batch": n("duplicate-in-batch"),
    }


def collect_funnel(decided: DataFrame) -> DataFrame:
    return decided.agg(*[c.alias(name) for name, c in _funnel().items()])


def observed_funnel(decided: DataFrame) -> tuple[DataFrame, Observation]:
    """The rows and an observation that holds the funnel once they have been written, without a second pass.

    Write the returned rows as they are: counts taken before a further shuffle could be taken twice.
    """
    counts = Observation(f"funnel-{uuid.uuid4().hex}")
    return decided.observe(counts, *[c.alias(name) for name, c in _funnel().items()]), counts
