"""Reader-facing listings: filters, paging, search, catalogue, mixed feed."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from newsmill import rules
from newsmill.functions import text as T


def event_time() -> Column:
    return F.coalesce(F.col("platform_published_at"), F.col("updated_at"))


def hours(n: int) -> Column:
    return F.make_dt_interval(hours=F.lit(n))


def freshness_from(key: str | None, now: Column) -> Column | None:
    """Lower bound of a freshness key; ``all`` and unknown keys have none."""
    n = rules.FRESHNESS_HOURS.get(key or "all")
    return None if n is None else now - hours(n)


def query_lexemes(query: str, stop_words: Sequence[str] = rules.SEARCH_STOP_WORDS) -> list[str] | None:
    """Lexemes of a search string; None when the string is blank (filter skipped)."""
    if not query.strip():
        return None
    words = [w for w in re.split(r"[\W_]+", query.lower()) if w]
    return list(dict.fromkeys(w for w in words if w not in stop_words))


def search_text() -> Column:
    return F.concat_ws(
        " ", T.or_empty(F.col("title")), T.or_empty(F.col("summary")),
        T.or_empty(F.col("content")), T.or_empty(F.col("translation")),
    )


def fts_match(query: str, stop_words: Sequence[str] = rules.SEARCH_STOP_WORDS) -> Column:
    """True when every lexeme of the query is a token of the searched text.

    A substring test runs first, so most rows never reach the token test.
    """
    words = query_lexemes(query, stop_words)
    if words is None:
        return F.lit(True)
    if not words:
        return F.lit(False)
    text = F.lower(search_text())
    cond = F.lit(True)
    for w in words:
        token = r"(?<![\p{L}\p{N}])" + re.escape(w) + r"(?![\p{L}\p{N}])"
        cond = cond & text.contains(w) & text.rlike(token)
    return cond


def news_filter(
    news: DataFrame,
    now: Column,
    *,
    is_science: bool | None = None,
    category_slugs: Sequence[str] = (),
    section: str | None = None,
    classification_type: str | None = None,
    freshness: str | None = None,
    search: str | None = None,
) -> DataFrame:
    df = news.filter((F.col("status") == "published") & (event_time() <= now))
    if is_science is not None:
        df = df.filter(F.col("is_science") == is_science)
    if category_slugs:
        df = df.filter(F.col("category_slug").isin(list(category_slugs)))
    if section:
        df = df.filter(F.col("section") == section)
    if classification_type:
        df = df.filter(F.col("classification_type") == classification_type)
    lower = freshness_from(freshness, now)
    if lower is not None:
        df = df.filter(event_time() >= lower)
    if search:
        df = df.filter(fts_match(search))
    return df


def with_category(news: DataFrame, categories: DataFrame) -> DataFrame:
    """Adds ``category_name``; the category table is a constant of eleven rows, so it is broadcast."""
    names = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    return news.join(F.broadcast(names), "category_id", "left")


def news_page(filtered: DataFrame, limit: int = 50, offset: int = 0, after: tuple[Column, int] | None = None) -> DataFrame:
    """One page, newest first; sorting keeps only offset+limit rows per task.

    ``after`` is the (event time, id) of the last row seen: with it, deep pages
    cost no more than the first.
    """
    if after is not None:
        seen_time, seen_id = after
        filtered = filtered.filter((event_time() < seen_time) | ((event_time() == seen_time) & (F.col("id") < seen_id)))
    return filtered.orderBy(event_time().desc(), F.col("id").desc()).offset(offset).limit(limit)


def page_info(filtered: DataFrame, limit: int, offset: int) -> DataFrame:
    return filtered.agg(F.count("*").alias("total")).withColumn(
        "has_more", F.lit(offset + limit) < F.col("total")
    )


def readable(news: DataFrame) -> DataFrame:
    return news.filter((F.col("status") == "published") & F.col("summary").isNotNull() & (F.col("summary") != ""))


def catalog(tools: DataFrame, spheres: Sequence[str] = (), limit: int | None = None, after: tuple[str, int] | None = None) -> DataFrame:
    """Tools with any of the spheres by name and id: all, or a page of ``limit`` after the (name, id) of the last one seen."""
    found = with_any_sphere(tools, spheres)
    if after is not None:
        found = found.filter(F.struct("name", "id") > F.struct(F.lit(after[0]), F.lit(after[1]).cast("bigint")))
    found = found.orderBy("name", "id")
    return found if limit is None else found.limit(limit)


def with_any_sphere(tools: DataFrame, spheres: Sequence[str]) -> DataFrame:
    if not spheres:
        return tools
    return tools.filter(F.arrays_overlap("spheres", F.array(*[F.lit(s) for s in spheres])))


def catalog_sorted(tools: DataFrame, now: Column, freshness: str = "all") -> DataFrame:
    lower = freshness_from(freshness, now)
    fresh = tools if lower is None else tools.filter(F.col("created_at") >= lower)
    return fresh.orderBy(F.col("created_at").desc(), F.col("id").desc())


def distinct_spheres(tools: DataFrame) -> DataFrame:
    return tools.select(F.explode("spheres").alias("sphere")).distinct().orderBy("sphere")


def mixed_feed(news: DataFrame, tools: DataFrame) -> DataFrame:
    """News cards (dated by update) and tool cards (dated by creation) in one list."""
    cards = news.select(
        F.lit("news").alias("kind"), "id", F.col("updated_at").alias("date"), "title", "original_url"
    ).unionByName(
        tools.select(F.lit("tool").alias("kind"), "id", F.col("created_at").alias("date"), F.col("name").alias("title")),
        allowMissingColumns=True,
    )
    return cards.orderBy(F.col("date").desc(), "kind", F.col("id").desc())


def recent_logs(logs: DataFrame, source_id: int | None = None, limit: int = 20) -> DataFrame:
    rows = logs if source_id is None else logs.filter(F.col("source_id") == source_id)
    return rows.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)
