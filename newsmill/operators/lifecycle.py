"""Article and catalogue life cycle: snapshots, states, quarantine, publication batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsmill import rules
from newsmill.functions import text as T
from newsmill.operators.listing import hours


def upsert(existing: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """New snapshot: ``columns`` of rows with a known key are overwritten, other rows of ``new`` are added; both are unique by key."""
    fresh = new.select(key, *[F.col(c).alias(f"_new_{c}") for c in new.columns if c != key], F.lit(True).alias("_hit"))
    d = existing.withColumn("_old", F.lit(True)).join(fresh, key, "full_outer")

    def value(c: str) -> Column:
        if c == key or c not in new.columns:
            return F.col(c)
        take = F.col("_hit") if c in columns else F.col("_hit") & F.col("_old").isNull()
        return F.when(take, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)

    return d.select(*[value(c) for c in existing.columns])


def with_tool_errors(tools: DataFrame) -> DataFrame:
    """Adds ``errors``: every catalogue rule that the row breaks, in the order of the rules."""
    blank = lambda c: T.is_blank(F.col(c))
    broken = {
        "slug": blank("slug"), "name": blank("name"), "kind": blank("kind"),
        "spheres": F.col("spheres").isNull() | (F.size("spheres") == 0), "description": blank("description"),
        "official_url": ~F.coalesce(F.col("official_url").rlike(r"(?i)^https?://\S+$"), F.lit(False)),
    }
    return tools.withColumn("errors", F.array_compact(F.array(*[F.when(when, F.lit(name)) for name, when in broken.items()])))


def set_status(news: DataFrame, ids: DataFrame, status: str, now: Column) -> DataFrame:
    """New snapshot with the state of the rows in ``ids`` (id) changed; publishing also stamps the platform's time."""
    d = news.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    hit = F.col("_hit").isNotNull()
    changed = {"status": F.when(hit, status).otherwise(F.col("status")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}
    if status == "published":
        changed["platform_published_at"] = F.when(hit, now).otherwise(F.col("platform_published_at"))
    return d.withColumns(changed).select(*news.columns)


PURGED = ("pending", "summarized", "translated", "published")


def purge(news: DataFrame, statuses: Sequence[str] = PURGED) -> DataFrame:
    """Rows that a purge leaves; rejected ones stay as memory of what was seen."""
    return news.filter(~F.col("status").isin(*statuses))


def purge_report(news: DataFrame, statuses: Sequence[str] = PURGED) -> DataFrame:
    return news.groupBy("status").agg(F.count("*").alias("n")).withColumn("purged", F.col("status").isin(*statuses))


def refresh_stamp(tools: DataFrame, now: Column) -> DataFrame:
    return tools.withColumn("last_verified_at", now)


SOURCE_CONFIG = {"rss": "feedUrl", "google_news": "feedUrl", "api": "paths", "html": "selector"}


def add_sources(sources: DataFrame, new: DataFrame) -> DataFrame:
    """New snapshot with the rows of ``new`` (id, name, url, type) appended, enabled, under their type's default setting."""
    setting = F.create_map(*[F.lit(x) for pair in SOURCE_CONFIG.items() for x in pair])[F.col("type")]
    known = sources.withColumn("setting", setting)
    return known.unionByName(new.withColumns({"enabled": F.lit(True), "setting": setting}).select(*known.columns))


def toggle_sources(sources: DataFrame, ids: DataFrame) -> DataFrame:
    d = sources.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return d.withColumn("enabled", F.col("enabled") != F.col("_hit").isNotNull()).select(*sources.columns)


def recoverable(news: DataFrame, inserted: DataFrame, now: Column) -> DataFrame:
    """Rows of the day before yesterday's end that lost to the daily cap or were never scored, less those inserted since."""
    lost = (F.col("status") == "rejected") & (F.get_json_object("metrics", "$.decision") == "rejected-daily-cap")
    unscored = (F.col("status") == "pending") & F.col("score").isNull()
    d = news.filter(F.col("published_at").between(now - hours(48), now - hours(24)) & (lost | unscored))
    return d.join(inserted.select("id"), "id", "left_anti")


def work_queue(news: DataFrame, stage: str, science: bool | None = None) -> DataFrame:
    """All rows a stage has to work on, newest first; a caller may page."""
    todo = {
        "summarize": (F.col("status") == "pending") & F.col("content").isNull(), "translate": F.col("status") == "summarized",
        "deploy": F.col("status") == "translated",
    }[stage]
    d = news.filter(todo if science is None else todo & (F.col("is_science") == science))
    return d.orderBy(F.col("published_at").desc(), F.col("id").desc())


def publishable_by_section(news: DataFrame) -> DataFrame:
    d = news.filter((F.col("status") == "summarized") & (T.or_empty(F.col("summary")) != ""))
    return d.groupBy("section").agg(F.count("*").alias("n"))


def proportional_batch(news: DataFrame, target: int = rules.DAILY_PUBLISH_TARGET) -> DataFrame:
    """(id, section) of the next batch: sections by their share of what can be published, at least one each, ``target`` in all.

    The lowest ids of each section go first and sections follow each other by
    name.  Only ``target`` rows of a section are ever ranked.
    """
    ready = news.filter((F.col("status") == "summarized") & (T.or_empty(F.col("summary")) != "")).select("id", "section")
    shares = ready.groupBy("section").agg(F.count("*").alias("n"))
    total = ready.agg(F.count("*")).scalar()
    share = F.least(F.col("n"), F.greatest(F.lit(1), F.bround(target * F.col("n") / total, 0).cast("bigint")))
    shares = shares.select("section", share.alias("share"))
    few = ready.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(64)))
    local = Window.partitionBy("section", "_part").orderBy("id")
    few = few.withColumn("_n", F.row_number().over(local)).filter(F.col("_n") <= target).select("id", "section")
    few = few.withColumn("_n", F.row_number().over(Window.partitionBy("section").orderBy("id")))
    return few.join(F.broadcast(shares), "section").filter(F.col("_n") <= F.col("share")).orderBy("section", "id").limit(target).select("id", "section")


def backfill_report(news: DataFrame) -> DataFrame:
    video = F.col("source").startswith("youtube-")
    n = lambda when: F.count_if(F.coalesce(when, F.lit(False)))
    return news.agg(
        F.count("*").alias("total"), *[n(F.col("status") == s).alias(s) for s in ("pending", "summarized", "rejected", "published")],
        n((F.col("status") == "published") & ~video).alias("published_text"), n((F.col("status") == "published") & video).alias("published_video"),
    )


def failure_policy(failures: DataFrame, attempts: int = rules.MAX_CONTENT_ATTEMPTS) -> DataFrame:
    """Per article and stage: attempts, last reason and time, and whether the article is rejected."""
    last = F.max_by("reason", F.struct("ts", "event_id"))
    d = failures.groupBy("article_id", "stage").agg(
        F.count("*").alias("attempts"), last.alias("last_reason"), F.max("ts").alias("last_at"),
        F.bool_or(F.col("is_youtube") & (F.col("stage") == "fetch") & (F.col("reason") == "youtube-transcript-unavailable")).alias("_hopeless"),
    )
    reject = (F.col("stage").isin("fetch", "extract") & (F.col("attempts") >= attempts)) | F.col("_hopeless")
    return d.withColumn("reject", reject).drop("_hopeless")
