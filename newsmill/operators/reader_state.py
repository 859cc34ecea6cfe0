"""Per-reader state: read marks and favourites.

State tables have no MERGE; each change returns a new snapshot DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsmill import rules
from newsmill.operators.listing import readable


def unread(news: DataFrame, read_status: DataFrame, user_id: int) -> DataFrame:
    seen = read_status.filter((F.col("user_id") == user_id) & F.col("read")).select(F.col("news_id").alias("id"))
    return readable(news).join(seen, "id", "left_anti")


def unread_counts(users: DataFrame, news: DataFrame, read_status: DataFrame) -> DataFrame:
    """Unread totals of every user at once: all readable rows minus the rows read."""
    rows = readable(news).select("id", "section")

    def counts(prefix: str) -> list[Column]:
        per = [F.count_if(F.col("section") == s).alias(prefix + s) for s in rules.SECTIONS]
        return [F.count("*").alias(prefix + "total"), *per]

    everything = rows.agg(F.struct(*counts("")).alias("all")).scalar()
    # both sides arrive unaggregated, so adaptive execution can split the marks of an article that very many have read
    seen = read_status.filter("read").select("user_id", F.col("news_id").alias("id")).join(rows, "id")
    per_user = seen.groupBy("user_id").agg(*counts("n_"))
    out = users.select(F.col("id").alias("user_id")).join(per_user, "user_id", "left")
    names = {"total": "unread_total", **{s: "unread_" + s.replace("-", "_") for s in rules.SECTIONS}}
    return out.select(
        "user_id",
        *[(everything[k] - F.coalesce(F.col(f"`n_{k}`"), F.lit(0))).alias(v) for k, v in names.items()],
    )


def with_read_flag(news: DataFrame, read_status: DataFrame, user_id: int) -> DataFrame:
    mine = read_status.filter(F.col("user_id") == user_id).select(F.col("news_id").alias("id"), "read")
    return news.join(mine, "id", "left").withColumn("read", F.coalesce("read", F.lit(False)))


def mark_all_read(news: DataFrame, read_status: DataFrame, user_id: int, now: Column) -> DataFrame:
    mine = read_status.filter(F.col("user_id") == user_id)
    fresh = readable(news).select(F.col("id").alias("news_id")).join(mine.select("news_id"), "news_id", "left_anti")
    added = fresh.select(
        F.lit(user_id).cast("bigint").alias("user_id"), "news_id", F.lit(True).alias("read"), now.alias("read_at")
    )
    turn = (F.col("user_id") == user_id) & ~F.col("read")
    kept = read_status.withColumn("read_at", F.when(turn, now).otherwise(F.col("read_at"))).withColumn(
        "read", F.col("read") | (F.col("user_id") == user_id)
    )
    return kept.unionByName(added)


def mark_read(read_status: DataFrame, marks: DataFrame, now: Column) -> DataFrame:
    """Upsert ``marks(user_id, news_id)`` as read; rows already read keep their time."""
    m = marks.select("user_id", "news_id").distinct().withColumn("_m", F.lit(True))
    out = read_status.join(m, ["user_id", "news_id"], "full_outer")
    change = F.col("_m").isNotNull() & ~F.coalesce("read", F.lit(False))
    return out.select(
        "user_id", "news_id",
        (F.coalesce("read", F.lit(False)) | change).alias("read"),
        F.when(change, now).otherwise(F.col("read_at")).alias("read_at"),
    )


def mark_unread(read_status: DataFrame, marks: DataFrame) -> DataFrame:
    """Only existing rows change: read becomes false and the time is cleared."""
    m = marks.select("user_id", "news_id").distinct().withColumn("_m", F.lit(True))
    out = read_status.join(m, ["user_id", "news_id"], "left")
    hit = F.col("_m").isNotNull()
    return out.select(
        "user_id", "news_id", (F.col("read") & ~hit).alias("read"),
        F.when(~hit, F.col("read_at")).alias("read_at"),
    )


def favorites_list(favorites: DataFrame, news: DataFrame, user_id: int) -> DataFrame:
    mine = favorites.filter(F.col("user_id") == user_id).select(
        F.col("news_id").alias("id"), F.col("created_at").alias("favorited_at")
    )
    return mine.join(news, "id").select(
        "favorited_at", F.struct(*[F.col(c) for c in news.columns]).alias("news")
    ).orderBy(F.col("favorited_at").desc(), F.col("news.id").desc())


def add_favorites(favorites: DataFrame, pairs: DataFrame, now: Column) -> DataFrame:
    new = pairs.select("user_id", "news_id").distinct().join(favorites, ["user_id", "news_id"], "left_anti")
    return favorites.unionByName(new.withColumn("created_at", now))


def remove_favorites(favorites: DataFrame, pairs: DataFrame) -> DataFrame:
    return favorites.join(pairs, ["user_id", "news_id"], "left_anti")


def favorite_check(favorites: DataFrame, pairs: DataFrame) -> DataFrame:
    have = favorites.select("user_id", "news_id").withColumn("is_favorite", F.lit(True))
    return pairs.join(have, ["user_id", "news_id"], "left").withColumn(
        "is_favorite", F.coalesce("is_favorite", F.lit(False))
    )


def count_per_user(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("user_id").agg(F.count("*").alias(name))
