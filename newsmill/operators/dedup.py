"""Duplicate stories: similar titles, memory of the past, and greedy choice inside a batch."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from newsmill import rules
from newsmill.operators import similar as S
from newsmill.session import cut_lineage, ship_package

#: A tile holds keys of at least and at most so many letters, each key counting ``_KEY_COST`` besides; tables between are cut into ``_TILES``.
_TILE_LETTERS, _TILES, _KEY_COST = (1 << 16, 1 << 24), 32, 200


def _tiling(lengths: list[tuple[int, int]], percent: int, two_sides: bool) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Of rising (length, number of keys): (length, first tile, tiles), a crowded length having several; and (pair, tile, tile) to be compared, those of most work first."""
    cost = lambda n, keys: keys * (n + _KEY_COST)
    size = min(max(sum(cost(*x) for x in lengths) // _TILES, _TILE_LETTERS[0]), _TILE_LETTERS[1])
    places, bounds, room = [], [], 0
    for n, keys in lengths:
        parts = -(-cost(n, keys) // size)
        if parts > 1 or not bounds or cost(n, keys) > room:
            places.append((n, len(bounds), parts))
            bounds += [[n, n, keys / parts] for _ in range(parts)]
            room = 0 if parts > 1 else size - cost(n, keys)
        else:
            places.append((n, len(bounds) - 1, 1))
            bounds[-1][1] = n
            bounds[-1][2] += keys
            room -= cost(n, keys)
    pairs = []
    for i, (_, longest, _) in enumerate(bounds):
        for j in range(i, len(bounds)):
            if bounds[j][0] - longest > S.budget(bounds[j][0], percent):
                break
            pairs += [(i, j)] if i == j or not two_sides else [(i, j), (j, i)]
    work = lambda i, j: bounds[i][2] * bounds[j][2] * bounds[j][1] / (2 if i == j and not two_sides else 1)
    pairs.sort(key=lambda p: -work(*p))
    return places, [(k, i, j) for k, (i, j) in enumerate(pairs)]


def _near_keys(left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """(left_key, right_key, distance) of the different keys (n, key) within the budget; of one table's pairs each once."""
    spark, one = left.sparkSession, left is right
    lengths = (left if one else left.unionAll(right)).groupBy("n").count().orderBy("n").collect()  # a row for each length that occurs
    places, pairs = _tiling([tuple(r) for r in lengths], percent, not one)
    place = F.broadcast(spark.createDataFrame(places, "n int, first int, parts int"))
    pair = spark.createDataFrame(pairs, "pair int, a int, b int")
    ship_package(spark)

    def dealt(keys: DataFrame, side: str) -> DataFrame:
        tiled = keys.join(place, "n").select((F.col("first") + F.pmod(F.xxhash64("key"), F.col("parts"))).cast("int").alias(side), "key")
        return tiled.join(F.broadcast(pair), side).select("pair", F.lit(side).alias("side"), (F.lit(one) & (F.col("a") == F.col("b"))).alias("own"), "key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, own = {"a": [], "b": []}, False
        for batch in batches:
            own = own or batch.column("own")[0].as_py()
            for side, key in zip(batch.column("side").to_pylist(), batch.column("key").to_pylist(), strict=True):
                sides[side].append(key)
        if sides["a"] and (own or sides["b"]):
            x = S.Tile(sides["a"])
            for left, right, distance in S.near_pairs(x, x if own else S.Tile(sides["b"]), percent):
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(distance, pa.int32())], ["left_key", "right_key", "distance"])

    # little data and much work: a partition for each pair of tiles, not as the bytes ask for, and the longest tasks first
    rows = dealt(left, "a").unionAll(dealt(right, "b").filter("not own")).repartitionById(max(1, len(pairs)), "pair")
    return rows.groupBy("pair").applyInArrow(compare, "left_key string, right_key string, distance int")


def similar_keys(left: DataFrame, right: DataFrame, percent: int = rules.SIMILARITY_PERCENT) -> DataFrame:
    """(left_key, right_key, similarity) of the distinct keys whose edit similarity is at least ``percent``.

    Exact.  Titles are collapsed to distinct keys, laid into tiles by length; tiles
    whose lengths allow it are compared, each pair of them in one task of bounded
    size.  Signatures drop nearly all pairs of keys, an edit distance that stops at
    the budget decides the others.  Keys shorter than six characters only match
    themselves.  Equal keys match by a join of their own.
    """

    def keyed(d: DataFrame) -> DataFrame:
        d = cut_lineage(d.select(F.col(d.columns[0]).alias("key")).distinct())  # a filter below would make each key twice
        return d.filter("key <> ''").select(F.length("key").alias("n"), "key")

    same_side = left is right
    a = keyed(left)
    b = a if same_side else keyed(right)
    long = a.filter("n >= 6")
    near = _near_keys(long, long if same_side else b.filter("n >= 6"), percent)
    if same_side:
        near = near.select("distance", F.explode(F.array(F.struct("left_key", "right_key"), F.struct(F.col("right_key").alias("left_key"), F.col("left_key").alias("right_key")))).alias("p"))
        near = near.select("p.*", "distance")
    near = near.select("left_key", "right_key", (1 - F.col("distance") / F.greatest(F.length("left_key"), F.length("right_key"))).alias("similarity"))
    near = near.filter(F.col("similarity") * 100 >= percent)
    same = a.join(b.select("key"), "key").select(F.col("key").alias("left_key"), F.col("key").alias("right_key"), F.lit(1.0).alias("similarity"))
    return near.unionAll(same)


def history_titles(news: DataFrame, lookback: int | None = None) -> DataFrame:
    """(match_id, title): original titles, all of them or the newest ``lookback``."""
    d = news.select(F.col("id").alias("match_id"), F.coalesce("original_title", "title").alias("title"), "created_at")
    if lookback is not None:
        d = d.orderBy(F.col("created_at").desc(), F.col("match_id").desc()).limit(lookback)
    return d.select("match_id", "title")


def dedup_against_history(candidates: DataFrame, history: DataFrame, known_urls: DataFrame, key: Column, history_key: Column, url: str = "url") -> DataFrame:
    """Adds ``reason`` (url-exists, semantic-title, unique), ``match_id`` and ``similarity`` by the whole history.

    The best match is the most similar title, of equals the smallest id.
    """
    c = candidates.withColumn("_key", key)
    h = cut_lineage(history.withColumn("_hkey", history_key).groupBy("_hkey").agg(F.min("match_id").alias("match_id")))  # used twice
    pairs = similar_keys(c.select("_key"), h.select("_hkey")).join(h, F.col("right_key") == F.col("_hkey"))
    best = pairs.groupBy(F.col("left_key").alias("_key")).agg(F.max_by(F.struct("match_id", "similarity"), F.struct("similarity", -F.col("match_id"))).alias("_best"))
    known = known_urls.select(F.col(known_urls.columns[0]).alias(url)).distinct().withColumn("_known", F.lit(True))
    d = c.join(known, url, "left").join(best, "_key", "left")
    seen = F.col("_known").isNotNull()
    reason = F.when(seen, "url-exists").when(F.col("_best").isNotNull(), "semantic-title").otherwise("unique")
    return d.withColumns({
        "reason": reason, "match_id": F.when(~seen, F.col("_best.match_id")), "similarity": F.when(~seen, F.col("_best.similarity")),
    }).drop("_key", "_known", "_best")


def _swept(order: list, url: list, title: list, left: list, right: list) -> list:
    """Of rows in rising order, those that stay; ``left`` and ``right`` name pairs of similar titles."""
    near: dict = {}
    for a, b in zip(left, right, strict=True):
        near.setdefault(a, []).append(b)
    urls, titles, kept = set(), set(), []
    for n, u, t in zip(order, url, title, strict=True):
        if (u and u in urls) or (t and (t in titles or any(x in titles for x in near.get(t, ())))):
            continue
        kept.append(n)
        urls.add(u)
        titles.add(t)
    return kept


def dedup_in_batch(rows: DataFrame, order: str, url_key: Column, title_key: Column, sweep_rows: int = 200_000) -> DataFrame:
    """Adds ``keep``: rows in rising ``order`` stay unless an earlier kept one has the same URL or a similar title.

    ``order`` must tell rows apart.  Only the earliest row of each (URL, title)
    is looked at, as the others share all its conflicts.  In a round the rows
    that come first among all they conflict with are kept; they and their
    conflicts leave the state, which holds digests only.  Minima per URL, per
    title and over similar titles find them, so no pairs of rows are formed.
    Once at most ``sweep_rows`` undecided rows and as many pairs of similar titles
    are left, a single task goes through them in order, so a chain of conflicts
    ends as well; the rounds alone give the same result.
    """
    digest = lambda k: F.when(k.isNotNull() & (k != ""), F.md5(k))
    d = cut_lineage(rows.select("*", digest(url_key).alias("_url"), title_key.alias("_key"), digest(title_key).alias("_title")))
    titles = d.select("_key")
    pairs = similar_keys(titles, titles).filter("left_key <> right_key").select(F.md5("left_key").alias("left"), F.md5("right_key").alias("right"))
    free = F.col("_url").isNull() & F.col("_title").isNull()
    live = cut_lineage(d.filter(~free).groupBy("_url", "_title").agg(F.min(order).alias("_n")))
    pairs, kept = cut_lineage(pairs), []
    n_pairs = pairs.count()
    while n := live.count():
        if max(n, n_pairs) <= sweep_rows:
            kept.append(_sweep(live, pairs))
            break
        per_url = live.filter("_url is not null").groupBy("_url").agg(F.min("_n").alias("_by_url"))
        per_title = live.filter("_title is not null").groupBy("_title").agg(F.min("_n").alias("_by_title"))
        near = pairs.join(per_title, F.col("right") == F.col("_title")).groupBy(F.col("left").alias("_title")).agg(F.min("_by_title").alias("_by_near"))
        j = live.join(per_url, "_url", "left").join(per_title, "_title", "left").join(near, "_title", "left")
        least = F.least(*[F.coalesce(c, "_n") for c in ("_by_url", "_by_title", "_by_near")])
        stay = cut_lineage(j.filter(least == F.col("_n")).select("_url", "_title", "_n"))
        kept.append(stay.select("_n"))
        gone_titles = stay.select("_title").unionAll(pairs.join(stay, F.col("left") == F.col("_title")).select("right")).distinct()
        live = cut_lineage(live.join(stay.select("_url").distinct(), "_url", "left_anti").join(gone_titles, "_title", "left_anti"))
        left = live.select(F.col("_title").alias("left")).distinct()
        pairs = cut_lineage(pairs.join(left, "left", "left_semi").join(left.withColumnRenamed("left", "right"), "right", "left_semi").select("left", "right"))
        n_pairs = pairs.count()
    if not kept:
        return d.select(*rows.columns, F.lit(True).alias("keep"))
    stays = reduce(DataFrame.unionAll, kept).select(F.col("_n").alias(order), F.lit(True).alias("_stays"))
    return d.join(stays, order, "left").select(*rows.columns, (free | F.col("_stays").isNotNull()).alias("keep"))


def _sweep(live: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows that stay of a state whose size the caller has checked."""
    kind = live.schema["_n"].dataType
    ship_package(live.sparkSession)

    def sweep(rows: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_n")
        cells = lambda c: [x if isinstance(x, str) else None for x in rows[c]]
        return pd.DataFrame({"_n": _swept(rows["_n"].tolist(), cells("_url"), cells("_title"), links["left"].tolist(), links["right"].tolist())})

    one = F.lit(1).alias("_one")
    return live.groupBy(one).cogroup(pairs.groupBy(one)).applyInPandas(sweep, StructType([StructField("_n", kind)]))
