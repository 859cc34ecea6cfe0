"""Ordered look-backs and joins that stay balanced when one key, or none, is very frequent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def left_join_known(df: DataFrame, other: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Left join on ``key`` that doesn't send all rows of ``df`` without one to one task.

    These rows meet nothing; they are dealt by the hash of their columns ``by``, the
    others by that of the key.  (With a constant in its place Spark leaves the second
    column out of the join's keys.)
    """
    spread = F.when(F.col(key).isNull(), F.xxhash64(*by)).otherwise(F.xxhash64(key))
    known = other.withColumn("_spread", F.xxhash64(key))
    return df.withColumn("_spread", spread).join(known, [key, "_spread"], "left").drop("_spread")


def bucketed_previous(df: DataFrame, key: str, order: list[str], bucket: Column, value: str, name: str) -> DataFrame:
    """``lag(value)`` per key without sending a whole key to one task.

    ``bucket`` must grow with ``order`` inside a key.  Rows are ordered only
    inside (key, bucket); the first row of a bucket takes the last value of the
    bucket before it, found on the much smaller table of bucket ends.
    """
    d = df.withColumn("_bucket", bucket)
    inside = Window.partitionBy(key, "_bucket").orderBy(*order)
    d = d.withColumns({name: F.lag(value).over(inside), "_first": F.row_number().over(inside) == 1})
    ends = d.groupBy(key, "_bucket").agg(F.max_by(value, F.struct(*order)).alias("_end"))
    ends = ends.select(
        key, "_bucket", F.lag("_end").over(Window.partitionBy(key).orderBy("_bucket")).alias("_before")
    )
    out = d.join(ends, [key, "_bucket"], "left")
    return out.withColumn(name, F.when(F.col("_first"), F.col("_before")).otherwise(F.col(name))).drop(
        "_bucket", "_first", "_before"
    )


def bucketed_rank(df: DataFrame, keys: list[str], order: list, bucket: Column, name: str = "rank") -> DataFrame:
    """1-based rank per key without sending a whole key to one task.

    ``bucket`` must not fall along ``order`` inside a key.  Rows are ranked inside
    (key, bucket); the rows of earlier buckets come from the small table of
    bucket sizes.
    """
    d = df.withColumn("_bucket", bucket)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    sizes = d.groupBy(*keys, "_bucket").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    d = d.withColumn("_inside", F.row_number().over(inside))
    d = d.join(sizes, [*keys, "_bucket"]).withColumn(name, (F.col("_before") + F.col("_inside")).cast("bigint"))
    return d.drop("_bucket", "_inside", "_before")
