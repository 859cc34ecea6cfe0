"""Continuous forms of collection; each agrees with its batch twin once the stream has ended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from newsmill import rules
from newsmill.operators import collect as K
from newsmill.operators.listing import hours
from newsmill.sources.url_memory import UrlMemory


def time_guard(stream: DataFrame, now: Column, date: str = "date", max_hours: int = rules.MAX_AGE_HOURS) -> DataFrame:
    """The batch guard with the maximum age as the watermark, so state of older rows is dropped."""
    guarded = K.time_guard(stream, now, date, max_hours=max_hours)
    return guarded.withColumn("_event_time", F.col(date).cast("timestamp")).withWatermark("_event_time", f"{max_hours} hours")


def first_per_url(guarded: DataFrame, url: str = "link") -> DataFrame:
    """One row per URL within the watermark; what lies further back is the durable table's business (``collect_stream``)."""
    return guarded.dropDuplicatesWithinWatermark([url])


def collect_stream(candidates: DataFrame, memory: str, checkpoint: str, now: Column, trigger: dict, url: str = "link", order: str = "item_id", title_hours: int = 2 * rules.MAX_AGE_HOURS) -> StreamingQuery:
    """Collects each micro-batch against the URL memory at ``memory`` and appends all decisions to it.

    Only URLs that the memory's sketch may hold meet its rows.  Titles are compared
    with those of the rows inserted in earlier batches whose date lies at most
    ``title_hours`` back, so what a batch reads doesn't grow with the stream's life.  A batch is committed
    under its id, so one that runs again after a failure adds nothing and never
    meets its own rows.  ``trigger`` is what writeStream.trigger takes, such as
    {"processingTime": "5 minutes"}.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        seen = UrlMemory(batch.sparkSession, memory, url)
        if seen.holds(batch_id):
            return
        past = seen.rows()
        if past is not None:
            recent = (F.col("decision") == "inserted") & (F.col("date") >= now - hours(title_hours))
            past = past.filter(recent).select(F.col(order).alias("match_id"), "title")
        seen.append(batch_id, K.collect(batch, seen.known(batch.select(url)), now, url, order, history=past), F.col("decision") == "inserted")

    return candidates.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**trigger).start()
