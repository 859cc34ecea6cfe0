"""Source health, failures and progress as keyed state of a stream.

State lives in the stream's RocksDB store, one entry for each key, and its
checkpoint survives a restart.  A micro-batch reads only its own rows and emits
the keys that it changed; these are appended to the table of states under a
commit record, so a batch that runs again adds nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampNTZType

from newsmill.operators import health as H, lifecycle as Y
from newsmill.sources.commits import publish, records

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Keep state in RocksDB, beyond executor heaps; streams take the setting when they start."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def keep_states(changed: DataFrame, out: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    """Appends the changed keys of each micro-batch to the states at ``out``."""

    def one(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        folder = f"{out}/batch-{uuid.uuid4().hex}"
        batch.write.parquet(folder)
        publish(spark, f"{out}/commits", str(batch_id), folder)

    use_state_store(changed.sparkSession)
    return changed.writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def states(spark: SparkSession, out: str, schema: StructType, keys: Sequence[str]) -> DataFrame:
    """The last committed state of each key."""
    rows = spark.createDataFrame([], schema).withColumn("_batch", F.lit(0).cast("long"))
    for batch_id, folder in records(spark, f"{out}/commits").items():
        rows = rows.unionAll(spark.read.schema(schema).parquet(folder).withColumn("_batch", F.lit(int(batch_id)).cast("long")))
    rest = [f.name for f in schema if f.name not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_row"))
    return last.select(*keys, "_row.*").select(*schema.names)


def failure_policy_stream(failures: DataFrame, out: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    """Attempts and verdict of each article and stage; counts, latest and any are state that Spark's own aggregation keeps."""
    return keep_states(Y.failure_policy(failures), out, checkpoint, trigger)


def progress_stream(reports: DataFrame, out: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    """What each stage of each processing cycle reported last."""
    return keep_states(H.cycle_stages(reports), out, checkpoint, trigger)


_TYPES = {"long": LongType(), "double": DoubleType(), "string": StringType(), "time": TimestampNTZType()}


def _struct(**types: str) -> StructType:
    return StructType([StructField(name, _TYPES[kind]) for name, kind in types.items()])


HEALTH = _struct(
    source_id="long", status="string", last_checked_at="time", last_success_at="time", success_rate="double",
    avg_response_ms="double", last_error="string", n_checks="long", consecutive_fails="long",
)
_FIGURES = _struct(
    n_checks="long", n_accessible="long", response_sum="double", n_responses="long", status="string", at_ts="time", at_id="long",
    healthy_ts="time", healthy_id="long", error="string", error_ts="time", error_id="long", fails="long",
)
_START = (0, 0, 0.0, 0, None, None, None, None, None, None, None, None, 0)


def _later(a: tuple, b: tuple) -> bool:
    """Whether the time and id of ``a`` come after those of ``b``; None comes before all."""
    return a[0] is not None and (b[0] is None or a > b)


class SourceHealth(StatefulProcessor):
    """The figures of a source, and its failing checks since the last healthy one.

    Rows may come in any order, within a batch and across batches.  A failing check
    is kept by its time and id while no later healthy one is known, so that a healthy
    check that comes late takes away just the fails before it; a recovery empties the map.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.figures = handle.getValueState("figures", _FIGURES)
        self.failing = handle.getMapState("failing", _struct(ts="time", event_id="long"), _struct(status="string"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, accessible, total, responses, status, at_ts, at_id, ok_ts, ok_id, error, error_ts, error_id, fails = self.figures.get() if self.figures.exists() else _START
        at, healthy, failed = (at_ts, at_id), (ok_ts, ok_id), (error_ts, error_id)
        before = healthy
        for part in rows:
            for r in part.itertuples(index=False):
                here = (r.ts.to_pydatetime() if isinstance(r.ts, pd.Timestamp) else r.ts, int(r.event_id))
                n, accessible = n + 1, accessible + bool(r.accessible)
                if not pd.isna(r.response_ms):
                    total, responses = total + float(r.response_ms), responses + 1
                if _later(here, at):
                    at, status = here, r.status
                if not pd.isna(r.error) and _later(here, failed):
                    failed, error = here, r.error
                if r.status == "healthy":
                    healthy = here if _later(here, healthy) else healthy
                elif _later(here, healthy):
                    self.failing.updateValue(here, (r.status,))
                    fails += 1
        if healthy != before:
            old = [k for k in self.failing.keys() if not _later((k[0], k[1]), healthy)]
            for k in old:
                self.failing.removeKey(k)
            fails -= len(old)
        self.figures.update((n, accessible, total, responses, status, *at, *healthy, error, *failed, fails))
        yield pd.DataFrame({
            "source_id": [key[0]], "status": [status], "last_checked_at": [at[0]], "last_success_at": [healthy[0]], "success_rate": [accessible / n],
            "avg_response_ms": [total / responses if responses else None], "last_error": [error], "n_checks": [n], "consecutive_fails": [fails],
        })

    def close(self) -> None:
        pass


def source_health_stream(checks: DataFrame, out: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    """Health of each source after every micro-batch of its checks; needs ``use_state_store`` before it starts, which it calls."""
    use_state_store(checks.sparkSession)
    d = checks.withColumn("status", H.check_status()).select("source_id", "ts", "event_id", "accessible", "response_ms", "error", "status")
    changed = d.groupBy("source_id").transformWithStateInPandas(SourceHealth(), HEALTH, "Update", "None")
    return keep_states(changed, out, checkpoint, trigger)
