"""Typed, partitioned tables whose versions become visible by commit records.

``KeyedTable`` holds rows that are unique by a key, in buckets by the key's
hash; a change rewrites the buckets of the keys that it names and no others.
``DayTable`` holds logs by day.  Rows are written under an attempt that nobody
reads; the record committed last names the attempts that make up the table, so
a write that is cut short, or that breaks a constraint, leaves the table as it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from newsmill.sources.commits import latest, publish, records


@dataclass(frozen=True)
class Spec:
    """Columns (DDL; NOT NULL is enforced), key, checks by name, and defaults of columns that rows don't bring."""

    ddl: str
    key: tuple[str, ...]
    checks: Mapping[str, str] = field(default_factory=dict)
    defaults: Mapping[str, str] = field(default_factory=dict)

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(self.ddl)


NEWS = Spec(
    "id BIGINT NOT NULL, title STRING, summary STRING, content STRING, original_content STRING, translation STRING, original_url STRING NOT NULL, "
    "original_title STRING, source STRING NOT NULL, category_id BIGINT, category_slug STRING, tags STRING, image_url STRING, published_at TIMESTAMP_NTZ NOT NULL, "
    "is_science BOOLEAN NOT NULL, science_field STRING, classification_type STRING, section STRING NOT NULL, sphere_tags ARRAY<STRING> NOT NULL, "
    "digest_archive_sent_at TIMESTAMP_NTZ, platform_published_at TIMESTAMP_NTZ, language STRING, score INT, metrics STRING, status STRING NOT NULL, "
    "model_used STRING, created_at TIMESTAMP_NTZ NOT NULL, updated_at TIMESTAMP_NTZ NOT NULL",
    ("id",), {"original_url_http": "original_url rlike '^https?://'"},
    {"is_science": "false", "section": "'ai-news'", "sphere_tags": "array()", "status": "'pending'"},
)
READ_STATUS = Spec("user_id BIGINT NOT NULL, news_id BIGINT NOT NULL, read BOOLEAN NOT NULL, read_at TIMESTAMP_NTZ", ("user_id", "news_id"), defaults={"read": "false"})
FAVORITES = Spec("user_id BIGINT NOT NULL, news_id BIGINT NOT NULL, created_at TIMESTAMP_NTZ NOT NULL", ("user_id", "news_id"))
PARSING_LOGS = Spec(
    "id BIGINT NOT NULL, source_id BIGINT NOT NULL, status STRING NOT NULL, articles_found INT, articles_new INT, error_message STRING, created_at TIMESTAMP_NTZ NOT NULL",
    ("id",), defaults={"articles_found": "0", "articles_new": "0"},
)


def conform(rows: DataFrame, spec: Spec) -> DataFrame:
    """The spec's columns, typed; other columns go, absent ones take their default or null.  A row that breaks a constraint fails the job that reads it."""
    schema = spec.schema

    def value(name: str) -> Column:
        return F.col(f"`{name}`") if name in rows.columns else F.expr(spec.defaults.get(name, "null"))

    d = rows.select(*[value(f.name).cast(f.dataType).alias(f.name) for f in schema])
    rules = {f"{f.name} is null": F.col(f.name).isNotNull() for f in schema if not f.nullable}
    rules |= {f"check {name}": F.coalesce(F.expr(sql), F.lit(True)) for name, sql in spec.checks.items()}
    first = schema[0]
    guarded = F.col(first.name)
    for name, holds in rules.items():
        guarded = F.when(holds, guarded).otherwise(F.raise_error(F.lit(f"constraint: {name}")).cast(first.dataType))
    return d.withColumn(first.name, guarded)


class _Attempts:
    """Folders rows/<part>=<value>/attempt=<id>, of which readers name those they take."""

    def __init__(self, spark: SparkSession, folder: str, spec: Spec, part: str, part_type):
        self.spark, self.folder, self.spec, self.part = spark, folder, spec, part
        schema = spec.schema
        for f in schema:
            f.nullable = True
        self.schema = schema.add(part, part_type).add("attempt", StringType())

    def write(self, rows: DataFrame) -> tuple[str, list[str]]:
        """(attempt, its parts); ``rows`` have the spec's columns and the part."""
        attempt = uuid.uuid4().hex
        rows.withColumn("attempt", F.lit(attempt)).write.mode("append").partitionBy(self.part, "attempt").parquet(f"{self.folder}/rows")
        pattern = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/rows/{self.part}=*/attempt={attempt}")
        found = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(pattern)
        return attempt, sorted(s.getPath().getParent().getName().split("=", 1)[1] for s in found)

    def read(self, parts: Sequence[tuple[str, str]]) -> DataFrame:
        """Rows of (part, attempt) pairs, with the part as a partition column."""
        if not parts:
            return self.spark.createDataFrame([], self.schema).drop("attempt")
        paths = [f"{self.folder}/rows/{self.part}={p}/attempt={a}" for p, a in parts]
        return self.spark.read.schema(self.schema).option("basePath", f"{self.folder}/rows").parquet(*paths).drop("attempt")


class KeyedTable:
    """Rows unique by the spec's key.  ``n_buckets`` holds for the folder's whole life; a bucket is written as ``files`` tasks.

    One writer at a time: of two that start from the same version the second fails.
    """

    def __init__(self, spark: SparkSession, folder: str, spec: Spec, n_buckets: int = 64, files: int = 1):
        self.spark, self.folder, self.spec, self.n_buckets, self.files = spark, folder, spec, n_buckets, files
        self._attempts = _Attempts(spark, folder, spec, "bucket", IntegerType())

    def _bucket(self, *key: Column) -> Column:
        types = {f.name: f.dataType for f in self.spec.schema}
        key = key or tuple(F.col(k) for k in self.spec.key)
        return F.pmod(F.xxhash64(*[c.cast(types[k]) for c, k in zip(key, self.spec.key)]), F.lit(self.n_buckets).cast("long")).cast("int")

    def version(self) -> int:
        """The number of the last committed version, 0 before the first."""
        found = latest(self.spark, f"{self.folder}/commits")
        return found[0] if found else 0

    def _parts(self, version: int | None = None) -> tuple[int, dict[str, str]]:
        if version is not None:
            return version, json.loads(records(self.spark, f"{self.folder}/commits")[str(version)])
        found = latest(self.spark, f"{self.folder}/commits")
        return (found[0], json.loads(found[1])) if found else (0, {})

    def rows(self, version: int | None = None) -> DataFrame:
        """All rows of the last version, or of an earlier one, with their bucket."""
        return self._attempts.read(sorted(self._parts(version)[1].items()))

    def read(self, version: int | None = None) -> DataFrame:
        return self.rows(version).drop("bucket")

    def lookup(self, *keys: tuple) -> DataFrame:
        """The rows of some keys, read from their buckets only."""
        buckets = [self._bucket(*map(F.lit, k)) for k in keys]
        hit = reduce(Column.__or__, [reduce(Column.__and__, [F.col(c) == F.lit(v) for c, v in zip(self.spec.key, k)]) for k in keys])
        return self.rows().filter(F.col("bucket").isin(buckets) & hit).drop("bucket")

    def _commit(self, version: int, parts: dict[str, str], rows: DataFrame, touched: Sequence[str] | None) -> int:
        typed = conform(rows, self.spec).withColumn("bucket", self._bucket())
        if touched is not None:
            inside = F.col("bucket").isin([int(b) for b in touched])
            typed = typed.withColumn("bucket", F.when(inside, F.col("bucket")).otherwise(F.raise_error(F.lit("a row outside of the changed keys' buckets")).cast("int")))
        spread = F.pmod(F.xxhash64(F.lit("file"), *self.spec.key), F.lit(self.files).cast("long"))
        attempt, written = self._attempts.write(typed.repartition("bucket", spread))
        again = self._attempts.read([(b, attempt) for b in written]).groupBy(*self.spec.key).count().filter("count > 1").first()
        if again is not None:
            raise ValueError(f"key met twice: {tuple(again)[:-1]}")
        kept = {b: a for b, a in parts.items() if touched is not None and b not in touched}
        if not publish(self.spark, f"{self.folder}/commits", str(version + 1), json.dumps(kept | dict.fromkeys(written, attempt))):
            raise RuntimeError(f"version {version + 1} was committed by another writer")
        return version + 1

    def overwrite(self, rows: DataFrame) -> int:
        """Commit ``rows`` as the whole table."""
        version, parts = self._parts()
        return self._commit(version, parts, rows, None)

    def update(self, changes: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Commit the rows that ``change(old, changes)`` returns in place of ``old``, all rows of the changed keys' buckets.

        ``changes`` hold the key's columns; rows with a null in the key change nothing.  No changes, no new version.
        """
        version, parts = self._parts()
        named = reduce(Column.__and__, [F.col(k).isNotNull() for k in self.spec.key])
        path = f"{self.folder}/changes/{uuid.uuid4().hex}"
        changes.filter(named).withColumn("_bucket", self._bucket()).write.parquet(path)
        stored = self.spark.read.parquet(path)
        touched = sorted(str(r[0]) for r in stored.select("_bucket").distinct().collect())  # n_buckets rows at most
        if not touched:
            return version
        old = self._attempts.read([(b, parts[b]) for b in touched if b in parts]).drop("bucket")
        return self._commit(version, parts, change(old, stored.drop("_bucket")), touched)


class DayTable:
    """Rows by the day of ``time``, appended batch by batch; a range of days reads those days' folders only."""

    def __init__(self, spark: SparkSession, folder: str, spec: Spec, time: str = "created_at"):
        self.spark, self.folder, self.spec, self.time = spark, folder, spec, time
        self._attempts = _Attempts(spark, folder, spec, "day", StringType())

    def append(self, batch_id: int, rows: DataFrame) -> bool:
        """Add the rows under their batch's id; False if that batch is there already."""
        if str(batch_id) in records(self.spark, f"{self.folder}/commits"):
            return False
        typed = conform(rows, self.spec).withColumn("day", F.date_format(self.time, "yyyy-MM-dd"))
        attempt, days = self._attempts.write(typed.repartitionByRange("day", self.time))  # a busy day spreads over tasks
        return publish(self.spark, f"{self.folder}/commits", str(batch_id), json.dumps({"attempt": attempt, "days": days}))

    def read(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """Rows of the days from ``first`` to ``last`` (YYYY-MM-DD, both included); all by default."""
        batches = [json.loads(c) for c in records(self.spark, f"{self.folder}/commits").values()]
        wanted = [(d, b["attempt"]) for b in batches for d in b["days"] if (first is None or d >= first) and (last is None or d <= last)]
        return self._attempts.read(sorted(wanted)).drop("day")
