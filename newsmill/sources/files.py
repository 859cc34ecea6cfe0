"""Landed and published files: lines read by splits with their rejects kept, and JSON written under commit records."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

from newsmill.functions import text as T
from newsmill.sources.commits import publish, records
from newsmill.sources.landed import json_path_extract, tsv_listing


class JsonSink:
    """Batches of rows as JSON lines in ``folder``; a batch is seen once its record is there, and never in part.

    A batch that is committed a second time, as after a lost driver, stays as it
    was.  Fields that are null are left out of the lines.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _commits(self) -> dict[str, dict]:
        return {name: json.loads(content) for name, content in records(self.spark, f"{self.folder}/commits").items()}

    def write(self, rows: DataFrame, batch: str, **metrics: Column) -> dict:
        """Write ``rows`` as ``batch`` and return its record; row count and ``metrics`` are taken by the writing job."""
        done = self._commits()
        if batch in done:
            return done[batch]
        attempt, seen = f"{self.folder}/files/{batch}-{uuid.uuid4().hex}", Observation(f"written-{uuid.uuid4().hex}")
        counts = [F.count("*").alias("rows"), *[c.alias(name) for name, c in metrics.items()]]
        rows.observe(seen, *counts).write.json(attempt)
        record = {"folder": attempt, "schema": rows.schema.json(), **seen.get}
        publish(self.spark, f"{self.folder}/commits", batch, json.dumps(record, default=str))
        return self._commits()[batch]

    def read(self, batch: str | None = None) -> DataFrame | None:
        """The rows of one committed batch, or of all; None if there is none.  All batches must have one schema."""
        found = [r for name, r in sorted(self._commits().items()) if batch in (None, name)]
        if not found:
            return None
        schema = StructType.fromJson(json.loads(found[0]["schema"]))
        return self.spark.read.schema(schema).option("mode", "FAILFAST").json([r["folder"] for r in found])


def landed_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, line) of text files, which Spark reads by splits; empty lines are left out."""
    d = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    return d.filter(T.trim_ws(F.col("line")) != "")


def read_json_payloads(lines: DataFrame, items: str = "articles", fields: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of the payloads, one a line, and the lines without any, with a ``reason``: not-json or no-items."""
    parsed = F.try_parse_json("line")
    array = F.try_variant_get(parsed, f"$.{items}", "array<variant>")
    reason = F.when(parsed.isNull(), "not-json").when(array.isNull(), "no-items")
    return json_path_extract(lines, "line", items, fields), lines.withColumn("reason", reason).filter("reason is not null")


def read_tsv_listing(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of a tab-separated listing, and the lines that lack a part, with a ``reason``."""
    parts = F.split("line", "\t")
    part = lambda i: T.or_empty(F.get(parts, F.lit(i)))
    reason = F.when(part(0) == "", "no-id").when(part(1) == "", "no-title").when(part(3) == "", "no-url")
    return tsv_listing(lines), lines.withColumn("reason", reason).filter("reason is not null")
