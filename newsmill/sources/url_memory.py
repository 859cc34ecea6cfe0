"""Memory of collected URLs: committed batches of rows, each with a Bloom sketch of its URLs.

New URLs meet the merged sketch first, a table of 512-bit blocks; only those that
it lets pass are joined with the rows themselves, so a batch of unseen URLs
reads no history.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsmill.sources.commits import publish, records

_WORDS = 8
_BLOCK = "block int, " + ", ".join(f"w{k} long" for k in range(_WORDS))


def _bit(url: Column, word: int) -> Column:
    place = F.shiftrightunsigned(F.xxhash64(F.lit("bits"), url), 6 * word).bitwiseAND(F.lit(63).cast("long")).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


class UrlMemory:
    """Rows with a URL, appended batch by batch.

    ``n_blocks`` holds for the folder's whole life: 64 bytes each, one for 32 URLs
    lets about one of a thousand unseen URLs pass; with more URLs more pass, and
    results stay the same.  The merged sketch is broadcast, so it bounds that too.
    """

    def __init__(self, spark: SparkSession, folder: str, url: str = "link", n_blocks: int = 1 << 16):
        self.spark, self.folder, self.url, self.n_blocks = spark, folder, url, n_blocks

    def _folders(self) -> list[str]:
        return [json.loads(c)["folder"] for _, c in sorted(records(self.spark, f"{self.folder}/commits").items(), key=lambda r: int(r[0]))]

    def holds(self, batch_id: int) -> bool:
        return str(batch_id) in records(self.spark, f"{self.folder}/commits")

    def append(self, batch_id: int, rows: DataFrame, remembered: Column | None = None) -> bool:
        """Add the rows under their batch's id, with a sketch of the URLs of those that are ``remembered`` (all by default); False if it is there already."""
        if self.holds(batch_id):
            return False
        folder = f"{self.folder}/batch-{uuid.uuid4().hex}"
        rows.withColumn("_remembered", F.coalesce(F.lit(True) if remembered is None else remembered, F.lit(False)) & F.col(self.url).isNotNull()).write.parquet(f"{folder}/rows")
        urls = self.spark.read.parquet(f"{folder}/rows").filter("_remembered").select(F.col(self.url).alias("u"))
        bits = urls.select(self._block(F.col("u")).alias("block"), *[_bit(F.col("u"), k).alias(f"w{k}") for k in range(_WORDS)])
        bits.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(_WORDS)]).write.parquet(f"{folder}/sketch")
        return publish(self.spark, f"{self.folder}/commits", str(batch_id), json.dumps({"folder": folder}))

    def _block(self, url: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit("block"), url), F.lit(self.n_blocks).cast("long")).cast("int")

    def rows(self) -> DataFrame | None:
        """All committed rows, or None if there is none yet."""
        parts = [f"{f}/rows" for f in self._folders()]
        return self.spark.read.parquet(*parts) if parts else None

    def possible(self, urls: DataFrame) -> DataFrame:
        """Of the distinct ``urls`` (one column) those that the merged sketch lets pass."""
        name, parts = urls.columns[0], [f"{f}/sketch" for f in self._folders()]
        d = urls.select(F.col(name).alias(self.url)).filter(F.col(self.url).isNotNull()).distinct()
        if not parts:
            return d.limit(0)
        sketch = self.spark.read.schema(_BLOCK).parquet(*parts).groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(_WORDS)])
        d = d.withColumn("block", self._block(F.col(self.url))).join(F.broadcast(sketch), "block")  # n_blocks rows at most
        passes = reduce(Column.__and__, [F.col(f"w{k}").bitwiseAND(_bit(F.col(self.url), k)) != 0 for k in range(_WORDS)])
        return d.filter(passes).select(self.url)

    def known(self, urls: DataFrame) -> DataFrame:
        """Of the distinct ``urls`` (one column) those that are remembered, exactly."""
        possible = self.possible(urls)
        history = self.rows()
        if history is None:
            return possible
        return possible.join(history.filter("_remembered").select(self.url), self.url, "left_semi")

    def false_positive_rate(self, urls: DataFrame) -> float:
        """The share of ``urls`` not remembered that the sketch lets pass."""
        n, passed, known = urls.distinct().count(), self.possible(urls).count(), self.known(urls).count()
        return (passed - known) / max(1, n - known)
