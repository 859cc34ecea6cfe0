"""Token counts by source, language and tokenizer version, maintained by signed deltas.

Totals are sums of deltas: an insert adds a document's counts, a delete takes
them away, a revision does both.  A ledger keeps the counts of each document, so
a batch itself knows what its documents counted before.  Each batch is written
to a folder of its own and committed by a record under its id; a batch that is
already committed changes nothing, one that was cut short is never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsmill.llm.bpe import BYTE_BPE, WORD_BPE, coded, encoder, memory, sums, text_chunks
from newsmill.llm.common import new_folder, ship, table
from newsmill.llm.packing import byte_ids
from newsmill.llm.quality import judge
from newsmill.sources.commits import publish, records

GROUP = ["source", "lang", "version"]
#: Tokenizer files by the version under which their counts are kept.
VERSIONS = {"byte-bpe-50k": BYTE_BPE, "word-bpe-49k": WORD_BPE}
_DELTAS = "source string, lang string, version string, n_docs long, n_tokens long"
_LEDGER = "doc_id long, source string, lang string, version string, n_tokens long, gone boolean"


def token_counts(docs: DataFrame, versions: dict[str, str]) -> DataFrame:
    """(doc_id, source, lang, version, n_tokens): a row for each row of ``docs`` and tokenizer.

    A null text has 0 tokens; whole texts are counted, however long.  Ids, sources
    and languages may be null or repeat; other columns are not read, so their
    names may be any.  An empty table gives an empty result.
    """

    def counter(path: str):
        if path.endswith(BYTE_BPE):
            known = byte_ids(path)
            plain = known.encoding.encode_ordinary
            special = lambda t: any(s in t for s in known.specials)
            return lambda texts: [len(known.ids(t)) // 4 if special(t) else len(plain(t)) for t in texts]
        enc, lengths = encoder(path), memory(path, "lengths")

        def counts(texts: list[str]) -> list[int]:
            distinct, places, ends = coded([enc.pieces(t) for t in texts])
            return sums(lengths.of(distinct), places, ends)

        return counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = {v: counter(p) for v, p in versions.items()}
        for batch in batches:
            for part, texts in text_chunks(batch):
                for version, count in counters.items():
                    yield part.drop_columns(["text"]).append_column("version", pa.array([version] * len(texts))).append_column(
                        "n_tokens", pa.array(count(texts), pa.int64())
                    )

    ship(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("source", "lang", "text")])
    return d.mapInArrow(run, "doc_id long, source string, lang string, version string, n_tokens long")


def signed(counts: DataFrame, sign: int) -> DataFrame:
    """Deltas (source, lang, version, n_docs, n_tokens) that add the counts, or with -1 take them away."""
    return counts.select(*GROUP, F.lit(sign).cast("long").alias("n_docs"), (F.col("n_tokens") * sign).alias("n_tokens"))


def _summed(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class Rollup:
    """Totals and ledger in one folder below which each committed batch has a folder of its own.

    Batches are committed in rising order of their ids.  Compaction puts one base in
    the place of all batches so far.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _parts(self) -> dict[int, str]:
        """The folders to be read by batch id: the newest base, which stands for all up to its id, and what came after it."""
        found = records(self.spark, f"{self.folder}/commits")
        bases = {int(n.removeprefix("base-")): c for n, c in found.items() if n.startswith("base-")}
        parts = {int(n): c for n, c in found.items() if not n.startswith("base-")}
        if bases:
            base = max(bases)
            parts = {base: bases[base]} | {n: c for n, c in parts.items() if n > base}
        return {n: json.loads(c)["folder"] for n, c in parts.items()}

    def _ledger(self, parts: dict[int, str], touched: DataFrame | None = None) -> DataFrame:
        """The last state of each document, or of those in ``touched`` (doc_id); rows of a repeated id stay together."""
        rows = None
        for batch_id, folder in parts.items():
            one = self.spark.read.schema(_LEDGER).parquet(f"{folder}/ledger").withColumn("batch", F.lit(batch_id).cast("long"))
            rows = one if rows is None else rows.unionAll(one)
        rows = rows if touched is None else rows.join(touched, "doc_id", "left_semi")
        last = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.max("batch").alias("last"))
        kept = rows.join(last, "doc_id", "left").filter("last is null or batch = last")
        return kept.filter("not gone").drop("last", "batch")

    def commit(self, batch_id: int, counts: DataFrame, deleted: DataFrame | None = None) -> bool:
        """The documents of ``counts`` get its counts, in place of those they had, and those of ``deleted`` (doc_id) go.

        False if the batch was committed before.  A document that isn't known yet is
        inserted; one that is also deleted goes.  Rows with a null id are added, but
        cannot be revised or deleted.  An empty batch is committed like any other.
        """
        parts = self._parts()
        if any(batch_id <= n for n in parts):
            return False
        folder = f"{self.folder}/batch-{uuid.uuid4().hex}"
        new = counts.withColumn("gone", F.lit(False))
        if deleted is not None:
            ids = deleted.select("doc_id").filter("doc_id is not null").distinct()
            nothing = {f.name: F.lit(None).cast(f.dataType) for f in new.schema if f.name not in ("doc_id", "gone")}
            new = new.join(ids, "doc_id", "left_anti").unionByName(ids.withColumns(nothing | {"gone": F.lit(True)}))
        new.write.parquet(f"{folder}/ledger")
        entries = self.spark.read.schema(_LEDGER).parquet(f"{folder}/ledger")
        deltas = signed(entries.filter("not gone"), 1)
        if parts:
            touched = entries.select("doc_id").filter("doc_id is not null").distinct()
            deltas = deltas.unionAll(signed(self._ledger(parts, touched), -1))
        _summed(deltas).write.parquet(f"{folder}/deltas")
        return publish(self.spark, f"{self.folder}/commits", str(batch_id), json.dumps({"folder": folder}))

    def compact(self) -> None:
        """One base in the place of all committed batches; the old folders may go once nobody reads them."""
        parts = self._parts()
        if parts:
            folder = f"{self.folder}/base-{uuid.uuid4().hex}"
            self._ledger(parts).withColumn("gone", F.lit(False)).write.parquet(f"{folder}/ledger")
            self.totals().write.parquet(f"{folder}/deltas")
            publish(self.spark, f"{self.folder}/commits", f"base-{max(parts)}", json.dumps({"folder": folder}))

    def totals(self) -> DataFrame:
        """(source, lang, version, n_docs, n_tokens) over all committed batches; groups without documents left don't appear."""
        folders = [f"{folder}/deltas" for folder in self._parts().values()]
        kept = self.spark.read.schema(_DELTAS).parquet(*folders) if folders else self.spark.createDataFrame([], _DELTAS)
        return _summed(kept).filter("n_docs <> 0 or n_tokens <> 0")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three commits: all documents, then a batch in which those labelled poor are cleaned and recounted
    and those labelled toxic are taken down, then that same batch again, as after a lost acknowledgement."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    versions = {v: public_tokenizers.path(f) for v, f in VERSIONS.items()}
    rollup = Rollup(spark, new_folder(spark, "token-rollup"))
    rollup.commit(1, token_counts(docs, versions))
    # a hash join at every size: labels grow with the documents, so they are never broadcast
    poor = docs.join(labels.filter("quality = 0").select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_semi")
    # source and lang go along with each row: a join by id would multiply the rows of a repeated one
    cleaned = judge(poor.withColumn("group", F.struct("source", "lang")), carry="group")
    cleaned = cleaned.select("doc_id", "group.source", "group.lang", F.col("clean_text").alias("text"))
    toxic = labels.filter("toxic = 1").select("doc_id")
    for _ in range(2):
        rollup.commit(2, token_counts(cleaned, versions), toxic)
    return rollup.totals()
