"""From raw documents to packed token sequences, in five stages.

Each stage works on all that its predecessor kept, written as Parquet to the
shared folder in between.  All but the last return the columns of their input;
``n_chars``, where there is one, follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsmill.llm.bpe import BYTE_BPE
from newsmill.llm.common import stored, table
from newsmill.llm.lines import without_shared_lines
from newsmill.llm.packing import packed_documents
from newsmill.llm.pii import pseudonymised
from newsmill.llm.quality import judge
from newsmill.llm.simhash import without_near_duplicates


def _as_before(changed: DataFrame, columns: list[str]) -> DataFrame:
    """``changed`` (row, text) with the given columns in their order."""

    def column(c: str) -> Column:
        if c == "text":
            return F.col("text")
        if c == "n_chars":
            return F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars")
        return F.col(f"row.`{c}`")

    return changed.select(*[column(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that fail them."""
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))
    # a filter on a row number isn't pushed below the projection; there, each rule would be repeated wherever it is used
    judged = judge(rows, carry="row").withColumn("number", F.monotonically_increasing_id())
    kept = judged.filter("kept and number >= 0").select("row", F.col("clean_text").alias("text"))
    return _as_before(kept, docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many share."""
    return _as_before(without_shared_lines(docs).select("row", "text"), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return without_near_duplicates(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data."""
    return _as_before(pseudonymised(docs).select("row", "text"), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces and their places in sequences."""
    return packed_documents(docs, public_tokenizers.path(BYTE_BPE))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("pii", pii), ("packing", packing)]

#: Tokenizing, shingle similarity and keyed permutations have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
