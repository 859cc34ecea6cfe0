"""Language of a text by its trigrams, with weights that a Spark job trains."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from newsmill.functions import text as T
from newsmill.session import cut_lineage, ship_package

#: Trigrams that each language brings into the profiles: the size of the model, not of the texts.
PROFILE_GRAMS = 300
MIN_CHARS = 20
_SALTS = 32
#: Characters of texts whose trigrams are looked at together, and bits of a character in a trigram's number.
_CHUNK_CHARS, _BITS = 1 << 20, 21


def _letters(text: Column) -> Column:
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(T.or_empty(text)), r"[^\p{L}]+", " "), F.lit(" "))


def _chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts, with the place of their first, of about ``_CHUNK_CHARS`` characters."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= _CHUNK_CHARS or i + 1 == len(texts):
            yield start, texts[start : i + 1]
            start, size = i + 1, 0


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The number of each trigram in the texts, and the place of its text."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    whole = row[:-2] == row[2:]
    return (codes[:-2] << 2 * _BITS | codes[1:-1] << _BITS | codes[2:])[whole], row[2:][whole]


def _gram_of(number: int) -> str:
    return "".join(chr(number >> k * _BITS & (1 << _BITS) - 1) for k in (2, 1, 0))


def _counted(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) of (lang, letters), already added up for each batch of rows."""
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_lang: dict[str, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("_t").to_pylist(), strict=True):
                of_lang.setdefault(lang, []).append(text)
            for lang, texts in of_lang.items():
                for _, part in _chunks(texts):
                    grams, n = np.unique(_trigrams(part)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(n), pa.string()), pa.array([_gram_of(g) for g in grams.tolist()], pa.string()), pa.array(n, pa.int64())], ["lang", "gram", "n"]
                    )

    return rows.mapInArrow(run, "lang string, gram string, n long")


def language_profiles(labelled: DataFrame, top: int = PROFILE_GRAMS) -> DataFrame:
    """(lang, gram, n, total): counts in every language of the trigrams that are among the ``top`` of any, and of all its trigrams.

    Counts cover all of (lang, text).  The commonest are first chosen inside
    shares of a language's trigrams, so no task ranks a whole language.
    """
    d = labelled.filter("lang is not null").select("lang", _letters(F.col("text")).alias("_t"))
    # read several times below, and small beside the texts
    counts = cut_lineage(_counted(d).filter(F.trim("gram") != "").groupBy("lang", "gram").agg(F.sum("n").alias("n")))

    def best(rows: DataFrame, *keys: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(F.col("n").desc(), "gram")
        return rows.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= top).drop("_place")

    salted = counts.withColumn("_salt", F.pmod(F.xxhash64("gram"), F.lit(_SALTS).cast("long")))
    chosen = best(best(salted, "lang", "_salt"), "lang").select("gram").distinct()
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    # top trigrams and one row for each language: both sides are bounded by the number of languages
    return counts.join(F.broadcast(chosen), "gram", "left_semi").join(F.broadcast(totals), "lang").select("lang", "gram", "n", "total")


def _model(profiles: DataFrame) -> tuple[list[str], list[tuple[str, list[int]]]]:
    """The languages in order, and each trigram with its weights in that order."""
    languages = profiles.groupBy("lang").agg(F.max("total").alias("total")).agg(F.array_sort(F.collect_list(F.struct("lang", "total"))).alias("languages"))
    counts = profiles.groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("_n"))
    counts = counts.withColumn("_g", languages.scalar())
    known = F.transform("_g", lambda g: F.floor(1000 * F.ln((F.coalesce(F.element_at("_n", g["lang"]), F.lit(0)) + 0.5) / g["total"])))
    weights = [(r.gram, r.w) for r in counts.select("gram", known.alias("w")).collect()]
    return [g.lang for g in languages.first().languages], weights


def detect_language(texts: DataFrame, profiles: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, language): the language in which the whole text's known trigrams are likeliest; ``unknown`` below 20 characters or without any.

    Every row is scored by itself against the model, a constant of the plan, so
    texts are scanned once and never shuffled.  The model is what the driver
    fetches: at most ``top`` trigrams and one row for each language.  Of equal
    languages the last by name is taken.  Rows may repeat.
    """
    languages, model = _model(profiles)
    model.sort(key=lambda m: _trigrams([m[0]])[0][0])
    grams = np.array([_trigrams([g])[0][0] for g, _ in model], dtype=np.int64)
    weights = np.array([w for _, w in model], dtype=np.float64).reshape(len(model), len(languages))
    long = F.length(T.trim_ws(T.or_empty(F.col("text")))) >= MIN_CHARS
    d = texts.select(key, F.when(long, _letters(F.col("text"))).alias("_t"))
    ship_package(texts.sparkSession)

    def named(part: list[str]) -> list[str]:
        numbers, row = _trigrams(part)
        at = np.minimum(np.searchsorted(grams, numbers), len(grams) - 1)
        met = grams[at] == numbers
        at, row = at[met], row[met]
        # whole numbers far below 2^53, so sums of doubles are exact
        scores = np.stack([np.bincount(row, weights[at, k], len(part)) for k in range(len(languages))])
        best = len(languages) - 1 - np.argmax(scores[::-1], axis=0)
        return [languages[b] if n else "unknown" for b, n in zip(best.tolist(), np.bincount(row, minlength=len(part)).tolist(), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = ["unknown"] * batch.num_rows
            held = [(i, t) for i, t in enumerate(batch.column("_t").to_pylist()) if t is not None]
            for start, part in _chunks([t for _, t in held]) if len(grams) else ():
                for (i, _), language in zip(held[start:], named(part)):
                    found[i] = language
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(found, pa.string())], [key, "language"])

    return d.mapInArrow(run, StructType([texts.schema[key], StructField("language", StringType())]))
