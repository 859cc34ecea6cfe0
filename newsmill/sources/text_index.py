"""Inverted index of texts: posting lists by stem, in buckets that a search reads one by one.

A posting row holds the documents of one stem in one block of 65,536 ids, so no
row grows with the corpus however common the stem.  Rows lie in folders by the
stem's bucket: a search reads those of its own words, never the texts.  Each
batch is a folder of its own that becomes visible by a commit record.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsmill import rules
from newsmill.functions.stems import stem
from newsmill.operators.listing import query_lexemes
from newsmill.session import ship_package
from newsmill.sources.commits import publish, records

BLOCK_BITS = 16
#: Words whose stems a task remembers.
_KNOWN = 200_000
_SPLIT = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    """Distinct lower-case words: the maximal runs of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(text), _SPLIT), lambda w: w != ""))


def unstemmed(word: str) -> str:
    return word


class TextIndex:
    """An index of (id, text) rows under ``folder``; one driver at a time appends.

    ``stemmer`` takes each distinct word of a batch of rows; search words pass it too.  ``n_buckets`` and the stemmer hold for the folder's whole life.
    Null and empty texts have no words and are never found.  An id that comes
    again, in one batch or a later one: rows of one batch count together, those
    of the latest batch replace earlier ones.
    """

    def __init__(self, spark: SparkSession, folder: str, stemmer: Callable[[str], str] = stem, n_buckets: int = 256):
        self.spark, self.folder, self.stemmer, self.n_buckets = spark, folder, stemmer, n_buckets

    def _batches(self) -> dict[int, str]:
        found = records(self.spark, f"{self.folder}/commits")
        return {int(b): json.loads(c)["folder"] for b, c in sorted(found.items(), key=lambda r: int(r[0]))}

    def _bucket(self, word: Column) -> Column:
        return F.pmod(F.xxhash64(word), F.lit(self.n_buckets).cast("long")).cast("int")

    def _lists(self, rows: DataFrame) -> DataFrame:
        """(stem, block, places): of rows (block, place, words) the posting lists of each batch, so a word is stemmed and shuffled once a batch."""
        ship_package(self.spark)
        stemmer = self.stemmer

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[str, str] = {}
            for batch in batches:
                words = batch.column("words")
                met = words.flatten().dictionary_encode()
                if len(known) > _KNOWN:
                    known.clear()
                stems = [known.get(w) or known.setdefault(w, stemmer(w)) for w in met.dictionary.to_pylist()]
                names = {w: k for k, w in enumerate(dict.fromkeys(stems))}
                stem_of = np.array([names[w] for w in stems], dtype=np.int64)[met.indices.to_numpy()]
                row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(words), 0).to_numpy())
                block, place = batch.column("block").to_numpy()[row], batch.column("place").to_numpy()[row]
                order = np.lexsort((place, block, stem_of))
                stem_of, block, place = stem_of[order], block[order], place[order]
                new = np.ones(len(order), dtype=bool)  # stems of one text are often those of several words
                new[1:] = (stem_of[1:] != stem_of[:-1]) | (block[1:] != block[:-1])
                fresh = new.copy()
                fresh[1:] |= place[1:] != place[:-1]
                stem_of, block, place, first = stem_of[fresh], block[fresh], place[fresh], np.flatnonzero(new[fresh])
                ends = np.append(first, len(place)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(names), pa.string()).take(pa.array(stem_of[first])), pa.array(block[first]), pa.ListArray.from_arrays(pa.array(ends), pa.array(place))], ["stem", "block", "places"]
                )

        return rows.mapInArrow(run, "stem string, block long, places array<int>")

    def append(self, batch_id: int, rows: DataFrame, key: str = "id", text: str = "text") -> bool:
        """Index the rows under their batch's id; False if that batch is there already."""
        if batch_id in self._batches():
            return False
        folder = f"{self.folder}/batch-{uuid.uuid4().hex}"
        ids = rows.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).filter("id is not null")
        block, place = F.shiftright("id", BLOCK_BITS), F.col("id").bitwiseAND((1 << BLOCK_BITS) - 1).cast("int")
        lists = self._lists(ids.select(block.alias("block"), place.alias("place"), words_of(F.col("text")).alias("words")))
        posts = lists.groupBy("stem", "block").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"))
        posts = posts.select(self._bucket(F.col("stem")).alias("bucket"), "stem", "block", F.size("places").alias("n"), "places")
        # by ranges, so that a common stem's blocks spread over tasks and a task writes few buckets
        posts = posts.repartitionByRange("bucket", "stem", "block").sortWithinPartitions("bucket", "stem", "block")
        posts.write.partitionBy("bucket").parquet(f"{folder}/postings")
        ids.select("id").distinct().write.parquet(f"{folder}/ids")
        return publish(self.spark, f"{self.folder}/commits", str(batch_id), json.dumps({"folder": folder}))

    def postings(self, folder: str, stems: Sequence[str] | None = None) -> DataFrame:
        """(bucket, stem, block, n, places) of a batch: all, or of some stems, read from their buckets only."""
        rows = self.spark.read.schema("stem string, block long, n int, places array<int>, bucket int").parquet(f"{folder}/postings")
        if stems is None:
            return rows
        return rows.filter(F.col("bucket").isin([self._bucket(F.lit(s)) for s in stems]) & F.col("stem").isin(list(stems)))

    def _found(self, folder: str, stems: Sequence[str]) -> DataFrame:
        lists = self.postings(folder, stems).groupBy("block").agg(F.collect_list("places").alias("lists")).filter(F.size("lists") == len(stems))
        both = F.aggregate(F.slice("lists", 2, len(stems)), F.get("lists", 0), lambda a, b: F.array_intersect(a, b))
        return lists.select("block", F.explode(both).alias("place")).select((F.shiftleft("block", BLOCK_BITS) + F.col("place")).alias("id"))

    def search(self, query: str, stop_words: Sequence[str] = rules.SEARCH_STOP_WORDS) -> DataFrame:
        """(id) of the documents that hold every word of the query; all documents for a blank query, none if only stop words are left."""
        words, batches = query_lexemes(query, stop_words), self._batches()
        none = self.spark.range(0)
        if not batches or words == []:
            return none
        stems = None if words is None else sorted({self.stemmer(w) for w in words})
        out, later = None, None
        for folder in reversed(batches.values()):  # the latest batch first; it hides its ids in earlier ones
            ids = self.spark.read.schema("id long").parquet(f"{folder}/ids")
            hits = ids if stems is None else self._found(folder, stems)
            hits = hits if later is None else hits.join(later, "id", "left_anti")
            out = hits if out is None else out.unionAll(hits)
            later = ids if later is None else later.unionAll(ids)
        return out

    def documents_per_stem(self) -> DataFrame:
        """(stem, n) over all batches, each counting the ids that it indexed."""
        parts = [self.postings(folder) for folder in self._batches().values()]
        if not parts:
            return self.spark.createDataFrame([], "stem string, n long")
        return reduce(DataFrame.unionByName, parts).groupBy("stem").agg(F.sum("n").alias("n"))
