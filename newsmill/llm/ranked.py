"""Ranked lexical search by hashed max-sketches.

A term's impact in a document rises with its frequency there and falls with the
document's length.  Each document's terms are hashed to the coordinates of a
sketch that keeps the largest frequency of each, and so the largest impact.  A
batch of queries looks its terms up in the sketches: the weighted sums are upper
bounds of the scores.  Documents are then scored exactly in descending order of
their bounds, until no bound reaches the worst score that is still kept.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from newsmill.llm.common import id_and_text, ship, stored, table

K = 10
#: Coordinates of a sketch for each distinct term, rounded up to a power of two.
WIDTH = 8
#: Frequencies from here on are kept as this; their impact is bounded by that of an endless one.
MOST = 255
#: Distinct (item, term) pairs that are looked up together.
BLOCK_TERMS = 1 << 14
#: Bounds' summands, of all pairs and some documents, that are worked out together.
_CELLS = 1 << 20
#: Characters of a text that are split into terms at a time.
_CHUNK_CHARS = 1 << 22
#: Documents whose rows of the index are handed over together, and terms whose hashes a task remembers.
_HANDED, _KNOWN = 512, 100_000
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_GAP = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_INDEX = "doc_id long, n long, terms array<long>, tfs array<int>, sketch binary"
_UNIT, _TF, _M = 1_000_000_000, 1000, 8


def term_counts(text: str | None) -> Counter[str]:
    """How often each term occurs, A-Z lower-cased; a long text is cut between terms."""
    counts: Counter[str] = Counter()
    text, at = text or "", 0
    while at < len(text):
        gap = _GAP.search(text, at + _CHUNK_CHARS)
        end = gap.start() if gap else len(text)
        counts.update(_TERM.findall(text[at:end].translate(_LOWER) if not text.isascii() else text[at:end].lower()))
        at = end
    return counts


def term_hash(term: str) -> int:
    """A term's signed 64-bit name; two of a billion terms share one with a chance of 3 in 100, one of a query with any in 1 of 10^10 for each term."""
    h = xxhash.xxh64_intdigest(term.encode())
    return h - (1 << 64) if h >> 63 else h


def sketch_of(terms: np.ndarray, tfs: np.ndarray) -> bytes:
    """The largest frequency among the terms of each coordinate, in a byte; coordinates are the low bits of the hashes."""
    width = 1 << max(1, (WIDTH * len(terms) - 1).bit_length())
    sketch = np.zeros(width, dtype=np.uint8)
    np.maximum.at(sketch, terms & (width - 1), np.minimum(tfs, MOST).astype(np.uint8))
    return sketch.tobytes()


def sketch_index(docs: DataFrame) -> DataFrame:
    """(doc_id, n, terms, tfs, sketch): a row for each row of ``docs`` with a term, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in (b.slice(at, _HANDED) for b in batches for at in range(0, b.num_rows, _HANDED)):
            ids, sizes, terms, tfs, sketches = [], [], [], [], []
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                counts = term_counts(text.as_py())
                if not counts:
                    continue
                if len(known) > _KNOWN:
                    known.clear()
                names = np.fromiter((known.get(t) or known.setdefault(t, term_hash(t)) for t in counts), np.int64, len(counts))
                times = np.fromiter(counts.values(), np.int64, len(counts))
                order = np.argsort(names)
                ids.append(doc_id.as_py())
                sizes.append(int(times.sum()))
                terms.append(names[order])
                tfs.append(times[order].astype(np.int32))
                sketches.append(sketch_of(names, times))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int64())), pa.array(tfs, pa.list_(pa.int32())), pa.array(sketches, pa.binary())],
                ["doc_id", "n", "terms", "tfs", "sketch"],
            )

    ship(docs.sparkSession)
    return stored(id_and_text(docs).mapInArrow(run, _INDEX), "sketch-index")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column, neither copied."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data or b"", dtype=np.uint8), at


def document_frequencies(index: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """Of each of the sorted ``terms`` in how many documents it occurs; each task counts its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(terms), dtype=np.int64)
        for batch in batches:
            found, _ = _flat(batch.column("terms"))
            at = np.minimum(np.searchsorted(terms, found), len(terms) - 1)
            counts += np.bincount(at[terms[at] == found], minlength=len(terms))
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(terms[held]), pa.array(counts[held])], ["term", "n"])

    if not len(terms):
        return {}
    found = index.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))
    return {r.term: r.df for r in found.collect()}  # one row for each term of the block at most


class QueryBlock:
    """A batch of items: their terms' hashes and weights, and the (item, term) pairs in item order."""

    def __init__(self, items: list[tuple[int, list[int]]], weights: dict[int, int]):
        held = [(i, sorted(t for t in terms if weights.get(t, 0) > 0)) for i, terms in items]
        held = [(i, t) for i, t in held if t]
        self.items = [i for i, _ in held]
        self.terms = np.array(sorted({t for _, ts in held for t in ts}), dtype=np.int64)
        self.of_term = np.searchsorted(self.terms, np.array([t for _, ts in held for t in ts], dtype=np.int64))
        self.weight = np.array([weights[t] for _, ts in held for t in ts], dtype=np.int64)
        self.wanted = [np.array(ts, dtype=np.int64) for _, ts in held]
        self.weights = [np.array([weights[t] for t in ts], dtype=np.int64) for _, ts in held]
        sizes = np.array([len(ts) for _, ts in held], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return _UNIT * tf // (_TF * tf + _M * m)


def _score(block: QueryBlock, q: int, terms: np.ndarray, tfs: np.ndarray, m: int) -> int:
    """The exact score of one document, given by its sorted terms, for the q-th item."""
    wanted = block.wanted[q]
    at = terms.searchsorted(wanted)
    at[at == len(terms)] = 0
    found = np.flatnonzero(terms[at] == wanted)
    tf = tfs[at[found]].astype(np.int64)
    return int(block.weights[q][found] @ impact(tf, np.int64(m)))


def search_block(index: DataFrame, block: QueryBlock, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item_id, doc_id, score): of each partition of the index the k best documents of each item."""
    step = max(1, _CELLS // len(block.of_term))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in block.items]  # (-score, doc_id), best first
        for batch in batches:
            ids, n = batch.column("doc_id").to_numpy(), batch.column("n").to_numpy()
            terms, offsets = _flat(batch.column("terms"))
            tfs, _ = _flat(batch.column("tfs"))
            cells, cell_offsets = _bytes(batch.column("sketch"))
            # in Python's whole numbers: 90 * n * N may pass 2^63 where the quotient doesn't
            m = np.array([10 + 90 * int(x) * n_docs // n_terms for x in n.tolist()], dtype=np.int64)
            masks = np.diff(cell_offsets) - 1
            for start in range(0, len(ids), step):
                part = slice(start, min(start + step, len(ids)))
                place = cell_offsets[:-1][part] + (block.terms[:, None] & masks[part])
                held = cells[place].astype(np.int64)
                most = impact(held, m[part])
                most[held == MOST] = _UNIT // _TF
                bounds = np.add.reduceat(block.weight[:, None] * most[block.of_term], block.starts[:-1], axis=0)
                for q in range(len(block.items)):
                    kept, bound = best[q], bounds[q]
                    least = max(1, -kept[-1][0]) if len(kept) == k else 1
                    may = np.flatnonzero(bound >= least)
                    for i in may[np.argsort(-bound[may], kind="stable")].tolist():
                        if len(kept) == k and bound[i] < -kept[-1][0]:
                            break
                        d = start + i
                        a, b = offsets[d], offsets[d + 1]
                        score = _score(block, q, terms[a:b], tfs[a:b], int(m[d]))
                        if score > 0 and (len(kept) < k or (-score, int(ids[d])) < kept[-1]):
                            kept.append((-score, int(ids[d])))
                            kept.sort()
                            del kept[k:]
        rows = [(item, doc_id, -score) for item, kept in zip(block.items, best) for score, doc_id in kept]
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item_id", "doc_id", "score"])

    return index.filter("doc_id is not null").mapInArrow(run, "item_id long, doc_id long, score long")


def query_blocks(items: DataFrame, block_terms: int = BLOCK_TERMS) -> Iterator[list[tuple[int, list[int]]]]:
    """The items as (item_id, hashes of their distinct terms), in blocks of about ``block_terms`` terms.

    The rows of an item, if it repeats, are one query.  The driver holds one block at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [[term_hash(t) for t in term_counts(x.as_py())] for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(terms, pa.list_(pa.int64()))], ["item_id", "terms"])

    d = id_and_text(items.select(F.col("item_id").alias("doc_id"), "text")).filter("doc_id is not null")
    d = d.mapInArrow(run, "item_id long, terms array<long>").select("item_id", F.explode("terms").alias("term")).distinct()
    sizes = stored(d.groupBy("item_id").agg(F.collect_list("term").alias("terms")), "query-items")
    block, pairs = [], 0
    for row in sizes.toLocalIterator():
        block.append((row.item_id, row.terms))
        pairs += len(row.terms)
        if pairs >= block_terms:
            yield block
            block, pairs = [], 0
    if block:
        yield block


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): of each item the k highest-scoring documents with a score above 0, ties to the smaller id.

    Null and empty texts, and those without a term, are no documents.  Each of
    repeated rows is a document of its own; rows with a null doc_id count in the
    statistics but are never returned.  Items without an id are left out; the
    rows of one id are one query.  Fewer than k such documents give fewer rows,
    an empty table none.  Whole texts are indexed, however long; other columns
    are not read, so their names may be any.

    The index is read once for each block of items.  A task returns at most k
    rows for each item, which it has scored exactly.
    """
    spark = docs.sparkSession
    index = sketch_index(docs)
    n_docs, n_terms = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for items_ in query_blocks(items, block_terms) if n_docs else ():
        wanted = np.array(sorted({t for _, ts in items_ for t in ts}), dtype=np.int64)
        df = document_frequencies(index, wanted)
        weights = {t: int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * n + 1)))) for t, n in df.items()}
        block = QueryBlock(items_, weights)
        if block.items:
            found = found.unionAll(search_block(index, block, n_docs, n_terms, k))
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_TERMS = r"""unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"""
OP11_SQL = f"""
with t as (select doc_id, {_SQL_TERMS} as term from documents),
i as (select distinct item_id, {_SQL_TERMS} as term from benchmark),
f as (select doc_id, term, count(*) as tf from t group by all),
d as (select doc_id, sum(tf)::bigint as n from f group by all),
g as (select count(*) as docs, sum(n)::bigint as terms from d),
w as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::bigint as w from f, g where term in (select term from i) group by term, docs),
s as (select i.item_id, f.doc_id, sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * (10 + (90 * d.n * g.docs) // g.terms))))::bigint as score
  from i join w using (term) join f using (term) join d on d.doc_id = f.doc_id, g group by all),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0)
select item_id, rank::int as rank, doc_id, score from r where rank <= 10"""
