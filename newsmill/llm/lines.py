"""Removal of lines that many documents share.

Hashes of line keys are range-partitioned together with the document id, so a
line that a third of all documents hold is spread over many tasks, and sorted
by document (largest first) and position inside each partition.  One streaming
pass finds what every line loses; only runs at a partition's edges wait for a
summary of at most two rows a partition.  The result is a compressed bitmap of
kept lines for each document that loses any; texts are not shuffled for it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsmill.llm.common import BLANKS, ascii_lower, id_and_text, ship, stored, table

MIN_CHARS = 40
MIN_DOCS = 5

_SWEPT = pa.schema([
    ("sure", pa.bool_()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("version", pa.int64()),
    ("position", pa.int32()), ("n_docs", pa.int64()),
])
_SWEPT_DDL = "sure boolean, h1 long, h2 long, doc_id long, version long, position int, n_docs long"


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc_id, version, position) of each line whose key has ``min_chars`` code points.

    The key is the line without ASCII white space at its ends, A-Z lower-cased;
    (h1, h2) are 128 bits of hash.  ``version`` tells apart different texts under
    one id.  Rows with a null id or text have no keys.
    """
    d = id_and_text(docs).filter("doc_id is not null and text is not null")
    d = d.select("doc_id", F.xxhash64("text").alias("version"), F.posexplode(F.split("text", "\n", -1)).alias("position", "line"))
    d = d.filter(F.octet_length("line") >= min_chars)
    d = d.withColumn("key", ascii_lower(F.btrim("line", F.lit(BLANKS)))).filter(F.char_length("key") >= min_chars)
    return d.select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "version", "position"
    )


def _sweep(min_docs: int):
    """Streams the rows of a partition, ordered by (h1, h2, doc_id descending, position).

    The rows of a key are a run; its first document keeps its lines.  Rows of
    the others are held back until ``min_docs`` documents were seen, then come
    out as sure to go.  The partition's first run may have begun, and its last
    run may go on, in another partition: their undecided rows come out as not
    sure, and a summary row (null position) has their documents' number and
    largest id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, n_docs, top, last, held = None, True, 0, None, None, []

        def summary() -> tuple:
            return (False, *key, top, None, None, n_docs)

        for batch in batches:
            out = []
            for h1, h2, doc, version, position in zip(*(c.to_pylist() for c in batch.columns)):
                if (h1, h2) != key:
                    if key is not None and first:
                        out.append(summary())
                        first = False
                    key, n_docs, top, last, held = (h1, h2), 1, doc, doc, []
                elif doc != last:
                    n_docs, last = n_docs + 1, doc
                if first:
                    out.append((False, h1, h2, doc, version, position, None))
                elif doc != top:
                    held.append((h1, h2, doc, version, position))
                    if n_docs >= min_docs:
                        out.extend((True, *row, None) for row in held)
                        held = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SWEPT)], schema=_SWEPT)
        if key is not None:
            out = [(False, *row, None) for row in held] + [summary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SWEPT)], schema=_SWEPT)

    return run


def dropped_lines(keys: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, version, position) of the lines that go: all of a key that ``min_docs`` documents hold, but in the largest id."""
    ship(keys.sparkSession)
    keys = stored(keys, "line-keys")
    order = ["h1", "h2", F.col("doc_id").desc()]
    ranged = keys.repartitionByRange(*order).sortWithinPartitions(*order, "position")
    swept = stored(ranged.select(*keys.columns).mapInArrow(_sweep(min_docs), _SWEPT_DDL), "swept-lines")
    edges = swept.filter("position is null").groupBy("h1", "h2").agg(F.sum("n_docs").alias("all_docs"), F.max("doc_id").alias("top"))
    open_rows = swept.filter("position is not null and not sure").join(F.broadcast(edges), ["h1", "h2"])
    open_rows = open_rows.filter((F.col("all_docs") >= min_docs) & (F.col("doc_id") != F.col("top")))
    columns = ["doc_id", "version", "position"]
    return swept.filter("sure").select(*columns).unionAll(open_rows.select(*columns))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, version, bitmap binary) of each document that loses lines.

    Bit k of the zlib-compressed bitmap (lowest bit of a byte first) is 1 if line
    k stays; lines beyond its end stay.  A document's positions are gathered in
    one place, as many as it has lines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for gone in batch.column("gone"):
                gone = gone.values.to_numpy()
                keep = np.ones(int(gone.max()) + 1, dtype=bool)
                keep[gone] = False
                # the bits beyond the last line that goes are set, as those lines stay
                keep = np.concatenate((keep, np.ones(-len(keep) % 8, dtype=bool)))
                maps.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("version"), pa.array(maps, pa.binary())], ["doc_id", "version", "bitmap"]
            )

    gone = dropped_lines(line_keys(docs, min_chars), min_docs).groupBy("doc_id", "version").agg(F.collect_list("position").alias("gone"))
    return gone.mapInArrow(run, "doc_id long, version long, bitmap binary")


def kept_lines(text: str | None, bitmap: bytes | None) -> tuple[int, int, str]:
    """Number of lines, number dropped, and the rest joined by \\n."""
    lines = (text or "").split("\n")
    if bitmap is None:
        return len(lines), 0, text or ""
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8), bitorder="little")
    rest = [x for x, k in zip(lines, keep.tolist()) if k] + lines[len(keep) :]
    return len(lines), len(lines) - len(rest), "\n".join(rest)


def _with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    d = docs.withColumn("version", F.xxhash64("text"))
    return d.join(bitmaps.hint("shuffle_hash"), ["doc_id", "version"], "left")


def without_shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, row, n_lines, n_dropped, text) of each row of ``docs``; ``row`` is a struct of all its columns.

    A null or empty text is one empty line and stays empty.  Rows with a null id
    lose nothing and don't count as holders.  Repeated rows are one document;
    an id's different texts count as one document that loses lines in each.  A
    document of which all lines go has an empty text and stays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [kept_lines(t.as_py(), b.as_py()) for t, b in zip(batch.column("text"), batch.column("bitmap"))]
            n, gone, rest = zip(*done) if done else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(rest, pa.string())],
                ["doc_id", "row", "n_lines", "n_dropped", "text"],
            )

    d = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"),
    )
    row = d.schema["row"].dataType.simpleString()
    joined = _with_bitmaps(d, keep_bitmaps(docs, min_chars, min_docs)).select("doc_id", "row", "text", "bitmap")
    return joined.mapInArrow(run, f"doc_id long, row {row}, n_lines long, n_dropped long, text string")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP4_SQL = r"""
with lines as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
keyed as (select *, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
held as (select key, max(doc_id) as top from keyed where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
judged as (select k.doc_id, k.pos, k.line, h.top is not null and h.top <> k.doc_id as gone from keyed k left join held h using (key))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
 sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from judged group by doc_id"""
