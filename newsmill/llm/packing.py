"""Best-fit packing of token sequences in bulk-synchronous rounds.

A round range-sorts unplaced pieces and open gaps together, largest first.  One
sweep of each partition gives every piece the smallest gap that holds it, and
offers what is left of the gap again further down.  Pieces and gaps that find no
partner in their own partition are matched across partitions by their ranks: any
gap of an earlier partition holds any piece of a later one.  Gaps are updated
and the next round begins.  Before each round as many new sequences are opened as
the gaps' total room falls short; when a round places nothing, as the rest needs.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsmill.llm.bpe import BYTE_BPE, byte_letters, text_chunks
from newsmill.llm.common import id_and_text, new_folder, ship, stored, table

CAPACITY = 1024
END_ID = 2
#: Rows of pieces and gaps for each task of a round.
ROWS_PER_TASK = 100_000
CACHE_PIECES = 300_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class ByteIds:
    """Ids of a byte-level tokenizer as little-endian 32-bit bytes, remembering what lies between spaces."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        bytes_of = {c: bytes([b]) for b, c in enumerate(byte_letters())}
        ranks = {b"".join(bytes_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if i < len(spec["model"]["vocab"])}
        self.specials = {t["content"]: array("I", [t["id"]]).tobytes() for t in spec["added_tokens"]}
        ranks = {t: i for t, i in ranks.items() if t.decode("utf-8", "replace") not in self.specials}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.at_start: dict[str, bytes] = {}
        self.after_space: dict[str, bytes] = {}
        self.special_splitter = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")")
        self.loose_space = re.compile(r" \s")

    def _plain(self, text: str) -> bytes:
        return array("I", self.encoding.encode_ordinary(text)).tobytes()

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.specials):
            parts = self.special_splitter.split(text)
            return b"".join(self.specials[p] if k % 2 else self.ids(p) for k, p in enumerate(parts))
        if self.loose_space.search(text) or text.endswith(" "):
            return self._plain(text)  # runs of white space join across spaces
        # a space before anything else begins a pre-token, so what follows one is encoded alone
        first, *rest = text.split(" ")
        for cache in (self.at_start, self.after_space):
            if len(cache) > CACHE_PIECES:
                cache.clear()
        known = self.after_space
        for x in set(rest).difference(known):
            known[x] = self._plain(" " + x)
        if first not in self.at_start:
            self.at_start[first] = self._plain(first)
        return self.at_start[first] + b"".join(map(known.__getitem__, rest))


@lru_cache(maxsize=2)
def byte_ids(path: str) -> ByteIds:
    return ByteIds(path)


def cut(ids: bytes, capacity: int) -> Iterator[tuple[int, bytes]]:
    """(start, ids) of the pieces of a document: all of ``capacity`` ids but perhaps the first."""
    n = len(ids) // 4
    at = n % capacity or capacity if n > capacity else n
    yield 0, ids[: 4 * at]
    while at < n:
        yield at, ids[4 * at : 4 * (at + capacity)]
        at += capacity


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and an end id, cut where they exceed ``capacity``."""
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = byte_ids(path)
        for batch in batches:
            for part, texts in text_chunks(batch):
                out: list[tuple] = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), texts):
                    pieces = cut(known.ids(text) + end, capacity)
                    out.extend((doc_id, k, at, len(ids) // 4, zlib.crc32(ids)) for k, (at, ids) in enumerate(pieces))
                doc, k, at, size, crc = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(k, pa.int32()), *(pa.array(x, pa.int64()) for x in (at, size, crc))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    ship(docs.sparkSession)
    return id_and_text(docs).mapInArrow(run, _PIECES)


_PLACED, _LEFT, _OPEN, _SMALL = range(4)
_SWEPT = "kind int, id long, seq long, size long, offset long, part int, rank long"


def sweep(rows: Iterator[tuple[bool, int, int]], capacity: int, least: int) -> Iterator[tuple]:
    """Best fit over (is_gap, size, id) in falling order of size, gaps first: rows (kind, id, seq, size, offset, rank).

    The smallest gap that holds the piece is the last on the stack; what a piece
    leaves of it waits in a heap until the sweep has come down to its size.
    Remains below ``least`` are of no use and go.
    """
    stack: list[tuple[int, int]] = []
    waiting: list[tuple[int, int]] = []
    left = 0
    for is_gap, size, i in rows:
        while waiting and -waiting[0][0] >= size:
            free, seq = heapq.heappop(waiting)
            stack.append((-free, seq))
        if is_gap:
            stack.append((size, i))
        elif stack:
            free, seq = stack.pop()
            yield _PLACED, i, seq, size, capacity - free, None
            free -= size
            if free >= size:
                stack.append((free, seq))
            elif free >= least:
                heapq.heappush(waiting, (-free, seq))
        else:
            yield _LEFT, i, None, size, None, left
            left += 1
    for k, (free, seq) in enumerate(stack):
        yield _OPEN, seq, seq, free, None, k
    for free, seq in waiting:
        yield _SMALL, seq, seq, -free, None, None


def _sweeper(capacity: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            kind, i, seq, size, offset, rank = zip(*out)
            cols = [pa.array(kind, pa.int32()), *(pa.array(x, pa.int64()) for x in (i, seq, size, offset))]
            cols += [pa.array([part] * len(out), pa.int32()), pa.array(rank, pa.int64())]
            return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in _SWEPT.split(", ")])

        for row in sweep(rows, capacity, least):
            out.append(row)
            if len(out) >= 50_000:
                yield batch()
                out.clear()
        if out:
            yield batch()

    return run


def match_ranks(parts: list[tuple[int, int, int]]) -> tuple[list[tuple], list[tuple]]:
    """Partition summaries (part, pieces left, gaps open) in order -> spans (part, from, to, match) of pieces and of gaps.

    Pieces take the latest gaps of earlier partitions, which are the smallest.
    Piece and gap of the same match number go together.
    """
    pieces, gaps, stack, n = [], [], [], 0
    for part, left, opened in parts:
        at = 0
        while at < left and stack:
            gap_part, count = stack.pop()
            take = min(count, left - at)
            pieces.append((part, at, at + take, n))
            gaps.append((gap_part, count - take, count, n))
            at, n = at + take, n + take
            if take < count:
                stack.append((gap_part, count - take))
        if opened:
            stack.append((part, opened))
    return pieces, gaps


def _numbered(rows: DataFrame, spans: list[tuple]) -> DataFrame:
    """Rows (part, rank, ...) with the match number their span gives; null outside of spans.  Two spans a partition at most, on average."""
    spark = rows.sparkSession
    s = spark.createDataFrame(spans, "part int, first long, past long, base long")
    on = (rows["part"] == s["part"]) & (rows["rank"] >= s["first"]) & (rows["rank"] < s["past"])
    return rows.join(F.broadcast(s), on, "left").select(rows["*"], (F.col("base") + F.col("rank") - F.col("first")).alias("match"))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(item, size) -> (item, seq, offset): every item in a sequence of at most ``capacity``, sizes from 1 to capacity.

    Items of over half the capacity open sequences of their own, full ones with
    no gap.  Each round's state is written to the shared folder, and the number
    of rounds follows from the data: they end when all is placed.
    """
    spark = pieces.sparkSession
    ship(spark)
    folder = new_folder(spark, "placed")
    placed_ddl = "item long, seq long, offset long"
    large = pieces.filter(F.col("size") * 2 > capacity)
    large.select("item", F.col("item").alias("seq"), F.lit(0).cast("long").alias("offset")).write.parquet(f"{folder}/round=0")
    gaps = large.select(F.lit(True).alias("is_gap"), (capacity - F.col("size")).alias("size"), F.col("item").alias("id"))
    state = pieces.filter(F.col("size") * 2 <= capacity).select(F.lit(False).alias("is_gap"), "size", F.col("item").alias("id"))
    state = stored(state.unionAll(gaps.filter("size > 0")), "packing")
    opened, round_no, stalled = 0, 0, False
    while True:
        gap, size = F.col("is_gap"), F.col("size")
        n, n_items, total, free, least = state.agg(
            F.count("*"), F.count_if(~gap), F.sum(F.when(~gap, size)), F.coalesce(F.sum(F.when(gap, size)), F.lit(0)), F.min(F.when(~gap, size))
        ).first()
        if not n_items:
            break
        work = state.filter(~gap | (size >= least))
        # what the gaps cannot hold in any case needs as many more sequences; where nothing fits any more, all of it does
        more = -(-total // capacity) if stalled else max(0, -(-(total - free) // capacity))
        if more:
            new = spark.range(opened + 1, opened + 1 + more).select(F.lit(True).alias("is_gap"), F.lit(capacity).cast("long").alias("size"), (-F.col("id")).alias("id"))
            work, opened, n = work.unionAll(new), opened + more, n + more
        round_no += 1
        order = [F.col("size").desc(), F.col("is_gap").desc(), "id"]
        tasks = -(-n // ROWS_PER_TASK)
        ranged = work.repartitionByRange(tasks, *order) if tasks > 1 else work.repartition(1)
        ranged = ranged.sortWithinPartitions(*order)
        swept = stored(ranged.mapInArrow(_sweeper(capacity, least), _SWEPT), "swept")
        parts = swept.groupBy("part").agg(F.count_if(F.col("kind") == _LEFT), F.count_if(F.col("kind") == _OPEN), F.count_if(F.col("kind") == _PLACED)).orderBy("part").collect()
        item_spans, gap_spans = match_ranks([tuple(p)[:3] for p in parts])
        left, gone = swept.filter(F.col("kind") == _LEFT), swept.filter(F.col("kind") == _OPEN)
        placed = swept.filter(F.col("kind") == _PLACED).select(F.col("id").alias("item"), "seq", "offset")
        kept_gaps = swept.filter(F.col("kind") == _SMALL).select(F.col("id"), "size")
        if item_spans:
            left, gone = _numbered(left, item_spans), _numbered(gone, gap_spans)
            pairs = left.filter("match is not null").select("match", F.col("id").alias("item"), F.col("size").alias("taken")).join(
                gone.filter("match is not null").select("match", F.col("id").alias("seq"), F.col("size").alias("free")), "match"
            )
            pairs = stored(pairs.select("item", "taken", "seq", "free"), "matched")
            placed = placed.unionAll(pairs.select("item", "seq", (capacity - F.col("free")).alias("offset")))
            kept_gaps = kept_gaps.unionAll(pairs.select(F.col("seq").alias("id"), (F.col("free") - F.col("taken")).alias("size")))
            left, gone = left.filter("match is null"), gone.filter("match is null")
        placed.write.parquet(f"{folder}/round={round_no}")
        kept_gaps = kept_gaps.unionAll(gone.select("id", "size"))
        rest = left.select(F.lit(False).alias("is_gap"), "size", "id")
        state = stored(rest.unionAll(kept_gaps.filter("size > 0").select(F.lit(True).alias("is_gap"), "size", "id")), "packing")
        stalled = not item_spans and not any(p[3] for p in parts)
    return spark.read.schema(placed_ddl).parquet(*[f"{folder}/round={k}" for k in range(round_no + 1)])


def packed_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece of every row in its place.

    A null or empty text is its end id alone.  Ids may be null or repeat; each
    row is packed.  Other columns are not read; no rows give no pieces.
    """
    pieces = stored(token_pieces(docs, path, capacity, end_id).withColumn("item", F.monotonically_increasing_id()), "pieces")
    places = pack(pieces.select("item", F.col("length").alias("size")), capacity)
    return pieces.join(places, "item").select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.col("seq").alias("sequence_id"), "offset"
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
