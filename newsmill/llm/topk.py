"""Exact top-k inner products over buckets of like length.

Candidates are grouped into tiles of neighbouring vector lengths.  A query's
tenth-best score in the tile of longest vectors bounds what the others must
reach: from it follows, for each tile, the cosine that its longest vector would
need.  A tile that needs more than 1 is skipped; a high cosine prunes by the
coordinates on which the query is largest, a low one by length alone.  What is
left is verified with whole-number inner products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from newsmill.llm.common import ship, stored, table

K = 10
QUERY_EVERY = 100
SCALE = 1024
TILE_ROWS = 2048
BLOCK_ROWS = 256
#: Length steps: a bucket's lengths lie within a factor of 2^(1/STEPS).
STEPS = 8
#: Local cosine thresholds from which coordinates prune more than they cost.
COORDINATE_COSINE = 0.85
FOCUS = 3
_SLACK = 1e-9
_NO_BOUND = np.iinfo(np.int64).min


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of each component; rows that take no part are left out.

    Those are rows with a null id, a null vector or a null, NaN or infinite component.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    fine = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    v = v.filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).filter(fine)
    return v.select("vec_id", F.transform("x", lambda e: F.floor(e * scale).cast("long")).alias("v"))


def _squares(vector: str) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x)


def _packed(v: DataFrame, key: list, rows: int) -> DataFrame:
    """Tiles of about ``rows`` vectors that agree on ``key``: (key, tile, ids, vs)."""
    sizes = v.groupBy(*key).agg(F.ceil(F.count("*") / rows).cast("int").alias("n"))
    v = v.join(F.broadcast(sizes), key).withColumn("tile", F.pmod(F.xxhash64("vec_id"), "n").cast("int"))
    return v.groupBy(*key, "tile").agg(F.collect_list("vec_id").alias("ids"), F.collect_list("v").alias("vs"))


def _matrix(column: pa.Array, i: int) -> np.ndarray:
    rows = column[i].values
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def _ids(column: pa.Array, i: int) -> np.ndarray:
    return column[i].values.to_numpy(zero_copy_only=False)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers; in floating point where that is exact."""
    if q.size and c.size and float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def survivors(q: np.ndarray, length: float, c: np.ndarray, lengths: np.ndarray, need: float) -> np.ndarray:
    """Positions in a tile that may reach an inner product of ``need`` with q; lengths are those of the tile's vectors."""
    longest = float(lengths.max(initial=0.0))
    if not length or not longest:
        return np.arange(len(c)) if need <= 0 else np.empty(0, dtype=np.int64)
    cosine = need / (length * longest)
    if cosine > 1 + _SLACK:
        return np.empty(0, dtype=np.int64)
    may = np.flatnonzero(lengths * length * (1 + _SLACK) >= need)
    if cosine < COORDINATE_COSINE or not len(may):
        return may
    unit = q / length
    for f in np.argsort(-np.abs(unit))[:FOCUS]:
        # cos(a, b) <= a_f b_f + sqrt(1 - a_f^2) sqrt(1 - b_f^2), against what each vector itself needs
        b = c[may, f] / lengths[may]
        most = unit[f] * b + np.sqrt(max(0.0, 1 - unit[f] ** 2)) * np.sqrt(np.maximum(0.0, 1 - b * b))
        may = may[most + _SLACK >= need / (length * lengths[may])]
    return may


def _best(k: int):
    """Rows (q_ids, q_vs, bounds, ids, vs) -> the k best (query_id, vec_id, score) of each query in the tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, q, bounds = _ids(batch.column("q_ids"), i), _matrix(batch.column("q_vs"), i), _ids(batch.column("bounds"), i)
                ids, c = _ids(batch.column("ids"), i), _matrix(batch.column("vs"), i)
                lengths, q_lengths = np.sqrt((c.astype(np.float64) ** 2).sum(axis=1)), np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
                out = []
                for j in range(len(q_ids)):
                    may = np.arange(len(c)) if bounds[j] == _NO_BOUND else survivors(q[j].astype(np.float64), q_lengths[j], c, lengths, float(bounds[j]))
                    may = may[ids[may] != q_ids[j]]
                    if not len(may):
                        continue
                    score = products(q[j : j + 1], c[may])[0]
                    if len(score) > k:
                        least = np.partition(score, len(score) - k)[len(score) - k]
                        near = score >= least
                        may, score = may[near], score[near]
                    order = np.lexsort((ids[may], -score))[:k]
                    out.append((np.full(len(order), q_ids[j]), ids[may][order], score[order]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["query_id", "vec_id", "score"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_products(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows by inner product, ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``; candidates are all
    rows of another id and as many components.  Fewer than k candidates give
    fewer rows, none give none.  Rows without a whole finite vector take no
    part.  Repeated rows count each; a repeated query is answered once, by
    the vector of fewest components and, of those, of the smallest numbers.  Other
    columns are not read.
    """
    ship(vectors.sparkSession)
    v = stored(whole_vectors(vectors, scale).withColumn("dim", F.size("v")), "vectors")
    squares = _squares("v")
    bucket = F.when(squares > 0, F.floor(F.log2(squares) / 2 * STEPS)).otherwise(-1).cast("int")
    tiles = stored(_packed(v.withColumn("bucket", bucket), ["dim", "bucket"], TILE_ROWS), "vector-tiles")
    asking = v.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("s")).select("vec_id", "s.*")
    blocks = _packed(asking, ["dim"], BLOCK_ROWS)
    blocks = stored(blocks.select("dim", F.col("tile").alias("block"), F.col("ids").alias("q_ids"), F.col("vs").alias("q_vs")), "query-blocks")

    no_bounds = F.transform("q_ids", lambda _: F.lit(_NO_BOUND).cast("long"))
    longest = tiles.groupBy("dim").agg(F.max_by(F.struct("bucket", "tile"), F.struct("bucket", F.size("ids"))).alias("t"))
    first = longest.select("dim", "t.bucket", "t.tile").join(tiles, ["dim", "bucket", "tile"])
    first = blocks.join(first, "dim").select("q_ids", "q_vs", no_bounds.alias("bounds"), "ids", "vs")
    out = "query_id long, vec_id long, score long"
    seen = first.mapInArrow(_best(k), out).groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("scores"))
    bound = stored(seen.select("query_id", F.coalesce(F.get("scores", F.lit(k - 1)), F.lit(_NO_BOUND)).alias("bound")), "bounds")

    one = blocks.select("dim", "block", F.posexplode(F.arrays_zip("q_ids", "q_vs")).alias("at", "q"))
    one = one.select("dim", "block", "at", F.col("q.q_ids").alias("query_id"), F.sqrt(_squares("q.q_vs")).alias("length")).join(bound, "query_id", "left")
    # a tile whose longest vector is shorter than what a query needs can't hold one of its best
    need = F.when((F.col("bound") > 0) & (F.col("length") > 0), F.col("bound") / F.col("length")).otherwise(0.0)
    one = one.groupBy("dim", "block").agg(
        F.sort_array(F.collect_list(F.struct("at", F.coalesce("bound", F.lit(_NO_BOUND)).alias("b")))).alias("s"), F.min(need).alias("need")
    )
    bounded = blocks.join(one, ["dim", "block"]).select("dim", "q_ids", "q_vs", F.col("s.b").alias("bounds"), "need")
    # each block of the stated queries meets at most once each tile that may hold a vector for it: blocks go to the tiles' places
    places = tiles.select("dim", "bucket", "tile", (F.pow(F.lit(2.0), (F.col("bucket") + 1) / STEPS) * (1 + 1e-6)).alias("longest"))
    asked = bounded.join(places, "dim").filter("longest >= need").drop("longest", "need")
    pairs = asked.join(tiles, ["dim", "bucket", "tile"]).select("q_ids", "q_vs", "bounds", "ids", "vs")
    found = _ranked(pairs.mapInArrow(_best(k), out), k)
    return found.select("query_id", "rank", "vec_id", "score")


def op9_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"))


OP9_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null
  and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 10"""
