"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are laid into tiles by the population counts of their
parts.  Two fingerprints at most ``radius`` bits apart have counts whose
differences sum to at most ``radius``, so only tiles that close are compared,
each pair of tiles in one numpy exclusive-or with bit counts.  A tile pair
returns a spanning forest of its links, never all linked pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from newsmill.llm.common import id_and_text, long_lists, roots, ship, stored, table
from newsmill.llm.components import components

TILE_ROWS = 2048
_CHUNK = 1 << 16


def shingle_hashes(text: str | None, words: int, seed: int) -> np.ndarray:
    """XXH64 of every run of ``words`` words; of all words if there are fewer."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    joined, h = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([h(joined, seed)], dtype=np.uint64)
    ends = list(itertools.accumulate(map(len, found), lambda a, b: a + 1 + b))
    starts = [0, *(e + 1 for e in ends[: len(found) - words])]
    return np.fromiter((h(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :])), np.uint64, len(starts))


def majority_bits(hashes: np.ndarray) -> int:
    """The 64-bit number whose bits are set in over half of ``hashes``; 0 for none."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = np.ascontiguousarray(hashes[at : at + _CHUNK])
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int, seeds: tuple[int, ...] = (42,), parts: int = 4, by_size: float = 0.0) -> DataFrame:
    """(doc_id, version, fp array<long>, key array<int>): a 64-bit SimHash for each seed, and its tile key.

    ``version`` is a hash of the text, which tells apart different texts of one id.

    The key is the population counts of ``parts`` equal parts of each word or,
    with ``by_size`` = s, the step of the shingle count on a scale of factor 1/s;
    shingles then count once however often they are repeated, and a column node
    array<long> follows: fp and a hash of the set of shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, keys = np.zeros((batch.num_rows, len(seeds)), dtype=np.uint64), []
            sets = np.zeros((batch.num_rows, 1), dtype=np.uint64)
            for i, text in enumerate(batch.column("text")):
                text, n = text.as_py(), 0
                for k, seed in enumerate(seeds):
                    hashes = shingle_hashes(text, words, seed)
                    if by_size:
                        hashes = np.unique(hashes)
                        if k == 0:
                            sets[i, 0] = xxhash.xxh64_intdigest(hashes.tobytes())
                    prints[i, k], n = majority_bits(hashes), len(hashes)
                if by_size:
                    keys.append(int(np.log(max(n, 1)) / -np.log(by_size)))
            if by_size:
                key = np.array(keys, dtype=np.int32).reshape(-1, 1)
            else:
                width = 64 // parts
                shifts = np.arange(parts, dtype=np.uint64) * np.uint64(width)
                piece = (prints[:, :, None] >> shifts) & np.uint64((1 << width) - 1)
                key = np.bitwise_count(piece).reshape(batch.num_rows, -1).astype(np.int32)
            n, wide = key.shape
            key = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * wide), pa.array(key.reshape(-1)))
            out = [batch.column("doc_id"), batch.column("version"), long_lists(prints), key]
            if by_size:
                out.append(long_lists(np.concatenate((prints, sets), axis=1)))
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "version", "fp", "key", "node"][: len(out)])

    ship(docs.sparkSession)
    d = id_and_text(docs).withColumn("version", F.xxhash64("text"))
    return d.mapInArrow(run, "doc_id long, version long, fp array<long>, key array<int>" + (", node array<long>" if by_size else ""))


def neighbour_offsets(parts: int, radius: int) -> list[list[int]]:
    """Differences between count vectors that sum to at most ``radius``; of d and -d only one."""
    found: list[list[int]] = [[]]
    for _ in range(parts):
        found = [[*o, d] for o in found for d in range(-radius, radius + 1) if sum(map(abs, o)) + abs(d) <= radius]
    return [o for o in found if next((d for d in o if d), 1) > 0]


def _tile(column: pa.Array, i: int) -> np.ndarray:
    rows = column[i].values
    flat = rows.flatten()
    return flat.to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(rows), -1)


def tile_links(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between the rows of two tiles, as positions in (a, b)."""
    us, vs, step = [], [], max(1, (1 << 18) // len(b))
    for at in range(0, len(a), step):
        part = a[at : at + step]
        apart = np.bitwise_count(part[:, :1] ^ b[:, 0]).astype(np.uint16 if a.shape[1] > 1 else np.uint8, copy=False)
        for k in range(1, a.shape[1]):
            apart += np.bitwise_count(part[:, k : k + 1] ^ b[:, k])
        u, v = np.nonzero(apart <= radius)
        if len(u):
            us.append(u + at)
            vs.append(v + len(a))
    if not us:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    parent = roots(len(a) + len(b), np.concatenate(us), np.concatenate(vs))
    moved = np.flatnonzero(parent != np.arange(len(parent)))
    return moved, parent[moved]


def links(prints: DataFrame, offsets: list[list[int]], radius: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Distinct (fp, key) -> links (u, v) that connect exactly what lies within ``radius`` bits.

    ``offsets`` are the key differences to be compared.  A key with many
    fingerprints has several tiles, and each pair of tiles is a row of its own,
    so that a crowded key is spread over tasks.  The table of keys that is
    broadcast has one row for each possible key at most: 17^4 for four 16-bit
    counts, a few dozen for shingle counts.
    """
    keys = prints.groupBy("key").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("n"))
    tiles = (
        prints.join(F.broadcast(keys), "key")
        .groupBy("key", F.pmod(F.xxhash64("fp"), "n").cast("int").alias("tile"))
        .agg(F.collect_list("fp").alias("rows"))
    )
    tiles = stored(tiles, "tiles")
    steps = F.array(*[F.struct(F.array(*map(F.lit, o)).alias("by"), F.lit(not any(o)).alias("own")) for o in offsets])
    width = len(offsets[0])
    other = tiles.select("key", "tile", "rows", F.explode(steps).alias("step")).select(
        F.array(*[F.col("key")[i] + F.col("step.by")[i] for i in range(width)]).alias("key"),
        F.col("tile").alias("from_tile"), F.col("rows").alias("other"), F.col("step.own").alias("own"),
    )
    other = other.join(F.broadcast(keys), "key").select(
        "key", "other",
        F.explode(F.sequence(F.lit(0), F.when(F.col("own"), F.col("from_tile")).otherwise(F.col("n") - 1))).alias("tile"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for i in range(batch.num_rows):
                a, b = _tile(batch.column("rows"), i), _tile(batch.column("other"), i)
                u, v = tile_links(a, b, radius)
                if len(u):
                    nodes = np.concatenate((a, b))
                    left.append(nodes[u])
                    right.append(nodes[v])
            if left:
                yield pa.RecordBatch.from_arrays([long_lists(np.concatenate(left)), long_lists(np.concatenate(right))], ["u", "v"])

    pairs = tiles.join(other, ["key", "tile"]).select("rows", "other")
    return pairs.mapInArrow(run, "u array<long>, v array<long>").filter("u <> v")


def _named(prints: DataFrame, found: DataFrame, by: str) -> DataFrame:
    """(``by``, root, component_id) for each value of that column: the component that ``found`` (node, root) gives it and its smallest id."""
    first = prints.filter("doc_id is not null").groupBy(by).agg(F.min("doc_id").alias("first_id"))
    first = first.join(found, first[by] == found["node"], "left").select(
        first[by], "first_id", F.coalesce(found["root"], first[by]).alias("root")
    )
    lowest = first.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return first.join(lowest, "root").select(by, "root", "component_id")


def _with_components(prints: DataFrame, found: DataFrame, by: str = "fp") -> DataFrame:
    return prints.join(_named(prints, found, by), by, "left").select(
        "doc_id", "version", "fp", *[F.when(F.col("doc_id").isNotNull(), F.col(c)).alias(c) for c in ("component_id", "root")]
    )


def near_duplicates(docs: DataFrame, words: int = 3, seeds: tuple[int, ...] = (42,), radius: int = 3, parts: int = 4) -> DataFrame:
    """(doc_id, version, fp array<long>, component_id): one row per input row.

    Words are what lies between ASCII white space, A-Z lower-cased; shingles keep
    their repeats.  Null, empty and blank texts have fingerprint 0 and are
    linked like any other.  component_id is the smallest doc_id reachable over
    fingerprints at most ``radius`` bits apart.  Rows with a null doc_id get a
    fingerprint, form no links and have a null component_id.  Repeated rows
    stay; an id with different texts has a component for each.  Other columns
    are not read.  An empty table gives an empty result.
    """
    prints = stored(fingerprints(docs, words, seeds, parts), "prints")
    distinct = stored(prints.filter("doc_id is not null").select("fp", "key").distinct(), "distinct")
    found = components(links(distinct, neighbour_offsets(parts * len(seeds), radius), radius))
    return _with_components(prints, found).drop("root")


SIMILAR_SEEDS = (42, 43, 44, 45)
#: Of 256 bits; texts with a Jaccard similarity of 0.8 are 38.8 bits apart in the mean, with a deviation of 5.7.
SIMILAR_RADIUS = 54
VERIFY_ROWS = 256


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def verified_links(members: DataFrame, radius: int, similarity: float) -> DataFrame:
    """(group, node, shingles) -> links (u, v) between nodes of a group whose shingle sets are similar.

    A group is cut into tiles and each pair of tiles is a row.  Of the pairs
    whose fingerprints are within ``radius``, nearest first, those not yet connected in
    the tile pair are compared in full, also where fingerprints are equal; so what
    is skipped is connected anyway.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for mine, other in zip(batch.column("rows"), batch.column("other")):
                rows = [r for side in (mine, other) for r in side.values.to_pylist()]
                fps = np.array([r["node"][:-1] for r in rows], dtype=np.int64).view(np.uint64)
                sets = [np.array(r["shingles"], dtype=np.int64) for r in rows]
                n = len(mine.values)
                apart = sum(np.bitwise_count(fps[:n, None, k] ^ fps[None, n:, k]).astype(np.uint16) for k in range(fps.shape[1]))
                u, v = np.nonzero(apart <= radius)
                order = np.argsort(apart[u, v], kind="stable")
                up = list(range(len(rows)))

                def top(i: int, up: list[int] = up) -> int:
                    while up[i] != i:
                        up[i] = i = up[up[i]]
                    return i

                for i, j in zip(u[order].tolist(), (v[order] + n).tolist()):
                    if top(i) != top(j) and (rows[i]["node"] == rows[j]["node"] or _jaccard(sets[i], sets[j]) >= similarity):
                        up[top(i)] = top(j)
                        left.append(rows[i]["node"])
                        right.append(rows[j]["node"])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.int64())) for x in (left, right)], ["u", "v"])

    sizes = members.groupBy("group").agg(F.ceil(F.count("*") / VERIFY_ROWS).cast("int").alias("n"))
    tiles = members.join(sizes, "group").groupBy("group", "n", F.pmod(F.xxhash64("node"), "n").cast("int").alias("tile"))
    tiles = stored(tiles.agg(F.collect_list(F.struct("node", "shingles")).alias("rows")), "similar-tiles")
    other = tiles.select("group", F.col("rows").alias("other"), F.explode(F.sequence(F.lit(0), "tile")).alias("tile"))
    pairs = tiles.join(other, ["group", "tile"]).select("rows", "other")
    return pairs.mapInArrow(run, "u array<long>, v array<long>").filter("u <> v")


def similar_documents(
    docs: DataFrame, words: int = 5, similarity: float = 0.8, seeds: tuple[int, ...] = SIMILAR_SEEDS, radius: int = SIMILAR_RADIUS
) -> DataFrame:
    """(doc_id, version, fp, component_id, root) as near_duplicates, linking texts whose shingle sets have a Jaccard similarity.

    ``root`` tells components apart, also those that share their smallest id.

    Wide fingerprints of the distinct shingles find candidates by tiled comparison,
    only where their counts allow the similarity; the sets are then compared, also those
    of equal fingerprints.  Texts with equal sets are similar, also those without words.
    """

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), words, seeds[0])).view(np.int64) for t in batch.column("text")]
            yield batch.drop_columns(["text"]).append_column("shingles", pa.array(sets, pa.list_(pa.int64())))

    prints = stored(fingerprints(docs, words, seeds, by_size=similarity), "prints")
    known = prints.filter("doc_id is not null")
    distinct = stored(known.groupBy("fp", "key", "node").agg(F.min(F.struct("doc_id", "version")).alias("first")), "distinct")
    linked = components(links(distinct.select("fp", "key").distinct(), [[0], [1]], radius))
    # an fp of several sets is a group even if no other is near it
    shared = distinct.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").join(linked, F.col("fp") == linked["node"], "left_anti")
    groups = linked.unionAll(linked.select(F.col("root").alias("node"), "root")).distinct().select(F.col("node").alias("fp"), F.col("root").alias("group"))
    groups = stored(groups.unionAll(shared.select("fp", F.col("fp").alias("group"))).distinct(), "groups")
    firsts = distinct.join(groups, "fp").select("first.doc_id", "first.version", "node", "group")
    texts = id_and_text(docs).withColumn("version", F.xxhash64("text")).join(firsts, ["doc_id", "version"])
    members = texts.select("group", "node", "text").mapInArrow(shingles, "group array<long>, node array<long>, shingles array<long>")
    return _with_components(prints, components(verified_links(members, radius, similarity)), "node")


def without_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` less all but one of each group of similar documents: the one of the smallest id stays.

    Rows with a null id stay.  Repeated rows are one group.  An id of unlike texts is in several groups and may stay for each.
    """
    found = similar_documents(docs, words, similarity).filter("doc_id is not null")
    stay = found.groupBy("root").agg(F.min(F.struct("doc_id", "version")).alias("s")).select("s.doc_id", "s.version")
    d = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("v"))
    kept = d.join(stay, (d["id"] == stay["doc_id"]) & (d["v"] == stay["version"]), "left_semi")
    one = Window.partitionBy("id", "v").orderBy("id")
    kept = kept.withColumn("n", F.row_number().over(one)).filter("n = 1")
    return kept.select("row.*").unionAll(d.filter("id is null").select("row.*"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), "component_id")
