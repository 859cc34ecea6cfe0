"""Tiles, signatures and the bounded edit distance of similar titles against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import lev, similar, titles

from newsmill.operators import dedup as D, similar as S


def test_edit_distance_stops_only_beyond_the_budget():
    rng = random.Random(3)
    for _ in range(400):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(1, 60)))
        b = list(a)
        for _ in range(rng.randint(0, 12)):
            k = rng.randrange(len(b) + 1)
            b[k : k + 1] = rng.choice([[], ["x"], ["y", "z"]])
        b, most = "".join(b), rng.randint(0, 15)
        d = lev(a, b)
        expected = d if d <= most else -1
        assert S.edit_distance(a, b, most) == expected == S.edit_distance(a, b, most, S.letters_of(a))


def test_signatures_differ_by_no_more_than_the_edits_allow():
    rng = random.Random(4)
    for _ in range(50):
        a = "".join(rng.choice("abcd ") for _ in range(rng.randint(10, 300)))
        b, edits = list(a), rng.randint(1, 12)
        for _ in range(edits):
            k = rng.randrange(len(b))
            b[k : k + 1] = rng.choice([[], ["x"], [b[k], "y"]])
        for q, _ in (S.COARSE, S.FINE):
            x, y = S.signatures([a, "".join(b)], q, 1024)
            assert np.bitwise_count(x ^ y).sum() <= 2 * q * edits


def test_few_pairs_of_unrelated_titles_are_compared():
    """Titles of the same frequent syllables share short pieces everywhere, but hardly any pair is looked at."""
    rng = random.Random(5)
    parts = ["the", "and", "tion", "er", "ing", "of", "in", "ed", "on", "reat", "ble", "ha", "es", "st", "ou", "ly", "th", "at"]
    keys = list({" ".join(rng.choice(parts) + rng.choice(parts) for _ in range(30)) for _ in range(300)})
    tile = S.Tile(keys)
    looked_at = sum(len(u) for u, _ in S._left(tile, tile, 85, True))
    assert looked_at < len(keys) * len(keys) / 100


@pytest.mark.parametrize("size", [40, 1 << 16])
def test_similar_keys_of_two_tables_and_small_tiles(spark, monkeypatch, size):
    monkeypatch.setattr(D, "_TILE_LETTERS", (size, 700 if size == 40 else 1 << 24))
    keys = sorted({t for t in titles(90, 11) if t})
    left, right = keys[: len(keys) * 2 // 3], keys[len(keys) // 3 :]
    one, two = (spark.createDataFrame([(k,) for k in side], "k string") for side in (left, right))
    found = [(r.left_key, r.right_key) for r in D.similar_keys(one, two).collect()]
    assert sorted(found) == sorted((a, b) for a in left for b in right if similar(a, b))
    found = [(r.left_key, r.right_key) for r in D.similar_keys(one, one).collect()]
    assert sorted(found) == sorted((a, b) for a in left for b in left if similar(a, b))


def near(rng: random.Random, key: str, edits: int, letters: str) -> str:
    out = list(key)
    for _ in range(edits):
        k = rng.randrange(len(out) + 1)
        out[k : k + 1] = rng.choice([[], [rng.choice(letters)], [rng.choice(letters), rng.choice(letters)], out[k : k + 1] * 2])
    return "".join(out)


@pytest.mark.parametrize("table_bytes", [1 << 12, 1 << 26])
def test_distances_of_many_pairs_are_the_edit_distances(monkeypatch, table_bytes):
    monkeypatch.setattr(S, "_TABLE_BYTES", table_bytes)
    rng = random.Random(6)
    one = ["".join(rng.choice("ab cé漢😀") for _ in range(rng.randint(1, 230))) for _ in range(60)]
    a, b = S.Tile(one), S.Tile([near(rng, k, rng.randrange(len(k) // 5 + 2), "xab漢😀") or "q" for k in one] + one[:20])
    u, v = (x.ravel() for x in np.indices((len(a.keys), len(b.keys))))
    most = np.array([rng.randrange(60) for _ in u])
    ok = abs(a.n[u] - b.n[v]) <= most
    u, v, most = u[ok][::5], v[ok][::5], most[ok][::5]
    exact = np.array([lev(a.keys[i], b.keys[j]) for i, j in zip(u, v, strict=True)])
    for words in (1, 2):
        assert S._distances(a, b, u, v, most, words).tolist() == np.where(exact <= most, exact, -1).tolist()
        early = S._distances(a, b, u, v, most, words, 20)
        assert ((early == exact) | (early == 0) | ((early == -1) & (exact > most))).all() and (early == -1).any()


@pytest.mark.parametrize("cells, waiting, few", [(1 << 6, 5, 1), (1 << 16, 1 << 12, 24)])
def test_near_pairs_are_those_of_brute_force(monkeypatch, cells, waiting, few):
    """Groups of alike keys on both sides of a signature's width, in small blocks and in large ones."""
    for name, value in {"_CELLS": cells, "_TRIAL": min(cells, 1 << 12), "_ROWS": (1, 8), "_ALIKE": (3, 20), "_WAITING": waiting, "_FEW": few, "_LONG": 64}.items():
        monkeypatch.setattr(S, name, value)
    rng = random.Random(7)
    keys = set()
    for letters in ("abc ", "xyz é", "ab漢😀"):
        for size in (6, 9, 14, 16, 17, 31, 33, 60, 66, 90):
            first = "".join(rng.choice(letters) for _ in range(size))
            keys |= {near(rng, first, rng.randrange(size // 5 + 1), letters) for _ in range(7)}
    keys = sorted(k for k in keys if len(k) >= 6)
    one, two = keys[: len(keys) * 2 // 3], keys[len(keys) // 3 :]
    a, b = S.Tile(one), S.Tile(two)
    expected = {(x, y): lev(x, y) for x in one for y in two if x != y and abs(len(x) - len(y)) <= 14 and similar(x, y)}
    assert {(x, y): d for p in S.near_pairs(a, b, 85) for x, y, d in zip(*p, strict=True)} == expected
    found = [(*sorted((x, y)), d) for p in S.near_pairs(a, a, 85) for x, y, d in zip(*p, strict=True)]
    assert sorted(found) == sorted((x, y, lev(x, y)) for x in one for y in one if x < y and abs(len(x) - len(y)) <= 14 and similar(x, y))


def test_few_pairs_of_long_unrelated_titles_are_compared():
    """Long titles of the same syllables have most groups of four letters in common."""
    rng = random.Random(8)
    parts = ["".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 3))) for _ in range(30)]
    keys = list({" ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(170)) for _ in range(250)})
    tile = S.Tile(keys)
    looked_at = sum(len(u) for u, _ in S._left(tile, tile, 85, True))
    assert looked_at < len(keys) * len(keys) / 100


def test_few_pairs_are_measured_one_by_one(monkeypatch):
    """Copies of a long title with a word or two changed: thousands of similar pairs, for which Python takes no loop."""
    rng = random.Random(10)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    keys = set()
    while len(keys) < 120:
        copy = list(words)
        for _ in range(2):
            copy[rng.randrange(len(copy))] = "".join(rng.choice("abcdefgh") for _ in range(5))
        keys.add(" ".join(copy))
    calls, single = [], S.edit_distance
    monkeypatch.setattr(S, "edit_distance", lambda *x: calls.append(x) or single(*x))
    tile = S.Tile(sorted(keys))
    found = sum(len(x) for x, _, _ in S.near_pairs(tile, tile, 85))
    assert found == 120 * 119 // 2 and len(calls) < found / 10


@pytest.mark.parametrize("sides", [1, 2])
def test_each_pair_of_tiles_is_a_task_of_its_own_and_the_longest_come_first(spark, monkeypatch, sides):
    monkeypatch.setattr(D, "_TILE_LETTERS", (1000, 1000))
    rng = random.Random(12)
    keys = {"".join(rng.choice("ab") for _ in range(rng.randint(6, 40))) for _ in range(24)}
    keys |= {k + "a" for k in keys}
    tables = [spark.createDataFrame([(len(k), k) for k in sorted(keys)], "n int, key string") for _ in range(sides)]
    lengths = sorted((n, sides * sum(len(k) == n for k in keys)) for n in {len(k) for k in keys})
    places, pairs = D._tiling(lengths, 85, sides == 2)
    near = D._near_keys(tables[0], tables[-1], 85)
    assert near.rdd.getNumPartitions() == len(pairs)
    first = {n: f for n, f, _ in places}
    found: dict[int, set] = {}
    for r in near.withColumn("task", F.spark_partition_id()).collect():
        found.setdefault(r.task, set()).add(tuple(sorted((first[len(r.left_key)], first[len(r.right_key)]))))
    assert len(found) > 5 and all(len(x) == 1 for x in found.values())
    assert D._tiling([(10, 1), (30, 1), (100, 3)], 85, False)[1] == [(0, 1, 1), (1, 0, 0)]


def test_the_history_is_read_once(spark, tmp_path):
    spark.range(20).selectExpr("id as match_id", "concat('a title of number ', id) as t").write.parquet(str(tmp_path / "past"))
    new = spark.createDataFrame([(1, "u", "a title of number 77")], "id long, url string, title string")
    out = D.dedup_against_history(new, spark.read.parquet(str(tmp_path / "past")), spark.createDataFrame([("v",)], "url string"), F.col("title"), F.col("t"))
    assert str(tmp_path) not in out._jdf.queryExecution().toString()
    assert out.first().reason == "semantic-title"
