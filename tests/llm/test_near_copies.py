"""Near copies of given documents with a measured Jaccard similarity are found."""

from __future__ import annotations

import random

from newsmill.llm import simhash

DIR = "/root/testdata/sf0.01"
WORDS = 5


def shingles(words: list[str]) -> set[tuple]:
    return {tuple(words[k : k + WORDS]) for k in range(len(words) - WORDS + 1)}


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b)


def copied(words: list[str], goal: float, rng: random.Random) -> list[str]:
    """Words replaced one by one as long as the similarity to the whole stays at ``goal`` or more."""
    whole, copy = shingles(words), list(words)
    while True:
        at = rng.randrange(len(copy))
        further = [*copy[:at], f"zq{rng.randrange(10**6)}", *copy[at + 1 :]]
        if jaccard(whole, shingles(further)) < goal:
            return copy
        copy = further


def test_nine_of_ten_near_copies_are_found(spark):
    rng = random.Random(11)
    texts = sorted({r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").select("text").collect() if r.text})
    rows, n = [], 0
    for text in texts:
        words = text.lower().split()
        if 40 <= len(words) <= 1000:
            copy = copied(words, rng.uniform(0.8, 0.9), rng)
            if copy != words:
                rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(copy))]
                n += 1
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert n >= 200
    assert sum(found[2 * k] == found[2 * k + 1] for k in range(n)) >= 0.9 * n
