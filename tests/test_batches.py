"""Work that is added up or handed over by batches of rows."""

from __future__ import annotations

import re
from collections import Counter

from newsmill.llm import ranked as R
from newsmill.operators import language as N
from newsmill.sources.text_index import TextIndex


def test_posting_lists_are_made_for_a_batch_not_for_a_document(spark, tmp_path):
    rows = spark.createDataFrame([(0, i, ["new", "catalysts", "catalyst", f"w{i}"] if i % 7 else None) for i in range(70)], "block long, place int, words array<string>").coalesce(1)
    found = {r.stem: r.places for r in TextIndex(spark, str(tmp_path / "index"))._lists(rows).collect()}
    held = [i for i in range(70) if i % 7]
    assert found["catalyst"] == held and found["new"] == held and len(found) == 2 + len(held)


def test_language_training_reads_the_texts_once(spark, tmp_path):
    texts = [(f"l{i % 2}", f"{'ab' * i} cdé {i}") for i in range(40)]
    spark.createDataFrame(texts, "lang string, text string").write.parquet(str(tmp_path / "texts"))
    found = N.language_profiles(spark.read.parquet(str(tmp_path / "texts")))
    assert "parquet" not in found._jdf.queryExecution().toString().lower()
    counts = Counter((lang, t[k : k + 3]) for lang, text in texts for t in [" " + re.sub("[^a-zé]+", " ", text) + " "] for k in range(len(t) - 2))
    assert all(counts[r.lang, r.gram] == r.n for r in found.collect())


def test_ranked_search_of_batches_larger_than_what_is_handed_over(spark):
    n = 2 * R._HANDED + 100
    docs = spark.createDataFrame([(i, f"alpha {'beta ' * (i % 5)} word{i}") for i in range(n)], "doc_id long, text string")
    items = spark.createDataFrame([(1, f"beta word{n - 7}"), (2, "alpha")], "item_id long, text string")  # a word of all documents weighs nothing
    one, many = ([tuple(r) for r in R.ranked_search(docs.repartition(k), items).orderBy("item_id", "rank").collect()] for k in (1, 40))
    assert one == many and len(one) == 10 and one[0][2] == n - 7
