"""The inverted index finds what a scan of all words finds, and reads only the buckets of its words."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from newsmill.functions.stems import english_stem, russian_stem, stem
from newsmill.operators import listing as L
from newsmill.plans import fixtures as X, search_queries as Q
from newsmill.sources.text_index import TextIndex, unstemmed
from tests.test_queries import plan


@pytest.mark.parametrize(("word", "expected"), [
    ("consigned", "consign"), ("consistency", "consist"), ("knackeries", "knackeri"), ("relational", "relat"), ("hopping", "hop"), ("hoping", "hope"),
    ("happy", "happi"), ("cry", "cri"), ("by", "by"), ("say", "say"), ("flies", "fli"), ("ties", "tie"), ("gas", "gas"), ("gaps", "gap"), ("electricity", "electr"),
    ("adoption", "adopt"), ("generously", "generous"), ("communication", "communic"), ("skies", "sky"), ("news", "news"), ("proceed", "proceed"), ("agreed", "agre"),
    ("luxuriated", "luxuri"), ("bliss", "bliss"), ("yellow", "yellow"), ("controlled", "control"),
])
def test_english_stems(word, expected):
    assert english_stem(word) == expected


@pytest.mark.parametrize(("word", "expected"), [
    ("важная", "важн"), ("важнейшие", "важн"), ("вавиловка", "вавиловк"), ("валентином", "валентин"), ("вдохновение", "вдохновен"), ("поймавшись", "пойма"),
    ("противоестественном", "противоестествен"), ("новости", "новост"), ("новостей", "новост"), ("агентов", "агент"), ("говорила", "говор"), ("химии", "хим"), ("ёлка", "елк"), ("материал", "материа"), ("материалов", "материал"), ("вскр", "вскр"),
])
def test_russian_stems(word, expected):
    assert russian_stem(word) == expected


def test_other_words_stay():
    assert [stem(w) for w in ("v3", "2024", "größen", "化学")] == ["v3", "2024", "größen", "化学"]


def ids(d):
    return sorted(r[0] for r in d.collect())


def test_search_equals_the_scan_and_brute_force(spark, sf_dir, tmp_path):
    news = X.news(spark, sf_dir).select("id", "title", "summary", "content", "translation")
    rows = news.select("id", L.search_text().alias("text"))
    plain, stemmed = TextIndex(spark, str(tmp_path / "plain"), unstemmed, 16), TextIndex(spark, str(tmp_path / "stemmed"), stem, 16)
    assert plain.append(0, rows) and stemmed.append(0, rows) and not stemmed.append(0, rows)
    texts = [(r.id, {w for w in re.split(r"[\W_]+", r.text.lower()) if w}) for r in rows.collect()]
    for asked in ("machine learning", "  The GPT, agent ", "material", "новый химический", "nowhere machine", "the of", "", "материалов"):
        assert ids(plain.search(asked)) == ids(news.filter(L.fts_match(asked)).select("id")), asked
        words = L.query_lexemes(asked)
        wanted = {stem(w) for w in words or []}
        assert ids(stemmed.search(asked)) == ([] if words == [] else sorted(i for i, t in texts if wanted <= {stem(w) for w in t})), asked
    assert ids(stemmed.search("новые химические синтезы")) and not ids(plain.search("новые химические синтезы"))
    counts = {}
    for _, t in texts:
        for s in {stem(w) for w in t}:
            counts[s] = counts.get(s, 0) + 1
    assert {r.stem: r.n for r in stemmed.documents_per_stem().collect()} == counts


def test_search_reads_the_buckets_of_its_words(spark, sf_dir, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"), unstemmed, 64)
    index.append(0, X.news(spark, sf_dir).select("id", L.search_text().alias("text")))
    (folder,) = index._batches().values()
    read = {f.rsplit("bucket=", 1)[1].split("/")[0] for f in index.postings(folder, ["machine", "learning"]).inputFiles()}
    touched = {str(r[0]) for r in index.postings(folder, ["machine", "learning"]).select("bucket").distinct().collect()}
    assert len(read) == 64 and len(touched) <= 2
    shown = plan(index.search("machine learning"))
    assert re.search(r"PartitionFilters: \[[^\n]*bucket", shown) and "documents.parquet" not in shown


def test_batches_blocks_and_odd_rows(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"), stem, 4)
    assert ids(index.search("cat")) == [] and index.documents_per_stem().count() == 0
    first = [(1, "Cats run", "x"), (1, "cats run", "x"), (70_000, "a cat", "x"), (-5, "CAT", "x"), (2, None, "x"), (3, "", "x"), (None, "cat", "x"), (9_000_000_000, "cat_run", "x"), (4, "cat " * 200_000, "x")]
    index.append(0, spark.createDataFrame(first, "id long, text string, stem string"))
    assert ids(index.search("cat")) == [-5, 1, 4, 70_000, 9_000_000_000]
    assert ids(index.search("running CATS")) == [1, 9_000_000_000]
    assert ids(index.search(" ")) == [-5, 1, 2, 3, 4, 70_000, 9_000_000_000]
    index.append(1, spark.createDataFrame([(1, "dogs"), (8, "cat")], "id long, text string"))
    assert ids(index.search("cat")) == [-5, 4, 8, 70_000, 9_000_000_000] and ids(index.search("dog")) == [1]
    index.append(2, spark.createDataFrame([], "id long, text string"))
    assert ids(index.search("dog")) == [1]
    # a write that was cut short leaves a folder that no record names
    spark.createDataFrame([("cat", 0, 1, [77], 0)], "stem string, block long, n int, places array<int>, bucket int").write.partitionBy("bucket").parquet(f"{index.folder}/batch-dead/postings")
    assert 77 not in ids(index.search("cat"))


def test_registered_search(spark, sf_dir):
    by_id = {r.id: r.text for r in X.news(spark, sf_dir).select("id", L.search_text().alias("text")).collect()}
    found = ids(Q.fts_stemmed(spark, sf_dir).select("id"))
    published = ids(L.news_filter(X.news(spark, sf_dir), X.now()).select("id"))
    wanted = {stem(w) for w in ("new", "catalysts", "discovering")}
    assert found == [i for i in published if wanted <= {stem(w) for w in re.split(r"[\W_]+", by_id[i].lower()) if w}] and found
