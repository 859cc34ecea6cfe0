"""Ranked search, URL filter and infill against brute force, over awkward rows."""

from __future__ import annotations

import contextlib
import hashlib
import io
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsmill.llm import infill, ranked, urlfilter

WORDS = ["alpha", "Beta", "gamma", "délta", "straße", "ÉCOLE", "x1", "99", "ok", "the", "of", "日本"]
CLASHING = "n long, term string, terms string, form string, cut string, host string, canonical string, block int, passes int, listed int, w0 long, h int, sketch int"


def with_clashes(spark, rows, schema):
    """Rows with more columns, named like those that the operators make."""
    extra = (1, "t", "t", "f", "c", "h", "c", 2, 3, 4, 5, 6, 7)
    own = {c.split()[0] for c in schema.split(", ")}
    keep = [(c, v) for c, v in zip(CLASHING.split(", "), extra) if c.split()[0] not in own]
    return spark.createDataFrame([(*r, *(v for _, v in keep)) for r in rows], ", ".join([schema, *(c for c, _ in keep)]))


def texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(4)
    prose = lambda n: "".join(rng.choice(WORDS) + rng.choice([" ", ", ", "\n", "\t\x0b", "-"]) for _ in range(n))
    out = [None, "", "  ", " \n", "...", "one", " one", "one ", "<P> marked", "a<M>b c", *(prose(n) for n in (1, 2, 3, 5, 8, 20, 60, 60, 300)), prose(30_000), "the " * 300, "the " * 300, "a" * 70_000 + " b", "a " * 70_000]
    rows = list(enumerate(out))
    return [*rows, rows[12], rows[12], (None, "the alpha"), (3, "alpha beta with another text"), (-7, "alpha"), (2**40, "alpha")]


# ---------------------------------------------------------------------------


def terms(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute_search(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    queries: dict[int, set] = {}
    for i, t in items:
        if i is not None:
            queries.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in queries.items():
        found = []
        for doc_id, c in held:
            m = 10 + 90 * sum(c.values()) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if t in c)
            if score > 0 and doc_id is not None:
                found.append((-score, doc_id))
        out += [(item, rank, doc_id, -score) for rank, (score, doc_id) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def test_ranked_search_equals_brute_force(spark):
    items = [(1, "the ALPHA straße"), (2, "ÉCOLE 99 x1"), (3, None), (4, "unheard"), (None, "alpha"), (5, "日本 beta gamma alpha"), (5, "of"), (6, ""), (7, "alpha"), (7, "alpha")]
    docs = with_clashes(spark, texts(), "doc_id long, text string").repartition(3)
    asked = with_clashes(spark, items, "item_id long, text string")
    expected = brute_search(texts(), items)
    for block_terms in (1, 1 << 14):
        found = ranked.ranked_search(docs, asked, block_terms=block_terms)
        assert found.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, found.collect())) == expected


def test_ranked_search_of_many_documents(spark):
    rng = random.Random(1)
    vocabulary = [f"w{int(rng.paretovariate(0.6))}" for _ in range(3000)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice((3, 30, 200))))) for i in range(600)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(12))) for i in range(20)]
    found = ranked.ranked_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, found.collect())) == brute_search(docs, items)


def test_ranked_search_of_nothing(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    item = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked.ranked_search(none, item).count() == 0
    assert ranked.ranked_search(some, item.limit(0)).count() == 0
    assert ranked.ranked_search(spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string"), item).count() == 0


def test_bounds_are_never_below_the_impacts():
    rng = np.random.default_rng(0)
    names, tfs = rng.integers(-(2**63), 2**63 - 1, 500), rng.integers(1, 600, 500)
    sketch = np.frombuffer(ranked.sketch_of(names, tfs), dtype=np.uint8)
    held = sketch[names & (len(sketch) - 1)].astype(np.int64)
    assert ((held >= tfs) | (held == ranked.MOST)).all()


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(ranked, "_CHUNK_CHARS", 7)
    text = "alpha Beta  gammagammagamma délta, x"
    assert ranked.term_counts(text) == Counter(terms(text))


# ---------------------------------------------------------------------------

URLS = [
    None, "", "no scheme", "://", "http://", "https://A.Example.ORG/es/1?x#y", "https://example.org/en/17", "https://example.org/en/2", "http://notexample.org/es/",
    "http://org/", "http://x.com/de/1", "http://com/fr", "http://x.com/fr/1", "http://x.com", "http://X.net/a/?utm_source=f&b=2&a=1#top", "https://x.net/a?a=1&b=2", "https://x.net:443/a/?b=2&a=1",
    "https://u:p@x.net./a?a=1&b=2", "http://x.net/A", "http://x.net/a//", "http://y.net?q", "http://y.net/?q=1", "https://" + "a." * 5000 + "net/" + "b/" * 5000, "http://x.net/" + "é" * 50_000, "http://x.net/a://b", "x?u=http://z.net/",
]


def split_url(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host):])[0]


def canonical(url):
    if not url or "://" not in url:
        return None
    host, path = split_url(url)
    query = re.search(r"^[^?#]*\?([^#]*)", url)
    kept = sorted(p for p in (query[1] if query else "").split("&") if p and not re.match(r"(utm_[^=]*|fbclid|gclid)(=|$)", p))
    host = re.sub(r"\.?(:(80|443))?$", "", host.rpartition("@")[2], count=1)
    return host + (path[:-1] if path.endswith("/") else path) + ("?" + "&".join(kept) if kept else "")


def judged(url, listed):
    host, path = split_url(url)
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[2], max(fits)[3], None
    hit = canonical(url) in listed - {None}
    return host, path, None, "block" if hit else "allow", hit


@pytest.mark.parametrize("max_blocks", [1, 1 << 18])
def test_url_filter_equals_brute_force(spark, max_blocks):
    rng = random.Random(2)
    urls = [*URLS, *(f"http{rng.choice(['', 's'])}://{rng.choice('abc')}.{rng.choice(['net', 'org', 'com', 'example.org'])}/{rng.choice(['de', 'fr', 'en', 'es'])}/{rng.randrange(200)}{rng.choice(['', '/', '#t', '?utm_x=1'])}" for _ in range(1500))]
    rows = [*enumerate(urls), (None, URLS[15]), (14, URLS[14]), (14, URLS[14])]
    bad = [URLS[15], URLS[22], None, "nothing", URLS[20], URLS[20], *(u for u in urls[50::7])]
    found = urlfilter.filter_urls(with_clashes(spark, rows, "page_id long, url string"), spark.createDataFrame([(u,) for u in bad], "url string"), max_blocks=max_blocks)
    assert found.columns == ["page_id", "host", "path", "rule", "verdict", "listed"]
    listed = {canonical(u) for u in bad}
    expected = [(i, *judged(u, listed)) for i, u in rows]
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(expected, key=key)


def test_url_filter_of_nothing(spark):
    none, some = spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([(1, "http://a.net/b")], "page_id long, url string")
    assert urlfilter.filter_urls(none, some.select("url")).count() == 0
    assert [tuple(r) for r in urlfilter.filter_urls(some, none.select("url")).collect()] == [(1, "a.net", "/b", None, "allow", False)]


def test_filter_lets_few_others_pass_and_pages_are_not_shuffled(spark):
    n = 20_000
    urls = spark.range(2 * n).selectExpr("id as page_id", "concat('http://h', id % 50, '.net/', id) as url")
    urls = urls.withColumn("canonical", urlfilter.canonical_url(urls.url))
    known, n_blocks = urls.filter(f"page_id < {n}"), -(-n * urlfilter.BITS_PER_URL // 512)
    blocks = urlfilter.bloom_blocks(known, n_blocks)
    assert blocks.count() <= n_blocks
    probed = urls.withColumn("block", urlfilter._block(urls.canonical, n_blocks)).join(blocks, "block")
    for k in range(urlfilter.WORDS):
        probed = probed.filter(F.col(f"w{k}").bitwiseAND(urlfilter._bit(F.col("canonical"), k)) != 0)
    passed = probed.agg(F.count_if(F.col("page_id") < n), F.count_if(F.col("page_id") >= n)).first()
    assert passed[0] == n and passed[1] < n * 0.005
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        urlfilter.filter_urls(urls, known.select("url")).explain("formatted")
    text = out.getvalue()
    assert "Python" not in text and "ArrowEval" not in text and "CartesianProduct" not in text
    assert text.count("Exchange hashpartitioning") <= 2


# ---------------------------------------------------------------------------


def brute_infill(doc_id, text):
    text = text or ""
    found = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(found) + 1), h2 % (len(found) + 1)))
    p, m, s = "".join(found[:a]), "".join(found[a:b]), "".join(found[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, len(found), "plain", None, None, text
    if h4 % 100 < 80:
        return doc_id, len(found), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(found), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_infill_equals_brute_force_and_is_undone(spark):
    rows = [(17 * k + (i or 0), t) for k in range(4) for i, t in texts()] + [(None, "a b c"), (None, None), (5, "a <S b> < M> c P>"), (6, "😀 é\u2003x  ")]
    made = infill.fill_in_middle(with_clashes(spark, rows, "doc_id long, text string")).withColumn("back", infill.restored(F.col("output"), F.col("form")))
    found = made.collect()
    assert {r.form for r in found} == {"plain", "spm", "psm"}
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted((tuple(r[:-1]) for r in found), key=key) == sorted((brute_infill(*r) for r in rows), key=key)
    assert sorted(r.back for r in found) == sorted(t or "" for _, t in rows)


def test_infill_of_nothing(spark):
    assert infill.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_boundary_sets_of_every_container(monkeypatch):
    rng = random.Random(8)
    sparse = "".join("x" * rng.randint(1, 40) + " " for _ in range(6000))
    dense = "".join("x" * rng.randint(1, 3) + " " for _ in range(60_000))
    runs = "a" * 100_000 + " b"
    for text in (sparse, dense, runs, sparse + dense, "a" * 65_535, "a" * 65_536, "a" * 65_537, "a" * 65_535 + " ", "a" * 65_536 + " ", "", " "):
        places = [0]
        for t in re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text):
            places.append(places[-1] + len(t))
        found = infill.token_boundaries(text)
        assert len(found) == len(places)
        assert all(found.select(k) == places[k] for k in {0, len(places) - 1, *rng.sample(range(len(places)), min(300, len(places)))})
    kinds = {c[1] for c in infill.token_boundaries(sparse + dense)._containers}
    solid = infill.BoundarySet()
    solid.append(0, np.arange(100, 60_000))
    solid.append(3, np.array([5]))
    solid.close()
    assert kinds == {"array", "bitmap"} and solid._containers[0][1] == "runs"
    assert [solid.select(k) for k in (0, 59_899, 59_900)] == [100, 59_999, 3 * 65_536 + 5]
