"""Each operator against a brute-force version, over awkward rows: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import bisect
import datetime
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from newsmill.llm import bpe, components, licences, lines, packing, pii, quality, simhash, token_rollup, topk, warc

WORDS = [a + b for a in ("al", "be", "cor", "du", "ex") for b in ("ta", "mo", "ri", "ne", "zu", "ké")]
DOCS_DDL = "doc_id long, text string, lang string, source string, n_chars long, fp string, kept string, key int, version int, row string, bitmap int, n int"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def awkward_texts() -> list[str | None]:
    rng = random.Random(7)
    base = [prose(rng, n) for n in (3, 12, 60, 200, 200)]
    shared = "This Line Is Shared By Many Documents, And Long Enough."
    near = base[3].split(" ")
    near[5] = "changed"
    texts = [None, "", "   ", "\n\n", "one", "Two words", *base, base[2], base[2], " ".join(near), prose(rng, 20_000)]
    texts += [f"{prose(rng, 30)}.\n  {shared.upper() if k % 2 else shared}\t\nlast line {k}." for k in range(6)]
    texts += ["a b c d e f g h i j\n" * 5, "MIX ed  Case\ttabs\x0b\x0c \r\n end", "日本語 テキスト 😀 ½ Ⅳ ΣΑΣ İ x́", "<|endoftext|> and <|startoftext|>!", "  lead and trail  "]
    return texts


def docs_of(spark, texts):
    ids = [*range(10, 10 + len(texts) - 2), None, 12]
    rows = [(i, t, "en", "s", 1, "fp", "kept", 3, 4, "row", 5, 6) for i, t in zip(ids, texts)]
    return spark.createDataFrame([*rows, rows[6]], DOCS_DDL), [(r[0], r[1]) for r in [*rows, rows[6]]]


@pytest.fixture(scope="module")
def docs(spark):
    return docs_of(spark, awkward_texts())


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS_DDL)


def same(found, expected):
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted(map(tuple, found), key=key) == sorted(expected, key=key)


# -- 1 near-duplicates ----------------------------------------------------------------------------------------------


def brute_print(text: str | None) -> int:
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows: list[tuple], linked) -> dict:
    ids = list(rows)
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if linked(a, b):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: top(i) for i in ids}


def test_simhash_equals_brute_force(spark, docs, nothing):
    df, rows = docs
    found = simhash.near_duplicates(df).select("doc_id", F.col("fp")[0].alias("fp"), "component_id").collect()
    prints = [(i, brute_print(t)) for i, t in rows]
    nodes = {p for i, p in prints if i is not None}
    group = brute_components(sorted(nodes), lambda a, b: (a ^ b).bit_count() <= 3)
    lowest = {}
    for i, p in prints:
        if i is not None:
            lowest[group[p]] = min(lowest.get(group[p], i), i)
    same([(r.doc_id, r.fp % (1 << 64), r.component_id) for r in found], [(i, p, None if i is None else lowest[group[p]]) for i, p in prints])
    assert simhash.near_duplicates(nothing).count() == 0


def test_tiles_find_all_links(spark):
    """Random and clustered fingerprints in tiny tiles: the links connect what brute force connects."""
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 40)
    prints = {int(s) for s in seeds}
    for s in seeds[:10].tolist():
        x = s
        for _ in range(12):
            x ^= 1 << int(rng.integers(0, 63))
            prints.add(x)
    quarter = lambda p: [(p >> 16 * k & 0xFFFF).bit_count() for k in range(4)]
    df = spark.createDataFrame([([p], quarter(p)) for p in prints], "fp array<long>, key array<int>")
    found = simhash.links(df, simhash.neighbour_offsets(4, 3), 3, tile_rows=2).select(F.col("u")[0].alias("u"), F.col("v")[0].alias("v"))
    group = {r.node: r.root for r in components.components(found).collect()}
    expected = brute_components(sorted(prints), lambda a, b: (a ^ b).bit_count() <= 3)
    assert {p: group.get(p, p) for p in prints} == expected


def test_similar_documents_meet_the_similarity(spark):
    rng = random.Random(5)
    texts, base = [], [[rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(150)] for _ in range(8)]
    for b in base:
        for changes in (0, 1, 3, 6, 12, 30):
            w = list(b)
            for k in rng.sample(range(len(w)), changes):
                w[k] = "x" + str(rng.randrange(1000))
            texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    jaccard = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    expected = brute_components(list(range(len(texts))), lambda a, b: jaccard(a, b) >= 0.8)
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()}
    assert found == expected
    kept = simhash.without_near_duplicates(df.withColumn("row", F.lit(1)))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(expected.values()))


def test_repeated_passages_do_not_part_similar_documents(spark):
    """A refrain ten times instead of once, and a whole text twice: the shingle sets stay all but the same."""
    rng = random.Random(11)
    rows = []
    for k in range(6):
        words = [f"w{rng.randrange(10**6)}" for _ in range(1000)]
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(words[:500] + words[476:500] * 9 + words[500:])), (10 * k + 2, " ".join(words * 2))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()} == {i: i // 10 * 10 for i, _ in rows}
    assert sorted(r.doc_id for r in simhash.without_near_duplicates(df).collect()) == [10 * k for k in range(6)]


def test_equal_fingerprints_do_not_make_texts_similar(spark, monkeypatch):
    """Texts mostly of one run, and fingerprints that all coincide: only similar sets are linked."""
    run, rng = "0 " * 400, random.Random(13)
    rows = [(k, run + " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))) for k in range(4)]
    rows += [(9, rows[3][1] + " 0 0 0"), (20, ""), (21, " \n"), (22, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = {0: 0, 1: 1, 2: 2, 3: 3, 9: 3, 20: 20, 21: 20, 22: 20}
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()} == expected
    prints = simhash.fingerprints

    def coinciding(*args, **kwargs):
        found = prints(*args, **kwargs)
        node = F.concat(F.transform("fp", lambda x: F.lit(1).cast("long")), F.slice("node", -1, 1))
        return found.withColumns({"fp": F.transform("fp", lambda x: F.lit(1).cast("long")), "node": node})

    monkeypatch.setattr(simhash, "fingerprints", coinciding)
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()} == expected


def test_an_id_of_unlike_texts_stays_for_each(spark):
    rng = random.Random(17)
    a, b = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(100)) for _ in range(2))
    df = spark.createDataFrame([(5, a), (5, b), (7, b + " end"), (5, b), (8, a + " end")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in simhash.without_near_duplicates(df).collect()) == sorted([(5, a), (5, b)])


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5, 5), (2000, 2001), (2001, 2000)]
    found = components.components(spark.createDataFrame(edges, "u long, v long")).collect()
    expected = {i: 0 for i in range(1, 201)} | {1000 + k: 1000 for k in range(1, 300)} | {2001: 2000}
    assert {r.node: r.root for r in found} == expected
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# -- 2 packing ------------------------------------------------------------------------------------------------------


def test_packing_places_every_piece(spark, docs, nothing):
    df, rows = docs
    found = packing.packed_documents(df, public_tokenizers.path(bpe.BYTE_BPE)).collect()
    t = Tokenizer.from_file(public_tokenizers.path(bpe.BYTE_BPE))
    expected = []
    for i, text in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        n, at, k = len(ids), len(ids) % 1024 or 1024, 0
        bounds = [0, *range(at, n + 1, 1024)] if n > 1024 else [0, n]
        for a, b in zip(bounds, bounds[1:]):
            expected.append((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            k += 1
    same([r[:5] for r in map(tuple, found)], expected)
    filled = Counter()
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled[r.sequence_id]
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 1024
    assert packing.packed_documents(nothing, public_tokenizers.path(bpe.BYTE_BPE)).count() == 0


@pytest.mark.parametrize("rows_per_task", [10, 100_000])
def test_packing_is_close_to_best_fit(spark, monkeypatch, rows_per_task):
    monkeypatch.setattr(packing, "ROWS_PER_TASK", rows_per_task)
    rng = random.Random(2)
    sizes = [rng.choice([rng.randint(1, 1024), rng.randint(1, 200), 341, 512]) for _ in range(300)]
    placed = packing.pack(spark.createDataFrame(list(enumerate(sizes)), "item long, size long")).collect()
    assert sorted(r.item for r in placed) == list(range(len(sizes)))
    filled = Counter()
    for r in sorted(placed, key=lambda r: (r.seq, r.offset)):
        assert r.offset == filled[r.seq]
        filled[r.seq] += sizes[r.item]
    assert max(filled.values()) <= 1024
    free: list[int] = []  # best fit, largest first, one by one
    for size in sorted(sizes, reverse=True):
        k = bisect.bisect_left(free, size)
        rest = (free.pop(k) if k < len(free) else 1024) - size
        bisect.insort(free, rest)
    assert len(filled) <= (1.05 if rows_per_task == 10 else 1.02) * len(free) + 1


# -- 3 archives -----------------------------------------------------------------------------------------------------


def test_warc_round_trip_in_small_splits(spark):
    rng = random.Random(1)
    htmls = [None, "", "<p>" + prose(rng, 30), "<p>same", "<p>same", "<p>same", prose(rng, 30_000), "é" * 100]
    rows = [(k, f"http://x/{k}\r\nEvil: 1", h, "extra") for k, h in enumerate(htmls)] + [(None, None, "<p>same", ""), (2, None, htmls[2], "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    found = warc.archive_round_trip(pages, split_bytes=500).collect()
    top = {}
    for i, _, h, _ in rows:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    expected = []
    for i, _, h, _ in rows:
        p, t = (h or "").encode(), top[h or ""]
        expected.append((i, len(p), warc.base32_sha1(p), "response" if i == t else "revisit", None if i == t else t))
    same(found, expected)
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_warc_keeps_pages_with_very_long_urls(spark, monkeypatch):
    url = "http://a/" + random.Random(29).randbytes(1_500_000).hex()
    df = spark.createDataFrame([(1, url, "<p>one</p>"), (2, "http://b/", "<p>two</p>")], "page_id long, url string, html string")
    assert sorted((r.page_id, r.payload_bytes) for r in warc.archive_round_trip(df).collect()) == [(1, 10), (2, 10)]
    read = warc.read_warc
    monkeypatch.setattr(warc, "read_warc", lambda *args: read(*args).filter("record_id <> 'urn:page:2'"))
    with pytest.raises(RuntimeError, match="2 records were written"):
        warc.archive_round_trip(df)


def test_warc_reader_is_not_fooled_by_chance_magic():
    import io

    good = warc.page_record(1, "u", b"x" * 10, "D", None, "2024")
    noise = warc.MAGIC + b"garbage" + zlib.compress(b"WARC?", wbits=31)
    data = noise + good + b"junk" + good
    found = list(warc.records_in_range(io.BytesIO(data), 0, len(data), len(data)))
    assert [at for at, _, _ in found] == [len(noise), len(noise) + len(good) + 4]
    for cut in range(0, len(data), 7):  # each record belongs to exactly one of two ranges
        parts = [*warc.records_in_range(io.BytesIO(data), 0, cut, len(data)), *warc.records_in_range(io.BytesIO(data), cut, len(data), len(data))]
        assert [x[0] for x in parts] == [x[0] for x in found]


# -- 4 lines --------------------------------------------------------------------------------------------------------


def brute_lines(rows):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\f\r"))
    holders = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 40:
                holders.setdefault(key(x), set()).add(i)
    out = []
    for i, t in rows:
        split = (t or "").split("\n")
        keep = [x for x in split if i is None or len(h := holders.get(key(x), ())) < 5 or i == max(h)]
        out.append((i, len(split), len(split) - len(keep), "\n".join(keep)))
    return out


def test_line_dedup_equals_brute_force(spark, docs, nothing):
    df, rows = docs
    same(lines.without_shared_lines(df).select("doc_id", "n_lines", "n_dropped", "text").collect(), brute_lines(rows))
    assert lines.without_shared_lines(nothing).count() == 0


def test_line_dedup_over_many_partitions(spark):
    """A hot line, lines of just enough and too few documents, repeated inside documents, cut by partition edges."""
    rng = random.Random(4)
    pool = [f"line number {k} with enough characters to be counted here" for k in range(12)]
    rows = [(i, "\n".join([pool[0]] * rng.randint(1, 3) + rng.sample(pool, rng.randint(0, 5)))) for i in range(60)]
    rows += [(100 + i, pool[11] + " only four") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        found = lines.without_shared_lines(df).select("doc_id", "n_lines", "n_dropped", "text").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    same(found, brute_lines(rows))


# -- 5 licences -----------------------------------------------------------------------------------------------------


def test_licences_equal_brute_force(spark, docs, nothing):
    mit = licences.TEMPLATES["MIT"]
    texts = [*awkward_texts(), "Intro.\n\n" + mit.replace("without limitation", "with no limitation").replace(". ", ".\n") + "\n\nOutro.", "x\nReleased under the MIT license\ny", "LICENSED UNDER CC BY-NC 4.0", "Licensed under CC BY 4.0."]
    df, rows = docs_of(spark, texts)
    grams = lambda t: Counter(zip(w := re.sub(r"[!-/:-@\[-`{-~]", " ", re.sub("[A-Z]", lambda m: m[0].lower(), t)).split(), w[1:]))
    expected = []
    for i, text in rows:
        text = text or ""
        units = [("text", 0, text)]
        if "\n" in text:
            split = text.split("\n")
            blocks = re.split(r"\n(?:[ \t\r\x0b\f]*\n)+", text)
            blocks = [b for b in blocks if b.strip(" \t\n\r\x0b\f")]
            if len(blocks) > 1:
                units += [("paragraph", None, b) for b in blocks]
            units += [("line", k, x) for k, x in enumerate(split)]
        for kind, line, unit in units:
            a = grams(unit)
            for name, template in licences.TEMPLATES.items():
                b = grams(template)
                shared = sum((a & b).values())
                if shared and 2 * shared >= 0.8 * (a.total() + b.total()):
                    expected.append((i, name, kind, None if kind == "paragraph" else line, shared, a.total(), b.total()))
    found = [(r.doc_id, r.licence, r.unit, None if r.unit == "paragraph" else r.first_line, r.n_shared, r.n_unit, r.n_template) for r in licences.licence_matches(df).collect()]
    same(found, expected)
    assert {"MIT", "MIT notice", "CC-BY-NC-4.0 notice"} == {r[1] for r in found}
    assert licences.licence_matches(nothing).count() == 0


def test_licences_across_paragraphs_and_inside_lines(spark):
    mit, header = licences.TEMPLATES["MIT"], licences.TEMPLATES["Apache-2.0 header"]
    at = [mit.index("The above"), mit.index("THE SOFTWARE IS")]
    mit = "\n\n".join([mit[: at[0]], mit[at[0] : at[1]], mit[at[1] :]])
    header = header.replace(" You may obtain", "\n\nYou may obtain").replace(" Unless", "\n\nUnless").replace("either express", "\neither express")
    notice, other = "Licensed under CC BY-NC 4.0.", prose(random.Random(3), 300)
    rows = [
        (1, f"{other}\n\n{mit}\n\n{other}"), (2, f"{other}\n\n{header}\n\n{other}"), (3, f"{other} {notice} {other}"), (4, f"{other}\n{notice}\n{other} {notice}\n{other}"),
        (5, f"{other} {mit} {other} {mit}\n\n{mit} {other}"), (6, f"{other} licensed under cc {other}"), (7, f"{notice}\n{other} {notice} {notice}"),
    ]
    found = licences.licence_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    count = Counter((r.doc_id, r.licence, r.unit, r.first_line) for r in found if r.licence != "Apache-2.0 notice")
    name = "CC-BY-NC-4.0 notice"
    assert count == {
        (1, "MIT", "window", 2): 1, (2, "Apache-2.0 header", "window", 2): 1, (3, name, "window", 0): 1, (4, name, "line", 1): 1, (4, name, "window", 2): 1,
        (5, "MIT", "window", 0): 1, (5, "MIT", "window", 4): 1, (5, "MIT", "window", 10): 1, (7, name, "line", 0): 1, (7, name, "window", 1): 2,
    }
    assert all(r.n_shared == r.n_template for r in found if r.unit == "window")


@pytest.mark.parametrize("threshold", [0.6, 0.8, 1.0])
def test_licence_windows_leave_none_out(threshold):
    """Random words over a small alphabet against all windows by brute force."""
    rng = random.Random(23)
    for _ in range(300):
        template = Counter(rng.choices("abcd", k=rng.randrange(1, 9)))
        grams, size = rng.choices("abcdxyz", k=rng.randrange(0, 40)), template.total()
        reaches = lambda a, b: 2 * (Counter(grams[a:b]) & template).total() >= threshold * (b - a + size)
        found = list(licences.windows([k for k, g in enumerate(grams) if g in template], grams, template, size, threshold))
        free, at = [], 0
        for a, b, shared in found:
            assert a >= at and reaches(a, b + 1) and shared == (Counter(grams[a : b + 1]) & template).total()
            free.append((at, a))
            at = b + 1
        for x, y in [*free, (at, len(grams))]:
            assert not any(reaches(a, b) for a in range(x, y) for b in range(a + 1, y + 1))


# -- 6 token counts -------------------------------------------------------------------------------------------------


def test_rollup_equals_a_recount(spark, docs, tmp_path, monkeypatch):
    df, rows = docs
    t = {v: Tokenizer.from_file(public_tokenizers.path(f)) for v, f in token_rollup.VERSIONS.items()}
    paths = {v: public_tokenizers.path(f) for v, f in token_rollup.VERSIONS.items()}
    df = df.withColumn("source", F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.concat(F.lit("s"), F.col("doc_id") % 3)))
    source = lambda i: None if i is None or i % 3 == 0 else f"s{i % 3}"
    rollup = token_rollup.Rollup(spark, str(tmp_path / "rollup"))
    assert rollup.totals().count() == 0
    assert rollup.commit(1, token_rollup.token_counts(df, paths))
    schema = "doc_id long, text string, lang string, source string"
    counted = lambda *new: token_rollup.token_counts(spark.createDataFrame(list(new), schema), paths)
    ids = lambda *gone: spark.createDataFrame([(i,) for i in gone], "doc_id long")
    second = counted((15, "first revision, which is longer", "fr", "s7"), (16, "gone too", "en", "s1"), (99, "a new one", "de", "s9"), (98, "another", "de", "s9"))
    for _ in range(3):
        rollup.commit(2, second, ids(16, 17, 500, None))
    # a batch cut short leaves a folder that no record names
    monkeypatch.setattr(token_rollup, "publish", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        rollup.commit(3, counted((15, "never seen", "en", "s0")), ids(99))
    monkeypatch.undo()
    rollup.compact()
    third = counted((15, "fresh text", "en", "s0"))
    assert [rollup.commit(3, third, ids(98)), rollup.commit(3, third, ids(98)), rollup.commit(2, third)] == [True, False, False]
    state = [(i, x, "en", source(i)) for i, x in rows if i not in (15, 16, 17)] + [(15, "fresh text", "en", "s0"), (99, "a new one", "de", "s9")]
    expected = Counter()
    n_docs = Counter()
    for _, text, lang, src in state:
        for v, tok in t.items():
            expected[src, lang, v] += len(tok.encode(text or "", add_special_tokens=False).ids)
            n_docs[src, lang, v] += 1
    same(rollup.totals().collect(), [(*k, n_docs[k], n) for k, n in expected.items()])
    assert rollup.commit(4, token_rollup.token_counts(df.limit(0), paths), ids())
    rollup.compact()
    same(rollup.totals().collect(), [(*k, n_docs[k], n) for k, n in expected.items()])


# -- 7 byte-pair encoding -------------------------------------------------------------------------------------------


def test_recounts_of_repeated_rows_count_each_once(spark, tmp_path):
    text = "Some plain words that make up one whole line of text here, all in order."
    rows = [(1, text, "en", "s0")] * 3 + [(1, text + " And more.", "de", "s1"), (2, text, "en", "s0")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    t = {v: Tokenizer.from_file(public_tokenizers.path(f)) for v, f in token_rollup.VERSIONS.items()}
    expected = Counter()
    for _, x, lang, source in rows:  # cleaning leaves these texts as they are
        for v, tok in t.items():
            expected[source, lang, v] += len(tok.encode(x, add_special_tokens=False).ids)
    found = token_rollup.op6_token_counts(spark, str(tmp_path)).collect()
    assert {(r.source, r.lang, r.version): r.n_tokens for r in found} == expected
    assert {(r.source, r.lang): r.n_docs for r in found} == {("s0", "en"): 4, ("s1", "de"): 1}


@pytest.mark.parametrize("name", [bpe.WORD_BPE, bpe.BYTE_BPE])
def test_bpe_equals_the_library(spark, docs, nothing, name):
    df, rows = docs
    path = public_tokenizers.path(name)
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    expected = [(i, t.encode(x or "", add_special_tokens=False).ids) for i, x in rows]
    same([(r.doc_id, r.ids) for r in bpe.encode(df, path).collect()], expected)
    if name == bpe.WORD_BPE:
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        digests = [(i, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))) for i, ids in expected]
        same(bpe.encode_digests(df, path).collect(), digests)
        assert bpe.encode_digests(nothing, path).count() == 0


# -- 8 personal data ------------------------------------------------------------------------------------------------

PRIVATE = {
    "mail": ["ann.lee42@mail4.example.com"], "address": ["28.220.236.96", "1.2.3.4"], "phone": ["+1 (854) 555-8570", "212-555-0199"],
    "card": ["4111111111111111", "4111 1111 1111 1111"], "date": ["1987-03-14", "12/31/1999", "31/12/1999"], "ssn": ["123-45-6789"],
    "secret": ['token = "0641917ea4e9feb9cda83477b57ac2654884f485"', "password=e3b3ed3cc8548923d6"],
}
PUBLIC = ["300.1.2.3", "4111111111111112", "1987-02-30", "000-12-3456", "1.2.3", "12345", "v1.2.3.4.5", "no mail @ all", "1789-07-14"]


def luhn(number: str) -> bool:
    digits = [int(c) for c in reversed(re.sub(r"\D", "", number))]
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(digits)) % 10 == 0


def test_pseudonyms_keep_format_and_links(spark, nothing):
    values = [(k, v) for k, vs in PRIVATE.items() for v in vs]
    rows = [(n, f"Before {v} after; again {v}.", "r", n) for n, (_, v) in enumerate(values)]
    rows += [(100 + n, v, "r", 0) for n, v in enumerate(PUBLIC)] + [(200, None, "r", 0), (201, "", "r", 0), (None, f"x {values[0][1]} y", "r", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, found int")
    out = {r.row.doc_id: r for r in pii.pseudonymised(df, key="k").collect()}
    for n, (kind, value) in enumerate(values):
        found = re.fullmatch(r"Before (.*) after; again (.*)\.", out[n].text)
        assert found and found[1] == found[2] != value and out[n].n_values == 2, (value, out[n].text)
        new = found[1]
        if kind != "address":
            shape = lambda s: re.sub("[0-9]", "0", re.sub("[a-f]" if kind == "secret" else "[a-z]", "a", s.split("=")[-1] if kind == "secret" else s))
            if kind != "secret":
                assert shape(new) == shape(value), (value, new)
            assert len(new) == len(value)
        if kind == "card":
            assert luhn(new)
        if kind == "date":
            datetime.datetime.strptime(new, "%Y-%m-%d" if "-" in new else "%m/%d/%Y" if value.startswith("12") else "%d/%m/%Y")
        if kind == "address":
            assert all(0 <= int(o) <= 255 for o in new.split("."))
    spaced, plain = (re.search(r"Before (.*) after", out[n].text)[1] for n, (k, v) in enumerate(values) if k == "card" for _ in [0])
    assert re.sub(" ", "", spaced) == re.sub(" ", "", plain)
    for n, v in enumerate(PUBLIC):
        assert out[100 + n].text == v and out[100 + n].n_values == 0, (v, out[100 + n].text)
    assert out[200].text is None and out[201].text == ""
    assert out[None].text.split()[1] == out[0].text.split()[1]
    assert pii.pseudonymised(nothing).count() == 0


def test_number_permutation_is_one_to_one(spark):
    n = 1000
    found = spark.range(n).select(pii.permuted_number(F.col("id"), n, "k", "test").alias("x")).collect()
    assert sorted(r.x for r in found) == list(range(n))
    pairs = spark.range(100).select(pii.permuted_symbols(F.lpad(F.col("id").cast("string"), 2, "0"), "k", "t").alias("x")).collect()
    assert sorted(r.x for r in pairs) == [f"{k:02d}" for k in range(100)]


# -- 9 top products -------------------------------------------------------------------------------------------------


def test_top_products_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    vectors = [(k, (rng.normal(size=8) * rng.choice([0.1, 1.0, 5.0])).astype(np.float32).tolist()) for k in range(600)]
    vectors += [(k, vectors[3][1]) for k in range(600, 640)]  # ties
    vectors += [(700, None), (701, [1.0] * 7 + [None]), (702, [1.0] * 7 + [math.nan]), (800, [math.inf] * 8), (None, [9.0] * 8), (900, [0.0] * 8), (1000, [1.0, 2.0]), (5, vectors[5][1])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id long, embedding array<float>, bucket int, dim int")
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    expected = []
    for q, v in dict(whole).items():
        if q % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, c)), i) for i, c in whole if i != q and len(c) == len(v))
            expected += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:10], 1)]
    same(topk.top_products(df).collect(), expected)
    assert topk.top_products(df.limit(0)).count() == 0


def test_a_repeated_query_takes_its_smallest_vector(spark):
    df = spark.createDataFrame([(0, [3.0, 4.0]), (0, [1.0, 2.0]), (0, [3.0, 4.0]), (1, [5.0, 5.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    same(topk.top_products(df).collect(), [(0, 1, 1, 15 * 1024**2), (0, 2, 2, 1024**2)])


def test_pruning_loses_nothing():
    rng = np.random.default_rng(1)
    c = np.floor(rng.normal(size=(400, 6)) * 1024).astype(np.int64)
    c[:200] = np.floor(c[0] + rng.normal(size=(200, 6)) * 60).astype(np.int64)
    lengths = np.sqrt((c.astype(float) ** 2).sum(axis=1))
    for j in range(0, 400, 20):
        score = topk.products(c[j : j + 1], c)[0]
        for need in np.sort(score)[-30::5].tolist():
            may = set(topk.survivors(c[j].astype(float), float(lengths[j]), c, lengths, float(need)).tolist())
            assert set(np.flatnonzero(score >= need).tolist()) <= may


# -- 10 quality -----------------------------------------------------------------------------------------------------


def test_quality_equals_brute_force(spark, docs, nothing):
    nav = "home | news | about | contact\nproducts | help | jobs | login"
    texts = [*awkward_texts(), nav, "Good sentence with quite a few words in it, as prose has.\n" + nav, "BUY!! NOW!! CHEAP!! BEST!! DEAL!! EVER!! REAL!! FAST!! TODAY!! ONLY!!", "w### x&&& y*** z%%% " * 4, "We write a line of good prose here for the test.\nAll rights reserved.", "no ending here although the line has many many words in all"]
    df, rows = docs_of(spark, texts)

    def fails(x: str) -> bool:
        x = x.strip(" \t\n\x0b\f\r")
        if not x:
            return False
        words, count = x.count(" ") + 1, lambda chars: sum(x.count(c) for c in chars)
        sep = count(quality.SEPARATORS)
        return (
            (sep >= 2 and sep * 4 >= words)
            or count(quality.SYMBOLS) * 10 > len(re.sub(r"[ \t\n\x0b\f\r]", "", x))
            or (words >= 3 and count(quality.OUTCRIES) * 2 >= words)
            or (words >= 10 and x[-1] not in quality.LINE_ENDS)
            or (len(x) <= quality.BOILERPLATE_CHARS and any(p in re.sub("[A-Z]", lambda m: m[0].lower(), x) for p in quality.BOILERPLATE))
        )

    expected = []
    for i, text in rows:
        text = text or ""
        words, split = re.findall(r"[^\x20\x09-\x0D]+", text), text.split("\n")
        windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        covered = {k + d for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for d in range(5)}
        spoken = [x for x in split if re.search(r"[^\x20\x09-\x0D]", x)]
        chars = sum(map(len, words))
        clean = "\n".join(x for x in split if not fails(x))
        lost = chars - len(re.sub(r"[\x20\x09-\x0D]", "", clean))
        base = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        expected.append((i, len(words), chars, sum(text.count(c) for c in quality.SYMBOLS), len(spoken) - len(set(spoken)), len(covered), base, not base and 100 * lost <= 50 * chars, clean))
    found = quality.judge(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text").collect()
    same(found, expected)
    assert quality.judge(nothing).count() == 0
