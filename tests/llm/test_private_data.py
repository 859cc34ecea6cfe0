"""Pseudonyms against a plain scanner, and values of great length; the archive reader's spread over tasks."""

from __future__ import annotations

import datetime
import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from newsmill.llm import pii, warc

KEY = "k"
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]


def draw(*parts) -> int:
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def number(x: int, size: int, kind: str) -> int:
    side = int((size - 1) ** 0.5) + 1

    def once(n):
        a, b = divmod(n, side)
        for r in range(1, pii.ROUNDS + 1):
            a, b = b, (a + draw(KEY, kind, r, b)) % side
        return a * side + b

    x = once(x)
    while x >= size:
        x = once(x)
    return x


def symbols(text: str, kind: str) -> str:
    hexadecimal = re.fullmatch("[0-9a-f]+", text) and re.search("[0-9]", text) and re.search("[a-f]", text)
    of = ["0123456789abcdef" if hexadecimal else next((a for a in ALPHABETS if c in a), c) for c in text]
    at, half = [a.index(c) for a, c in zip(of, text)], len(text) // 2
    for r in range(1, pii.ROUNDS + 1):
        side = lambda i: 0 if i < half else 1
        fixed = ",".join(str(d) for i, d in enumerate(at) if side(i) == r % 2)
        digest = hashlib.sha256("|".join((KEY, kind, str(r), fixed)).encode()).hexdigest()
        drawn = "".join(hashlib.sha256(f"{digest}|{b}".encode()).hexdigest() for b in range((len(at) + 7) // 8))
        at = [d if side(i) == r % 2 else (d + int(drawn[8 * i : 8 * i + 8], 16)) % len(of[i]) for i, d in enumerate(at)]
    return "".join(a[d] for a, d in zip(of, at))


def luhn(digits: str) -> int:
    return sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits)))


def refilled(value: str, digits: str) -> str:
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in value)


def changed(value: str) -> str:
    kind = next(k for k, p in pii.KINDS.items() if re.fullmatch(p, value, re.ASCII))
    digits = re.sub("[^0-9]", "", value)
    if kind == "secret":
        head = re.match(r'[A-Za-z_-]+\s{0,3}[=:]\s{0,3}"?', value, re.ASCII)[0]
        return head + symbols(value[len(head):], kind)
    if kind == "mail":
        name, at, domain = value.partition("@")
        return symbols(name, kind) + at + domain
    if kind == "phone":
        return refilled(value, digits[:-6] + symbols(digits[-6:], kind))
    if kind == "card":
        body = digits[0] + symbols(digits[1:-1], kind)
        return refilled(value, body + str(-luhn(body + "0") % 10)) if luhn(digits) % 10 == 0 else value
    if kind == "address":
        octets = [int(o) for o in value.split(".")]
        n = 0
        for o in octets:
            n = n * 256 + o
        n = number(n, 1 << 32, kind) if max(octets) < 256 else None
        return value if n is None else ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    if kind == "ssn":
        area, group, serial = value.split("-")
        if area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000":
            return value
        n = number((int(group) - 1) * 9999 + int(serial) - 1, 99 * 9999, kind)
        return f"{area}-{n // 9999 + 1:02}-{n % 9999 + 1:04}"
    a, b, c = map(int, re.split("[-/]", value))
    readings = [((a, b, c), "%Y-%m-%d")] if "-" in value else [((c, a, b), "%m/%d/%Y"), ((c, b, a), "%d/%m/%Y")]
    for ymd, layout in readings:
        try:
            day = datetime.date(*ymd)
        except ValueError:
            continue
        if not 1900 <= day.year <= 2099:
            return value
        zero = datetime.date(1900, 1, 1)
        return (zero + datetime.timedelta(number((day - zero).days, 73049, "date"))).strftime(layout)
    return value


def scanned(text: str | None) -> str | None:
    return None if text is None else re.sub(pii.ANY, lambda m: changed(m[0]), text, flags=re.ASCII)


def test_pseudonyms_equal_a_plain_scanner(spark, sf_dir):
    rng = random.Random(3)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    made = [
        lambda: f"{rng.choice(['ann', 'Bob.L', 'x_9'])}{digits(2)}@{rng.choice(['a', 'mail-4', 'x.y'])}.example.{rng.choice(['com', 'org.', 'c', 'co1'])}",
        lambda: ".".join(str(rng.randrange(300)) for _ in range(4)), lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        lambda: f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{digits(3)}.{digits(3)} {digits(4)}",
        lambda: rng.choice(["4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004", digits(16), digits(13)]),
        lambda: f"{rng.randrange(1880, 2110)}-{rng.randrange(14):02}-{rng.randrange(33):02}", lambda: f"{rng.randrange(1, 32)}/{rng.randrange(1, 32)}/{rng.randrange(1890, 2105)}",
        lambda: f"{rng.choice(['token', 'API_key', 'Password'])}{rng.choice(['=', ': ', ' = '])}{rng.choice(['', chr(34)])}{digits(4)}{rng.choice(['abcdef', 'XyZ/_-', 'q'])}{digits(3)}",
    ]
    texts = [" ".join(rng.choice(made)() + rng.choice(["", ",", ".", "\n", " é", "-1"]) for _ in range(12)) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate([*texts, "", None, "plain", "@", "a@b", texts[0]])]
    found = {r.row.doc_id: r.text for r in pii.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string"), key=KEY).collect()}
    for i, t in rows:
        assert found[i] == scanned(t), t
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = {r.row.doc_id: r.text for r in pii.pseudonymised(docs, key=KEY).collect()}
    assert all(found[r.doc_id] == scanned(r.text) for r in docs.collect())


def test_long_values_end_soon(spark):
    rows = [
        (1, "x@" + "a." * 100_000 + "com"), (2, 'token= "' + "q" * 1_000_000), (3, "a" * 1_000_000 + "@b.com"), (4, "1-" * 300_000), (5, "1." * 300_000), (6, "x@" + "a-" * 100_000 + ".com"),
        (7, "." * 300_000 + "@" * 300_000), (8, "x@" + "ab." * 126 + "com"),
    ]
    began = time.time()
    found = {r.row.doc_id: (len(r.text), r.n_values) for r in pii.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string"), key=KEY).collect()}
    assert time.time() - began < 200
    assert {i: n for i, (n, _) in found.items()} == {i: len(t) for i, t in rows}
    assert {i: v for i, (_, v) in found.items()} == {1: 0, 2: 1, 3: 1, 4: 0, 5: 0, 6: 1, 7: 0, 8: 1}


def test_ranges_are_read_by_many_tasks(spark, tmp_path):
    pages = spark.range(600).select(F.col("id").alias("page_id"), F.lit("http://a.net/").alias("url"), F.sha2(F.col("id").cast("string"), 512).alias("html")).coalesce(2)
    folder = f"file://{tmp_path}/archive"
    files = warc.write_warc(warc.plan_records(pages), folder).collect()
    files = spark.createDataFrame(files)
    n_ranges = sum(-(-f.size // 4096) for f in files.collect())
    read = warc.read_warc(files, folder, split_bytes=4096).select(F.spark_partition_id().alias("p"), "record_id")
    counts = [r["count"] for r in read.groupBy("p").count().collect()]
    assert sum(counts) == 600
    assert n_ranges > 20 and len(counts) > n_ranges // 3 and max(counts) < 120
