"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Numbers and dates that pass their check (Luhn, calendar, address and number
ranges) are permuted by a keyed Feistel network inside their own format; the
characters of mail names and secrets are permuted inside their alphabets.  Equal
values have equal pseudonyms in every document, and different ones different
pseudonyms, as each map is one to one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsmill.llm.common import table

#: Whoever publishes pseudonyms passes a secret of their own.
KEY = "example key"
ROUNDS = 8
#: How often a number that falls out of its range is permuted again; each time leaves 2 of 100 at most.
WALKS = 24

#: Domains have 127 labels at most; a group repeated without bound would recurse for each of them.
_MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){0,125}\.[A-Za-z]{2,}+"
_SECRET = r"(?<![A-Za-z0-9])(?i:password|passwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}\"?[A-Za-z0-9_+/-]{8,}+"
_DATE = r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4})(?![\d/]|-\d)"
_ADDRESS = r"(?<![\d.])\d{1,3}+(?:\.\d{1,3}+){3}(?!\d|\.\d)"
_SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?!\d|-\d)"
_PHONE = r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)"
_CARD = r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?!\d)"
KINDS = {"secret": _SECRET, "mail": _MAIL, "date": _DATE, "address": _ADDRESS, "ssn": _SSN, "phone": _PHONE, "card": _CARD}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())

_DAY_ZERO = "1900-01-01"
_DAYS = 73049  # to 2099-12-31
_SSN_NUMBERS = 99 * 9999


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with value evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _draw(key: str, *parts: Column) -> Column:
    """A keyed number below 2^60."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def permuted_number(x: Column, size: int, key: str, kind: str) -> Column:
    """A permutation of 0..size-1: Feistel rounds on a square that covers it, again for what falls outside."""
    side = int((size - 1) ** 0.5) + 1

    def once(n: Column) -> Column:
        start = F.struct((n / side).cast("long").alias("a"), F.pmod(n, F.lit(side)).cast("long").alias("b"))
        step = lambda s, r: F.struct(
            s.b.alias("a"), F.pmod(s.a + _draw(key, F.lit(kind), r, s.b), F.lit(side)).cast("long").alias("b")
        )
        rounds = F.sequence(F.lit(1), F.lit(ROUNDS))
        return F.aggregate(rounds, start, step, lambda s: s.a * side + s.b)

    walks = F.sequence(F.lit(1), F.lit(WALKS))
    return F.aggregate(walks, once(x), lambda n, _: F.when(n < size, n).otherwise(once(n)))


_DIGITS, _LOWER, _UPPER, _HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"


def permuted_symbols(text: Column, key: str, kind: str) -> Column:
    """Letters and digits permuted inside their alphabets, a hexadecimal text inside its own; the rest stays in place.

    The two halves of the symbols take turns: in each round one digest is drawn
    from the whole of one half, and each symbol of the other is shifted by a 32-bit
    number drawn from the digest and its place, so the work grows with the length alone.
    """
    pure_hex = text.rlike(r"^[0-9a-f]+$") & text.rlike("[0-9]") & text.rlike("[a-f]")

    def alphabet(c: Column, is_hex: Column) -> Column:
        return (
            F.when(is_hex, F.lit(_HEX)).when(c.between("0", "9"), F.lit(_DIGITS)).when(c.between("a", "z"), F.lit(_LOWER))
            .when(c.between("A", "Z"), F.lit(_UPPER)).otherwise(c)
        )

    def permuted(t: Column) -> Column:
        return let(F.transform(t.chars, lambda c: alphabet(c, t.is_hex)), lambda of: let(F.struct(
            of.alias("of"), F.transform(t.chars, lambda c, i: F.position(c, F.get(of, i)) - 1).alias("at"), F.floor(F.size(of) / 2).cast("int").alias("half"),
        ), shifted))

    def shifted(t: Column) -> Column:
        first = lambda i: F.when(i < t.half, 0).otherwise(1)

        def step(now: Column, r: Column) -> Column:
            turn = F.pmod(r, F.lit(2))
            fixed = F.concat_ws(",", F.transform(F.filter(now, lambda _, i: first(i) == turn), lambda d: d.cast("string")))
            digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), fixed), 256)
            blocks = lambda one: F.transform(F.sequence(F.lit(0), F.floor((F.size(now) - 1) / 8).cast("int")), lambda b: F.sha2(F.concat_ws("|", one, b.cast("string")), 256))
            number = lambda drawn, i: F.conv(F.substr(F.get(drawn, F.floor(i / 8).cast("int")), F.pmod(i, F.lit(8)) * 8 + 1, F.lit(8)), 16, 10).cast("long")
            return let(let(digest, blocks), lambda drawn: F.transform(
                now, lambda d, i: F.when(first(i) == turn, d).otherwise(F.pmod(d + number(drawn, i), F.char_length(F.get(t.of, i))).cast("int")),
            ))

        moved = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), t["at"], step)
        return let(moved, lambda m: F.array_join(F.transform(m, lambda d, i: F.substr(F.get(t.of, i), d + 1, F.lit(1))), ""))

    start = F.struct(F.split(text, "").alias("chars"), pure_hex.alias("is_hex"))
    return F.when(text == "", text).otherwise(let(start, permuted))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def _refilled(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced one by one by ``digits``."""
    marks = F.split(value, "")
    state = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))
    step = lambda s, c: F.when(
        c.between("0", "9"), F.struct(F.concat(s.out, F.substr(digits, s.next, F.lit(1))).alias("out"), (s.next + 1).alias("next"))
    ).otherwise(F.struct(F.concat(s.out, c).alias("out"), s.next.alias("next")))
    return F.aggregate(marks, state, step, lambda s: s.out)


def luhn_sum(digits: Column) -> Column:
    """Sum of the Luhn weights, the last digit counting once."""
    weigh = lambda d, i: F.when(F.pmod(i, F.lit(2)) == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    ordered = F.transform(F.reverse(F.split(digits, "")), lambda c: c.cast("int"))
    return F.aggregate(F.transform(ordered, weigh), F.lit(0), lambda a, x: a + x)


def _card(value: Column, key: str) -> Column:
    """First digit and valid check digit stay in format; a number that fails the Luhn check stays as it is."""

    def new(d: Column) -> Column:
        body = F.concat(F.substring(d, 1, 1), permuted_symbols(F.substr(d, F.lit(2), F.length(d) - 2), key, "card"))
        return let(body, lambda b: _refilled(value, F.concat(b, F.pmod(-luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string"))))

    return let(_digits(value), lambda d: F.when(F.pmod(luhn_sum(d), F.lit(10)) == 0, new(d)).otherwise(value))


def _date(value: Column, key: str) -> Column:
    """A calendar date of 1900 to 2099, in its own layout; month first where both readings are dates."""

    def written(day: Column, layout: Column) -> Column:
        new = F.date_add(F.lit(_DAY_ZERO).cast("date"), permuted_number(F.datediff(day, F.lit(_DAY_ZERO).cast("date")).cast("long"), _DAYS, key, "date").cast("int"))
        return let(new, lambda n: F.when(layout == 0, F.date_format(n, "yyyy-MM-dd")).when(layout == 1, F.date_format(n, "MM/dd/yyyy")).otherwise(F.date_format(n, "dd/MM/yyyy")))

    part = F.split(value, "[-/]")
    iso = F.contains(value, F.lit("-"))
    date = lambda y, m, d: F.try_to_date(F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")

    def chosen(p: Column) -> Column:
        a, b, c = F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.get(p, F.lit(2))
        first = F.when(iso, date(a, b, c)).otherwise(date(c, a, b))
        return F.when(first.isNotNull(), F.struct(first.alias("day"), F.when(iso, 0).otherwise(1).alias("layout"))).otherwise(
            F.struct(F.when(~iso, date(c, b, a)).alias("day"), F.lit(2).alias("layout"))
        )

    ok = lambda t: t.day.between(F.lit(_DAY_ZERO).cast("date"), F.lit("2099-12-31").cast("date"))
    return let(let(part, chosen), lambda t: F.when(ok(t), written(t.day, t.layout)).otherwise(value))


def _address(value: Column, key: str) -> Column:
    """An IPv4 address; one with a number over 255 stays as it is."""
    octets = F.transform(F.split(value, r"\."), lambda o: o.cast("long"))
    number = lambda o: F.aggregate(o, F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    dotted = lambda n: F.concat_ws(".", *[F.pmod(F.shiftright(n, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)])
    return let(octets, lambda o: F.when(F.array_max(o) > 255, value).otherwise(
        let(permuted_number(number(o), 1 << 32, key, "address"), dotted)
    ))


def _ssn(value: Column, key: str) -> Column:
    """Area stays; group and serial are permuted.  Numbers that are never issued stay as they are."""
    area, group, serial = (F.substring(value, a, n) for a, n in ((1, 3), (5, 2), (8, 4)))
    issued = ~area.isin("000", "666") & ~area.startswith("9") & (group != "00") & (serial != "0000")
    number = (group.cast("long") - 1) * 9999 + serial.cast("long") - 1
    new = lambda n: F.concat_ws("-", area, F.lpad(((n / 9999).cast("long") + 1).cast("string"), 2, "0"), F.lpad((F.pmod(n, F.lit(9999)) + 1).cast("string"), 4, "0"))
    return F.when(issued, let(permuted_number(number, _SSN_NUMBERS, key, "ssn"), new)).otherwise(value)


def _phone(value: Column, key: str) -> Column:
    """Country and area code and the next digit stay; the last six digits are permuted."""
    return let(_digits(value), lambda d: _refilled(value, F.concat(
        F.substr(d, F.lit(1), F.length(d) - 6), permuted_symbols(F.substring(d, -6, 6), key, "phone")
    )))


def _mail(value: Column, key: str) -> Column:
    """The name's letters and digits are permuted, the domain stays."""
    name = F.substring_index(value, "@", 1)
    return F.concat(permuted_symbols(name, key, "mail"), F.substr(value, F.length(name) + 1))


def _secret(value: Column, key: str) -> Column:
    """What follows the name of the secret and its sign is permuted."""
    head = F.regexp_extract(value, r'^[A-Za-z_-]+\s{0,3}[=:]\s{0,3}"?', 0)
    return F.concat(head, permuted_symbols(F.substr(value, F.length(head) + 1), key, "secret"))


_MAKERS = {"secret": _secret, "mail": _mail, "date": _date, "address": _address, "ssn": _ssn, "phone": _phone, "card": _card}


def kind_of(value: Column) -> Column:
    """The kind of a found value: the first whose pattern it is as a whole."""
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(KINDS.items()):
        kind = F.when(value.rlike(f"^(?:{pattern})$"), name).otherwise(kind)
    return kind


def pseudonym(value: Column, key: str) -> Column:
    out = value
    kind = kind_of(value)
    return let(kind, lambda k: _by_kind(k, value, key, out))


def _by_kind(kind: Column, value: Column, key: str, out: Column) -> Column:
    for name, make in _MAKERS.items():
        out = F.when(kind == name, make(value, key)).otherwise(out)
    return out


def pseudonymised(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` as (row, text, n_values): row is a struct of all other columns, n_values the values that changed.

    A null text stays null and an empty one empty, with no values.  Values that
    fail their check stay.  Rows are taken one by one, so ids may be null or
    repeat, and texts and values may be of any length; an empty table gives an empty result.
    """
    d = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), F.col("text").cast("string").alias("text")
    )
    may = F.col("text").rlike("[0-9@]") | F.contains("text", F.lit("=")) | F.contains("text", F.lit(":"))
    d = d.withColumn("found", F.when(may, F.regexp_extract_all("text", F.lit(ANY), F.lit(0))))
    has = F.size(F.coalesce("found", F.array().cast("array<string>"))) > 0
    d = d.withColumns({
        "new": F.when(has, F.transform("found", lambda v: pseudonym(v, key))),
        "between": F.when(has, F.split("text", ANY, -1)),
    })
    joined = F.array_join(F.transform("between", lambda b, i: F.concat(b, F.coalesce(F.get("new", i), F.lit("")))), "")
    changed = F.size(F.filter(F.arrays_zip("found", "new"), lambda p: p["found"] != p["new"]))
    return d.select(
        "row", F.when(F.col("new").isNotNull(), joined).otherwise(F.col("text")).alias("text"),
        F.when(F.col("new").isNotNull(), changed).otherwise(0).cast("long").alias("n_values"),
    )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "text", "n_values")
