"""URL helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsmill import rules
from newsmill.functions.text import trim_ws

_ANY = r"(?i)^(https?|ftp|wss?)://(?:[^/?#@]*@)?([^/?#]+)([^?#]*)"
_HTTP = r"(?i)^(https?)://(?:[^/?#@]*@)?([^/?#]+)([^?#]*)"


def _resolved_path(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments."""
    step = lambda out, part: (
        F.when(part == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).when(part == ".", out).otherwise(F.array_append(out, part))
    )
    parts = F.slice(F.split(path, "/"), 2, F.size(F.split(path, "/")))
    ends = F.when(path.rlike(r"/\.{1,2}$"), F.lit("/")).otherwise(F.lit(""))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(F.size(kept) > 0, ends).otherwise(""))).otherwise(path)


def normalize_url(url: Column) -> Column:
    """Host and path, lower-cased: no scheme, ``www.``, query, fragment or final slash.

    Another scheme than http or https keeps its name in front; a text that is
    no URL is only trimmed and lower-cased.
    """
    u = trim_ws(url)
    scheme = F.lower(F.regexp_extract(u, _ANY, 1))
    host = F.lower(F.regexp_extract(u, _ANY, 2))
    port = F.when(scheme == "https", ":443$").when(scheme == "http", ":80$").otherwise(":21$")
    host = F.when(scheme.isin("https", "http", "ftp"), F.regexp_replace(host, port, "")).otherwise(host)
    path = F.lower(_resolved_path(F.regexp_extract(u, _ANY, 3)))
    joined = F.regexp_replace(F.concat(host, path), "/$", "")
    web = scheme.isin("http", "https")
    return F.when(web, F.regexp_replace(joined, r"^www\.", "")).when(scheme != "", F.concat(scheme, F.lit("://"), joined)).otherwise(F.lower(u))


def trimmed_doi(text: Column) -> Column:
    found = F.regexp_extract(text, "(?i)" + rules.DOI_PATTERN, 0)
    return F.nullif(F.regexp_replace(found, r"[.)]+$", ""), F.lit(""))


def all_dois(text: Column, first: int | None = None) -> Column:
    """Distinct DOIs in order of appearance; all of them unless ``first`` says how many."""
    found = F.regexp_extract_all(text, F.lit("(?i)" + rules.DOI_PATTERN), F.lit(0))
    clean = F.array_distinct(F.transform(found, lambda d: F.regexp_replace(d, r"[.)]+$", "")))
    return clean if first is None else F.slice(clean, 1, first)


def extract_doi(url: Column) -> Column:
    slug = F.regexp_extract(url, r"/articles/([A-Za-z0-9-]+)", 1)
    nature = F.lower(url).rlike(r"(?<![a-z0-9_])nature\.com/") & slug.rlike(r"^s\d{5}-")
    return F.coalesce(trimmed_doi(url), F.when(nature, F.concat(F.lit("10.1038/"), slug)))


def github_repo(url: Column) -> Column:
    owner = F.regexp_extract(url, rules.GITHUB_REPO_PATTERN, 1)
    name = F.regexp_extract(url, rules.GITHUB_REPO_PATTERN, 2)
    return F.when(
        (owner != "") & ~owner.isin(rules.GITHUB_NON_REPO_OWNERS), F.concat_ws("/", owner, name)
    )


def is_youtube_url(url: Column) -> Column:
    return url.rlike("(?i)" + rules.YOUTUBE_URL_PATTERN)


def _ipv4_part(part: Column) -> Column:
    hexadecimal = F.regexp_replace(part, "^0[xX]0*", "")
    octal, decimal = F.regexp_replace(part, "^0+", ""), F.regexp_replace(part, "^0+(?=.)", "")
    return (
        F.when(part.rlike("^0[xX][0-9a-fA-F]*$"), F.when(hexadecimal == "", "0").when(F.length(hexadecimal) <= 8, F.conv(hexadecimal, 16, 10)))
        .when(part.rlike("^0[0-7]+$"), F.when(octal == "", "0").when(F.length(octal) <= 11, F.conv(octal, 8, 10)))
        .when(part.rlike("^[0-9]+$"), decimal)
        .try_cast("bigint")
    )


def _ipv6_groups(host: Column) -> Column:
    """The eight groups of an IPv6 host without leading zeros, NULL where it isn't one."""
    bare = F.regexp_replace(host, r"^\[|\]$", "")
    words = lambda text: F.filter(F.split(text, ":"), lambda g: g != "")
    head, tail = words(F.substring_index(bare, "::", 1)), words(F.regexp_extract(bare, "::(.*)$", 1))
    short = F.contains(bare, F.lit("::"))
    zeros = F.array_repeat(F.lit("0"), F.greatest(8 - F.size(head) - F.size(tail), F.lit(0)))
    groups = F.when(short, F.concat(head, zeros, tail)).otherwise(head)
    once = ~bare.rlike("::.*::|:::")
    fine = once & (F.size(groups) == 8) & F.forall(groups, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
    return F.when(fine, F.transform(groups, lambda g: F.regexp_replace(g, "^0+(?=.)", "")))


def _ipv4_value(host: Column) -> Column:
    """Numeric value of a 1-4 part IPv4 host (decimal, octal or hex parts), else NULL."""
    parts = F.split(F.regexp_replace(host, r"\.$", ""), r"\.")
    n = F.size(parts)
    nums = F.transform(parts, _ipv4_part)
    head = F.slice(nums, 1, F.greatest(n - 1, F.lit(0)))
    last = F.element_at(nums, -1)
    room = F.pow(F.lit(256.0), 5 - n).cast("bigint")
    ok = (n <= 4) & F.forall(nums, lambda v: v.isNotNull()) & F.forall(head, lambda v: v <= 255) & (last < room)
    upper = F.aggregate(
        F.transform(head, lambda v, i: v * F.pow(F.lit(256.0), 3 - i).cast("bigint")),
        F.lit(0).cast("bigint"),
        lambda a, v: a + v,
    )
    return F.when(ok, upper + last)


def with_url_safety(df: DataFrame, url: str, name: str) -> DataFrame:
    """Add ``name``: NULL when a URL may be fetched, else the reason why not."""
    steps = df.withColumn("_u", trim_ws(F.col(url)))
    u = F.col("_u")
    authority = F.regexp_extract(u, r"(?i)^[a-z][a-z0-9+.-]*:[/\\]*([^/?#\\]*)", 1)
    steps = steps.withColumns(
        {
            "_scheme": F.lower(F.regexp_extract(u, r"(?i)^([a-z][a-z0-9+.-]*:)", 1)),
            "_host": F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", "")),
        }
    )
    host, scheme = F.col("_host"), F.col("_scheme")
    is_v6 = host.startswith("[")
    numeric = ~is_v6 & F.regexp_replace(host, r"\.$", "").rlike(r"(^|\.)(\d+|0[xX][0-9a-fA-F]*)$")
    steps = steps.withColumn("_ip", F.when(numeric, _ipv4_value(host))).withColumn("_numeric", numeric)
    value, numeric = F.col("_ip"), F.col("_numeric")
    a, b = F.floor(value / 16777216), F.floor(value / 65536) % 256
    dotted = F.concat_ws(".", a, b, F.floor(value / 256) % 256, value % 256)
    private_v4 = (
        a.isin(0, 10, 127)
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168))
        | ((a == 169) & (b == 254))
        | ((a == 100) & b.between(64, 127))
    )
    steps = steps.withColumn("_v6", F.when(is_v6, _ipv6_groups(host)))
    first, last = F.get("_v6", F.lit(0)), F.get("_v6", F.lit(7))
    near_zero = F.forall(F.slice("_v6", 1, 7), lambda g: g == "0") & last.isin("0", "1")
    private_v6 = F.coalesce(near_zero | (first == "fe80") | first.startswith("fc") | first.startswith("fd"), F.lit(False))
    shown = F.when(is_v6 & near_zero, F.when(last == "0", "[::]").otherwise("[::1]")).otherwise(host)
    suffix = F.lit(False)
    for s in rules.BLOCKED_HOST_SUFFIXES:
        suffix = suffix | host.endswith(s)
    private = (
        host.isin(rules.BLOCKED_HOSTS)
        | suffix
        | (is_v6 & private_v6)
        | F.coalesce(numeric & private_v4, F.lit(False))
    )
    bad_host = (host == "") | host.rlike(r"[\s<>^|%]") | (numeric & value.isNull()) | (is_v6 & F.col("_v6").isNull())
    reason = (
        F.when(u.isNull() | (scheme == ""), F.lit("invalid URL"))
        .when(~scheme.isin("http:", "https:"), F.concat(F.lit("scheme not allowed: "), scheme))
        .when(bad_host, F.lit("invalid URL"))
        .when(
            private,
            F.concat(F.lit("private/internal host blocked: "), F.when(numeric, dotted).otherwise(shown)),
        )
    )
    return steps.withColumn(name, reason).drop("_u", "_scheme", "_host", "_ip", "_numeric", "_v6")
