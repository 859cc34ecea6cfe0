"""URL filters by site rules and a list of URLs, in DataFrame functions only.

The listed canonical URLs are folded into a blocked Bloom filter, a table of
512-bit blocks that is broadcast.  A URL reads one block; the few that all eight
bits let pass go to an exact hash join with the list, which removes the false
positives.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsmill.llm.common import ascii_lower, stored, table

#: (verdict, host, path): fixed by the query's contract.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
WORDS = 8
#: Bits of the filter for each listed URL; of those not listed about one in a thousand passes.
BITS_PER_URL = 16
#: The filter is broadcast, so it has at most so many blocks of 64 bytes (16 MB), enough for eight million URLs.
#: With a longer list more URLs pass on to the join; the result is the same.
MAX_BLOCKS = 1 << 18


def host_of(url: Column) -> Column:
    """What follows the first :// up to a slash, question mark, hash or the end, A-Z lower-cased; empty without one."""
    return ascii_lower(F.regexp_extract(_behind_scheme(url), r"^[^/?#]*+", 0))


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark, hash or the end; empty without ://."""
    return F.regexp_extract(_behind_scheme(url), r"^[^/?#]*+([^?#]*+)", 1)


def _behind_scheme(url: Column) -> Column:
    at = F.position(F.lit("://"), url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def canonical_url(url: Column) -> Column:
    """The form in which URLs are listed: host, path and query; null for a text without ://.

    Scheme, user, the ports 80 and 443, the host's final dot, the path's final slash, the
    fragment and parameters that only track (utm_*, fbclid, gclid) are left out; the others are sorted.
    """
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^.*@", ""), r"\.?(:(80|443))?$", "")
    path = F.regexp_replace(path_of(url), "/$", "")
    query = F.regexp_extract(url, r"^[^?#]*+\?([^#]*+)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[^=]*|fbclid|gclid)(=|$)")))
    joined = F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(F.position(F.lit("://"), url) > 0, joined)


def deciding_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does; of equally long ones that of the longer host.

    A rule fits its host and all below it if the path starts with the rule's.  Rules
    are part of the plan, so their number is bounded; long lists of URLs are ``listed``.
    """
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, site, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host == site) | F.endswith(host, F.lit("." + site))) & F.startswith(path, F.lit(start))
        chosen = F.when(fits, F.struct(F.lit(site + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def _block(url: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(url, F.lit("block")), F.lit(n_blocks).cast("long")).cast("int")


def _bit(url: Column, word: int) -> Column:
    """The one bit of the ``word``-th 64 that stands for a URL."""
    place = F.shiftrightunsigned(F.xxhash64(url, F.lit("bits")), 6 * word).bitwiseAND(F.lit(63).cast("long")).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def bloom_blocks(urls: DataFrame, n_blocks: int) -> DataFrame:
    """(block, w0 ... w7): a row for each block of the filter in which one of ``urls`` (canonical) falls, at most ``n_blocks``."""
    bits = urls.select(_block(F.col("canonical"), n_blocks).alias("block"), *[_bit(F.col("canonical"), k).alias(f"w{k}") for k in range(WORDS)])
    return bits.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)])


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed): one row per row of ``pages`` (page_id, url).

    The verdict is that of the deciding rule; without one a URL is blocked if its canonical
    form is one of ``listed`` (url), else allowed.  ``listed`` is null where a rule decided.

    A null url, or one without ://, has an empty host and path, no rule and isn't
    listed; null urls of the list are ignored and repeats count once.  Urls may be of
    any length.  Ids may be null or repeat; other columns are not read, so their names
    may be any.  An empty table gives an empty result, an empty list blocks nothing.

    Pages are not shuffled but for those that the filter lets pass; if one URL has
    very many of these, adaptive execution splits its side of the join.
    """
    known = listed.select(canonical_url(F.col("url").cast("string")).alias("canonical")).filter("canonical is not null").distinct()
    known = stored(known, "listed-urls")
    n_blocks = max(1, min(max_blocks, -(-known.count() * BITS_PER_URL // (64 * WORDS))))
    blocks = stored(bloom_blocks(known, n_blocks), "url-filter")

    url = F.col("url")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    p = p.withColumns({"host": F.coalesce(host_of(url), F.lit("")), "path": F.coalesce(path_of(url), F.lit(""))})
    p = p.withColumns({"decided": deciding_rule(F.col("host"), F.col("path"), rules), "canonical": canonical_url(url)})
    ruled = F.col("decided").isNotNull()
    p = p.withColumn("block", F.when(~ruled, _block(F.col("canonical"), n_blocks)))
    p = p.join(F.broadcast(blocks), "block", "left")  # at most MAX_BLOCKS rows of 68 bytes
    passes = reduce(Column.__and__, [F.col(f"w{k}").bitwiseAND(_bit(F.col("canonical"), k)) != 0 for k in range(WORDS)])
    p = p.select("page_id", "host", "path", "decided", "canonical", F.coalesce(passes & F.col("canonical").isNotNull(), F.lit(False)).alias("passes"))
    asked = p.filter("passes").join(known.withColumn("hit", F.lit(True)).hint("shuffle_hash"), "canonical", "left")
    asked = asked.select("page_id", "host", "path", "decided", F.col("hit").isNotNull().alias("listed"))
    rest = p.filter("not passes").select("page_id", "host", "path", "decided", F.lit(False).alias("listed"))
    by_list = F.when(F.col("listed"), "block").otherwise("allow")
    return asked.unionAll(rest).select(
        "page_id", "host", "path", F.col("decided.rule").alias("rule"), F.coalesce("decided.verdict", by_list).alias("verdict"),
        F.when(~ruled, F.col("listed")).alias("listed"),
    )


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, against the URLs of those whose number the labels call toxic, as a takedown list would name them."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("page_id"))
    return filter_urls(pages, pages.join(toxic.hint("shuffle_hash"), "page_id", "left_semi"))


OP12_SQL = r"""
with p as (select page_id, url, case when contains(url, '://') then url[instr(url, '://') + 3:] else '' end as rest from pages),
h as (select page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) as query from p),
c as (select *, list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' and not regexp_matches(x, '^(utm_[^=]*|fbclid|gclid)(=|$)'))) as kept from h),
k as (select *, case when contains(url, '://') then regexp_replace(regexp_replace(host, '^.*@', ''), '\.?(:(80|443))?$', '') || regexp_replace(path, '/$', '')
  || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end end as canonical from c),
r(verdict, site, start) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
b as (select k.page_id, max_by(r.site || r.start, length(r.site || r.start)) as rule, max_by(r.verdict, length(r.site || r.start)) as verdict
  from k join r on (k.host = r.site or ends_with(k.host, '.' || r.site)) and starts_with(k.path, r.start) group by all),
l as (select distinct canonical from k where page_id in (select doc_id from labels where toxic = 1) and canonical is not null)
select k.page_id, coalesce(host, '') as host, coalesce(path, '') as path, b.rule, coalesce(b.verdict, case when l.canonical is not null then 'block' else 'allow' end) as verdict,
 case when b.rule is null then l.canonical is not null end as listed
from k left join b using (page_id) left join l on l.canonical = k.canonical"""
