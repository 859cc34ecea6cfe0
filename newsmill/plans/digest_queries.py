"""Registered digest and landing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsmill.functions import score as Z
from newsmill.operators import digest as G, language as N, prompts as P
from newsmill.plans import fixtures as X, sqltext as S
from newsmill.plans.registry import query
from newsmill.sources import landed as A

_ITEMS = """it as (select id, coalesce(nullif(section, ''), case when is_science then 'science' else 'ai-news' end) as section, coalesce(platform_published_at, updated_at) as ev_at, sphere_tags
 from news_fx where status = 'published' and summary is not null and summary <> ''),
rk as (select *, ev_at::date + 1 as day, row_number() over (partition by ev_at::date, section order by ev_at desc, id desc) as r from it)"""


def sections(spark, d):
    return G.digest_sections(G.digest_items(X.news(spark, d)))


@query("digest_sections", f"""with {_ITEMS}, tg as (select day, section, r, generate_subscripts(sphere_tags, 1) as p, unnest(sphere_tags) as tag from rk where r > 7),
ft as (select day, section, tag, min(r * 100 + p) as k from tg group by 1, 2, 3), f4 as (select *, row_number() over (partition by day, section order by k) as n from ft),
th as (select day, section, string_agg(tag, ',' order by n) as themes from f4 where n <= 4 group by 1, 2)
select r.day, r.section, count(*) as n, string_agg(r.id::varchar, ',' order by r.r) filter (r.r <= 7) as top, greatest(count(*) - 7, 0) as overflow, coalesce(max(t.themes), '') as themes
from rk r left join th t on t.day = r.day and t.section = r.section group by r.day, r.section""")
def digest_sections(spark, d):
    ids = F.array_join(F.transform("items", lambda i: i.id.cast("string")), ",")
    return sections(spark, d).select("day", "section", "n", ids.alias("top"), "overflow", F.array_join("themes", ",").alias("themes"))


@query("digest_text")
def digest_text(spark, d):
    return G.digest_text(sections(spark, d))


@query("split_text")
def split_text(spark, d):
    rows = G.digest_text(sections(spark, d)).withColumn("chunks", G.split_text(F.col("text")))
    return rows.select("day", F.posexplode("chunks").alias("chunk_no", "chunk"))


@query("json_path_extract", """with p as (select event_id, (props->>'$.k') as k from events) select event_id, coalesce(k, '') as title, 'https://e.com/' || event_id as url, '' as description, null::varchar as image_url from p""")
def json_path_extract(spark, d):
    item = F.concat(F.lit('{"articles": [{"meta": {"props": '), "props", F.lit('}, "url": " https://e.com/'), F.col("event_id").cast("string"), F.lit('"}]}'))
    rows = X.events(spark, d).select("event_id", item.alias("payload"))
    fields = {"title": "meta.props.k", "url": "url", "description": "description", "image_url": "imageUrl"}
    return A.json_path_extract(rows, "payload", fields=fields)


@query("tsv_listing", """select 'v' || id as video_id, TRIMMED as title, case when id % 5 <> 0 then strptime('20240' || (id % 9 + 1) || '0' || (id % 8 + 1), '%Y%m%d') end as published_at, 'https://y.com/' || id as url
from feed_fx where id % 3 <> 0 and TRIMMED <> ''""".replace("TRIMMED", S.trim("title")).replace("id %", "item_id %").replace("|| id", "|| item_id"))
def tsv_listing(spark, d):
    i = F.col("item_id")
    s = i.cast("string")
    date = F.when(i % 5 != 0, F.concat(F.lit("20240"), (i % 9 + 1).cast("string"), F.lit("0"), (i % 8 + 1).cast("string"))).otherwise("soon")
    line = F.concat_ws("\t", F.concat(F.lit("v"), s), F.trim(F.regexp_replace("title", "\n$", "")), date, F.when(i % 3 != 0, F.concat(F.lit("https://y.com/"), s)).otherwise(""))
    rows = A.tsv_listing(X.feed_items(spark, d).select(line.alias("line")))
    return rows.select("video_id", "title", "published_at", "url")


@query("caption_text", r"""with l as (select doc_id, string_split(text, chr(10)) as l from documents), c as (select doc_id, list_filter(list_transform(l, lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]+>', '', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') as k from l),
t as (select doc_id, trim(array_to_string(list_filter(k, lambda x, i: i = 1 or x <> k[i - 1]), ' ')) as t from c) select doc_id, case when length(t) >= 200 then t end as text from t""")
def caption_text(spark, d):
    cue = lambda x: F.concat(F.lit("00:01 --> 00:02\n<c>"), x, F.lit("</c>\n"), x)
    raw = F.concat(F.lit("WEBVTT\nKind: captions\n"), F.array_join(F.transform(F.split("text", "\n"), cue), "\n"))
    rows = X.table(spark, d, "documents").select("doc_id", raw.alias("raw"), F.lit("vtt").alias("kind"))
    return A.with_caption_text(rows, "raw", "kind").select("doc_id", "text")


@query("first_nonempty_by_priority", "with b as (select source_id, min(event_id % 7) as p from checks_fx where accessible group by source_id) select c.source_id, c.event_id from checks_fx c join b on b.source_id = c.source_id and c.event_id % 7 = b.p where accessible")
def first_nonempty_by_priority(spark, d):
    rows = X.checks(spark, d).filter("accessible").select("source_id", "event_id", (F.col("event_id") % 7).alias("priority"))
    return A.first_nonempty_by_priority(rows, "source_id", "priority").select("source_id", "event_id")


_TRACKS = "tracks as (select user_id as video_id, event_id as position, ['en', 'en-US', 'en-auto', 'de', 'fr'][event_id % 5 + 1] as lang, ['vtt', 'json3', 'srv1'][event_id % 3 + 1] as ext, event_type <> 'click' as automatic from events)"


@query("pick_caption_track", f"""with {_TRACKS}, r as (select *, row_number() over (partition by video_id order by automatic, case when lang = 'en' then 0 when lang = 'en-US' then 1 when lang = 'en-auto' then 2 else 3 end,
 case when lang in ('de', 'fr') then position else 0 end, case ext when 'json3' then 0 when 'vtt' then 1 else 2 end, position) as n from tracks) select video_id, position, lang, ext from r where n = 1""")
def pick_caption_track(spark, d):
    i = F.col("event_id")
    tracks = X.events(spark, d).select(
        F.col("user_id").alias("video_id"), i.alias("position"), X._pick(["en", "en-US", "en-auto", "de", "fr"], i % 5).alias("lang"),
        X._pick(["vtt", "json3", "srv1"], i % 3).alias("ext"), (F.col("event_type") != "click").alias("automatic"), F.lit("u").alias("url"),
    )
    return A.pick_caption_track(tracks).select("video_id", "position", "lang", "ext")


_BANNER = "<!-- Новости науки № 7 — ёлка --> "
_BANNER_1251 = "3c212d2d20cdeee2eef1f2e820ede0f3eae820b92037209720b8ebeae0202d2d3e20"


_WESTERN, _CYRILLIC = "".join(map(chr, range(0xC0, 0x100))), "".join(map(chr, range(0x410, 0x450)))
_OTHER = "[^\\x00-\\x7FÀ-ÿ]"


@query("decode_pages", f"""select page_id, {S.lit(_BANNER)} || case when page_id % 2 = 0 and not regexp_matches(html, '[^\\x00-\\x7FÀ-ÿ]') then translate(html, '{_WESTERN}', '{_CYRILLIC}') else html end as text
from pages""")
def decode_pages(spark, d):
    """Pages of even ids land as single bytes that are windows-1251, in which their Western letters are Cyrillic ones; all others land as UTF-8."""
    html = F.col("html")
    legacy = (F.col("page_id") % 2 == 0) & ~html.rlike(_OTHER)
    body = F.when(legacy, F.concat(F.unhex(F.lit(_BANNER_1251)), F.encode(F.regexp_replace(html, _OTHER, ""), "ISO-8859-1"))).otherwise(F.concat(F.encode(F.lit(_BANNER), "UTF-8"), F.encode(html, "UTF-8")))
    kind = F.when(legacy, "text/html; charset=windows-1251").otherwise("text/html; charset=utf-8")
    rows = X.table(spark, d, "pages").select("page_id", body.alias("body"), kind.alias("kind"))
    return rows.select("page_id", A.decoded(F.col("body"), F.col("kind")).alias("text"))


@query("detect_language")
def detect_language(spark, d):
    docs = X.table(spark, d, "documents")
    return N.detect_language(docs, N.language_profiles(docs))


@query("answer_text")
def answer_text(spark, d):
    rows = X.table(spark, d, "conversations").filter("role = 'assistant'")
    whole = F.concat(F.lit("**Научный редактор**\n"), "text", F.lit("\n\nP.S."))
    return rows.select("conv_id", "turn", P.without_artifact_lines(whole).alias("text"), P.first_paragraph(whole).alias("first"))


@query("youtube_breakdown")
def youtube_breakdown(spark, d):
    i = F.col("id")
    rows = X.news(spark, d).select(
        "id", F.when(i % 3 == 0, "youtube-two-minute-papers").otherwise("youtube-other").alias("source"), "title", "description",
        (i % 4000).alias("seconds"), F.when(i % 4 != 0, (i % 900 + 200).cast("int")).alias("chars"),
    )
    relevant = Z.youtube_relevant(F.col("source"), F.col("title"), F.col("description"))
    b = Z.youtube_breakdown(F.col("source"), relevant, F.col("seconds"), F.lit("auto"), F.col("chars"))
    return rows.select("id", Z.score_sum(b).alias("score"), F.array_join(b["criterion"], ",").alias("criteria"))
