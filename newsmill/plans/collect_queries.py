"""Registered collection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsmill import rules
from newsmill.operators import collect as K
from newsmill.operators.dedup import history_titles
from newsmill.plans import fixtures as X, sqltext as S
from newsmill.plans.reader_queries import categories
from newsmill.plans.registry import query

_NOW = f"timestamp '{X.NOW_TEXT}'"
_T, _L = S.trim("title"), S.trim("link")
CANDIDATES = f"""cand as (select * replace ({_T} as title, {_L} as link), iso_date as date, length(coalesce(description, '')) > 0 as has_description
 from feed_fx where coalesce({_T}, '') <> '' and {_L} like 'http%')"""
_FRESH = f"date is not null and date between {_NOW} - interval 72 hour and {_NOW}"


def candidates(spark, d):
    return K.feed_candidates(X.feed_items(spark, d))


@query("feed_candidates", f"with {CANDIDATES} select item_id, source, title, link, coalesce(date, {_NOW}) as date, has_description from cand")
def feed_candidates(spark, d):
    return K.feed_candidates(X.feed_items(spark, d), X.now()).select("item_id", "source", "title", "link", "date", "has_description")


@query("time_guard", f"with {CANDIDATES} select item_id, date from cand where {_FRESH}")
def time_guard(spark, d):
    return K.time_guard(candidates(spark, d), X.now()).select("item_id", "date")


@query("per_source_cap", """with r as (select item_id, source, is_science, row_number() over (partition by source order by position, item_id) as rank from feed_fx)
select item_id, source, rank, rank <= case when is_science then 15 else 10 end as keep from r""")
def per_source_cap(spark, d):
    cap = F.when(F.col("is_science"), rules.FEED_CAPS["science"]).otherwise(rules.FEED_CAPS["tech"])
    return K.per_source_cap(X.feed_items(spark, d), cap).select("item_id", "source", "rank", "keep")


@query("hot_stories", f"""select event_id, coalesce(nullif(title, ''), story_title) as title, url, points from hits_fx
where coalesce(nullif(title, ''), story_title, '') <> '' and url is not null and points >= 100 and ts >= {_NOW} - interval 72 hour""")
def hot_stories(spark, d):
    return K.hot_stories(X.hits(spark, d), X.now()).select("event_id", "title", "url", "points")


@query("trending_rank", f"""with r as (select full_name, stars, case when coalesce(description, '') <> '' then full_name || ' — ' || description else full_name end as title,
 row_number() over (order by stars desc, full_name) as rank from repos_fx where created_at::date >= {_NOW}::date - 3 and stars >= 300)
select full_name, stars, title, rank, rank <= 50 as keep from r""")
def trending_rank(spark, d):
    return K.trending_rank(X.repos(spark, d), X.now()).select("full_name", "stars", "title", "rank", "keep")


_TAB = "tab as (select * replace (title || ' (tab)' as title) from cand where item_id % 3 = 0)"


def _tab(spark, d):
    return candidates(spark, d).filter(F.col("item_id") % 3 == 0).withColumn("title", F.concat("title", F.lit(" (tab)")))


@query("merge_last_wins", f"""with {CANDIDATES}, {_TAB}, u as (select link, title, item_id, 0 as s, position from cand union all select link, title, item_id, 1, position from tab),
r as (select *, row_number() over (partition by link order by s desc, position desc) as n from u) select link, title, item_id from r where n = 1""")
def merge_last_wins(spark, d):
    pick = lambda rows: rows.select("link", "title", "item_id", "position")
    return K.merge_last_wins([pick(candidates(spark, d)), pick(_tab(spark, d))], "link").select("link", "title", "item_id")


@query("candidate_union", f"with {CANDIDATES}, {_TAB} select item_id, source, title from cand union all select item_id, source, title from tab")
def candidate_union(spark, d):
    pick = lambda rows: rows.select("item_id", "source", "title")
    return K.candidate_union(pick(candidates(spark, d)), pick(_tab(spark, d)))


@query("route_category", "select n.id, n.category_slug, c.id as category_id from (select id, case when id % 9 = 0 then 'unknown' else category_slug end as category_slug from news_fx) n left join categories_fx c on c.slug = n.category_slug")
def route_category(spark, d):
    rows = X.news(spark, d).select("id", F.when(F.col("id") % 9 == 0, "unknown").otherwise(F.col("category_slug")).alias("category_slug"))
    return K.route_category(rows, categories(spark), "category_slug").select("id", "category_slug", F.col("category_id").cast("int").alias("category_id"))


@query("first_per_title", f"""with {CANDIDATES}, r as (select source, item_id, title, row_number() over (partition by source, lower({S.trim('title')}) order by position) as n from cand)
select source, item_id, title from r where n = 1""")
def first_per_title(spark, d):
    return K.first_per_title(candidates(spark, d)).select("source", "item_id", "title")


_KNOWN = "known as (select distinct original_url as link from news_fx where id % 2 = 0)"


def _known(spark, d):
    return X.news(spark, d).filter(F.col("id") % 2 == 0).select(F.col("original_url").alias("link"))


@query("url_new_only", f"with {CANDIDATES}, {_KNOWN} select item_id, link from cand where link not in (select link from known)")
def url_new_only(spark, d):
    return candidates(spark, d).join(_known(spark, d), "link", "left_anti").select("item_id", "link")


@query("insert_ignore", f"with {CANDIDATES}, {_KNOWN} select link, min(item_id) as item_id from cand where link not in (select link from known) group by link")
def insert_ignore(spark, d):
    new = candidates(spark, d).select("link", "item_id")
    return K.insert_ignore(_known(spark, d), new, "link", "item_id")


@query("seen_except", f"with {CANDIDATES}, {_KNOWN} select link from cand except select link from known")
def seen_except(spark, d):
    return candidates(spark, d).select("link").subtract(_known(spark, d))


#: Going through the fresh candidates in order; texts are lower-cased as the rules want them.
_TEXT, _CONTEXT = "lower(coalesce(title, '') || ' ' || coalesce(description, ''))", f"lower({S.context('title', 'description')})"
_DECIDED = f"""{CANDIDATES}, {_KNOWN}, fresh as materialized (select *, {S.norm_title('title')} as k from cand where {_FRESH}),
hist as materialized (select id, {S.norm_title('coalesce(original_title, title)')} as k from news_fx where id % 2 = 0), p as ({S.similar_titles('fresh', 'hist')}),
best as (select l, h.id as match_id, 1 - d / n as similarity, row_number() over (partition by l order by 1 - d / n desc, h.id) as place from p join hist h on h.k = p.r),
judged as materialized (select f.*, case when f.link in (select link from known) then 'url-exists' when b.match_id is not null then 'semantic-title' else 'unique' end as reason, b.match_id, b.similarity
 from fresh f left join best b on b.l = f.k and b.place = 1),
r as materialized (select item_id as n, link, k from judged where reason = 'unique'), q as ({S.similar_titles('r', 'r')}),
c as (select b.n as n, a.n as a from r a join r b on a.link = b.link and a.n < b.n union select b.n, a.n from q join r a on a.k = q.l join r b on b.k = q.r and a.n < b.n),
conflicts as materialized (select r.n, coalesce(list(c.a) filter (c.a is not null), []) as before from r left join c on c.n = r.n group by r.n), {S.earlier_kept('conflicts')},
decided as (select cand.item_id, cand.source, cand.title, cand.description, case when j.item_id is null then 'stale' when j.reason <> 'unique' then j.reason when j.item_id in (select n from stay) then 'inserted' else 'duplicate-in-batch' end as decision,
 case when j.reason = 'semantic-title' then j.match_id end as match_id, case when j.reason = 'semantic-title' then j.similarity end as similarity from cand left join judged j on j.item_id = cand.item_id)"""
_FIELD_MAP = " ".join(f"when '{name}' then '{slug}'" for name, slug in rules.SCIENCE_FIELD_MAP.items() if slug)
_OVERRIDE = " ".join(f"when '{name}' then '{slug}'" for name, slug in rules.SCIENCE_SOURCE_OVERRIDE.items())
_FIELDS = f"""texts as (select *, {_TEXT} as t, {_CONTEXT} as x from decided where decision = 'inserted'), classed as (select *, {S.article_class('t')} from texts),
routed as (select *, case when is_science then coalesce(case source {_OVERRIDE} end, case science_field {_FIELD_MAP} end, {S.argmax('t', rules.SCIENCE_RULES, rules.SCIENCE_DEFAULT)}) end as slug from classed),
filled as (select r.item_id, r.is_science, r.science_field, case when {S.invention('x')} then 'invention-tools' when r.is_science then 'science' else 'ai-news' end as section,
 array_to_string({S.spheres('x')}, ',') as spheres, substr(r.title, 1, {rules.MAX_TITLE_CHARS}) as stored_title, c.slug as category_slug, cast(c.id as int) as category_id
 from routed r left join categories_fx c on c.slug = r.slug and c.type = 'science')"""


def _decided(spark, d):
    history = history_titles(X.news(spark, d).filter(F.col("id") % 2 == 0))
    return K.collect(candidates(spark, d), _known(spark, d), X.now(), history=history, categories=categories(spark))


@query("collect", f"""with recursive {_DECIDED}, {_FIELDS} select d.item_id, d.decision, d.match_id, round(d.similarity, 6) as similarity, f.is_science, f.science_field, f.section, f.spheres, f.stored_title, f.category_slug, f.category_id
from decided d left join filled f on f.item_id = d.item_id""")
def collect(spark, d):
    return _decided(spark, d).select(
        "item_id", "decision", "match_id", F.round("similarity", 6).alias("similarity"), "is_science", "science_field", "section",
        F.array_join("sphere_tags", ",").alias("spheres"), "stored_title", "category_slug", F.col("category_id").cast("int").alias("category_id"),
    )


_COUNTS = """count(*) as raw, count(*) filter (decision <> 'stale') as fresh, count(*) filter (decision = 'stale') as stale_dropped, count(*) filter (decision = 'inserted') as inserted,
 count(*) filter (decision = 'url-exists') as duplicate_urls, count(*) filter (decision = 'semantic-title') as duplicate_titles, count(*) filter (decision = 'duplicate-in-batch') as duplicate_in_batch"""


@query("collect_funnel", f"with recursive {_DECIDED} select {_COUNTS} from decided")
def collect_funnel(spark, d):
    return K.collect_funnel(_decided(spark, d))
