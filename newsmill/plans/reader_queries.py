"""Registered reader-facing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsmill import rules
from newsmill.operators import listing as L, reader_state as R
from newsmill.plans import fixtures as X
from newsmill.plans.registry import query

USER = 7
_EVENT = "coalesce(platform_published_at, updated_at)"
_NOW = f"timestamp '{X.NOW_TEXT}'"
_PUB = f"status = 'published' and {_EVENT} <= {_NOW}"
_READABLE = "status = 'published' and summary is not null and summary <> ''"


def categories(spark):
    """The fixed category dimension (11 rows)."""
    rows = [(i + 1, *c) for i, c in enumerate(rules.CATEGORIES)]
    return spark.createDataFrame(rows, "id bigint, name string, slug string, type string")


@query("news_list", f"""select id, title, section, {_EVENT} as event_time from news_fx
where {_PUB} and is_science and section = 'science' and category_slug in ('ai-agents', 'automation', 'chemistry')
and {_EVENT} >= {_NOW} - interval 720 hour""")
def news_list(spark, d):
    rows = L.news_filter(
        X.news(spark, d), X.now(), is_science=True, section="science",
        category_slugs=["ai-agents", "automation", "chemistry"], freshness="month",
    )
    return rows.select("id", "title", "section", L.event_time().alias("event_time"))


@query("news_page", f"""select id, title, category_name, event_time from (
select n.id, title, c.name as category_name, {_EVENT} as event_time from news_fx n left join categories_fx c on c.id = n.category_id
where {_PUB} and {_EVENT} >= {_NOW} - interval 720 hour) t order by event_time desc, id desc limit 20""")
def news_page(spark, d):
    rows = L.news_filter(X.news(spark, d), X.now(), freshness="month")
    page = L.news_page(rows.select("id", "title", "category_id", "platform_published_at", "updated_at"), 20)
    return L.with_category(page, categories(spark)).select(
        "id", "title", "category_name", L.event_time().alias("event_time")
    )


@query("news_total", f"select count(*) as total, 40 < count(*) as has_more from news_fx where {_PUB} and {_EVENT} >= {_NOW} - interval 168 hour")
def news_total(spark, d):
    return L.page_info(L.news_filter(X.news(spark, d), X.now(), freshness="week"), 20, 20)


_FRESH = " union all ".join(
    f"select '{k}' as freshness, count(*) as n, min({_EVENT}) as oldest from news_fx where {_PUB}"
    + (f" and {_EVENT} >= {_NOW} - interval {h} hour" if h else "")
    for k, h in [*rules.FRESHNESS_HOURS.items(), ("all", None)]
)


@query("freshness_window", _FRESH)
def freshness_window(spark, d):
    rows = L.news_filter(X.news(spark, d), X.now()).select(L.event_time().alias("t"))
    now = X.now()
    bounds = {**{k: L.freshness_from(k, now) for k in rules.FRESHNESS_HOURS}, "all": X.ntz("0001-01-01 00:00:00")}
    one = rows.agg(
        F.array(*[
            F.struct(F.lit(k).alias("freshness"), F.count_if(F.col("t") >= b).alias("n"),
                     F.min(F.when(F.col("t") >= b, F.col("t"))).alias("oldest"))
            for k, b in bounds.items()
        ]).alias("windows")
    )
    return one.select(F.inline("windows"))


@query("readable", f"select id, title from news_fx where {_READABLE}")
def readable(spark, d):
    return L.readable(X.news(spark, d)).select("id", "title")


@query("fts_match", f"""with tok as (select id, status, {_EVENT} as et, regexp_split_to_array(lower(concat_ws(' ', coalesce(title,''),
 coalesce(summary,''), coalesce(content,''), coalesce(translation,''))), '[^\\p{{L}}\\p{{N}}]+') as t from news_fx)
select id, et as event_time from tok where status = 'published' and et <= {_NOW} and list_contains(t, 'learning') and list_contains(t, 'machine')""")
def fts_match(spark, d):
    rows = L.news_filter(X.news(spark, d), X.now(), search="  Machine the LEARNING ")
    return rows.select("id", L.event_time().alias("event_time"))


@query("news_with_category", """select n.id, n.title, c.name as category_name from news_fx n left join categories_fx c on c.id = n.category_id""")
def news_with_category(spark, d):
    return L.with_category(X.news(spark, d), categories(spark)).select("id", "title", "category_name")


@query("row_by_id", """select id, title, status, score, original_url from news_fx where id = 42""")
def row_by_id(spark, d):
    return X.news(spark, d).filter(F.col("id") == 42).select("id", "title", "status", "score", "original_url")


@query("categories_by_type", """select c.id, c.name, c.slug, count(n.id) as articles from categories_fx c left join news_fx n on n.category_id = c.id
where c.type = 'science' group by 1, 2, 3""")
def categories_by_type(spark, d):
    used = X.news(spark, d).groupBy("category_id").agg(F.count("*").alias("articles"))
    return (
        categories(spark).filter(F.col("type") == "science")
        .join(used, F.col("id") == F.col("category_id"), "left")
        .select("id", "name", "slug", F.coalesce("articles", F.lit(0)).alias("articles"))
    )


@query("sources_enabled", "select id, name, url, type from sources_fx where enabled")
def sources_enabled(spark, d):
    return X.sources(spark, d).filter("enabled").select("id", "name", "url", "type")


@query("user_directory", "select id, name, email, role, created_at from users_fx order by created_at, id")
def user_directory(spark, d):
    return X.users(spark, d).select("id", "name", "email", "role", "created_at").orderBy("created_at", "id")


@query("unread", f"""select n.id, n.title from news_fx n where {_READABLE}
and not exists (select 1 from read_status_fx r where r.user_id = {USER} and r.news_id = n.id and r.read)""")
def unread(spark, d):
    return R.unread(X.news(spark, d), X.read_status(spark, d), USER).select("id", "title")


_SECTION_COUNTS = ", ".join(
    f"(select count(*) from n where section = '{s}') - count(k.id) filter (where k.section = '{s}') as unread_{s.replace('-', '_')}"
    for s in rules.SECTIONS
)


@query("unread_counts", f"""with n as (select id, section from news_fx where {_READABLE}),
k as (select r.user_id, n.id, n.section from read_status_fx r join n on n.id = r.news_id where r.read)
select u.id as user_id, (select count(*) from n) - count(k.id) as unread_total, {_SECTION_COUNTS} from users_fx u left join k on k.user_id = u.id group by u.id""")
def unread_counts(spark, d):
    return R.unread_counts(X.users(spark, d), X.news(spark, d), X.read_status(spark, d))


@query("read_flag", f"""select n.id, coalesce(r.read, false) as read from news_fx n
left join read_status_fx r on r.user_id = {USER} and r.news_id = n.id where status = 'published'""")
def read_flag(spark, d):
    rows = X.news(spark, d).filter(F.col("status") == "published").select("id")
    return R.with_read_flag(rows, X.read_status(spark, d), USER)


@query("mark_all_read", f"""select user_id, news_id, case when user_id = {USER} then true else read end as read,
 case when user_id = {USER} and not read then {_NOW} else read_at end as read_at from read_status_fx
union all select {USER}, n.id, true, {_NOW} from news_fx n where {_READABLE}
and not exists (select 1 from read_status_fx r where r.user_id = {USER} and r.news_id = n.id)""")
def mark_all_read(spark, d):
    return R.mark_all_read(X.news(spark, d), X.read_status(spark, d), USER, X.now())


_MARKS = "select distinct user_id, event_id * 7 % n_docs as news_id from events, params_fx where event_type = 'purchase'"


def _marks(spark, d):
    return X.favorites(spark, d).select("user_id", "news_id")


@query("mark_read", f"""with m as ({_MARKS}) select coalesce(r.user_id, m.user_id) as user_id, coalesce(r.news_id, m.news_id) as news_id,
 coalesce(r.read, false) or m.user_id is not null as read,
 case when m.user_id is not null and not coalesce(r.read, false) then {_NOW} else r.read_at end as read_at
from read_status_fx r full outer join m on m.user_id = r.user_id and m.news_id = r.news_id""")
def mark_read(spark, d):
    return R.mark_read(X.read_status(spark, d), _marks(spark, d), X.now())


@query("mark_unread", f"""with m as ({_MARKS}) select r.user_id, r.news_id, r.read and m.user_id is null as read,
 case when m.user_id is null then r.read_at end as read_at
from read_status_fx r left join m on m.user_id = r.user_id and m.news_id = r.news_id""")
def mark_unread(spark, d):
    return R.mark_unread(X.read_status(spark, d), _marks(spark, d))


@query("read_list", f"select user_id, news_id, read, read_at from read_status_fx where user_id = {USER}")
def read_list(spark, d):
    return X.read_status(spark, d).filter(F.col("user_id") == USER)


@query("favorites_list", f"""select f.created_at as favorited_at, n.id, n.title, n.original_url from favorites_fx f join news_fx n on n.id = f.news_id
where f.user_id = {USER} order by f.created_at desc, n.id desc""")
def favorites_list(spark, d):
    rows = R.favorites_list(X.favorites(spark, d), X.news(spark, d).select("id", "title", "original_url"), USER)
    return rows.select("favorited_at", "news.id", "news.title", "news.original_url")


_PAIRS = "select distinct user_id, event_id * 7 % n_docs as news_id from events, params_fx where event_type = 'view'"


def _pairs(spark, d):
    return X.events(spark, d).filter(F.col("event_type") == "view").select(
        "user_id", X.news_id(spark, d).alias("news_id")).distinct()


@query("favorite_check", f"""with p as ({_PAIRS}) select p.user_id, p.news_id, f.user_id is not null as is_favorite
from p left join favorites_fx f on f.user_id = p.user_id and f.news_id = p.news_id""")
def favorite_check(spark, d):
    return R.favorite_check(X.favorites(spark, d), _pairs(spark, d))


@query("add_favorite", f"""with p as ({_PAIRS}) select user_id, news_id, created_at from favorites_fx union all
select user_id, news_id, {_NOW} from p where not exists (select 1 from favorites_fx f where f.user_id = p.user_id and f.news_id = p.news_id)""")
def add_favorite(spark, d):
    return R.add_favorites(X.favorites(spark, d), _pairs(spark, d), X.now())


@query("remove_favorite", f"""with p as ({_PAIRS}) select user_id, news_id, created_at from favorites_fx f
where not exists (select 1 from p where f.user_id = p.user_id and f.news_id = p.news_id)""")
def remove_favorite(spark, d):
    return R.remove_favorites(X.favorites(spark, d), _pairs(spark, d))


@query("favorites_count", "select user_id, count(*) as favorites from favorites_fx group by 1")
def favorites_count(spark, d):
    return R.count_per_user(X.favorites(spark, d), "favorites")


@query("read_count", "select user_id, count(*) as read_articles from read_status_fx where read group by 1")
def read_count(spark, d):
    return R.count_per_user(X.read_status(spark, d).filter("read"), "read_articles")


@query("catalog", """select id, name, slug, array_to_string(spheres, ',') as spheres from tools_fx where list_has_any(spheres, ['chemistry', 'energy'])""")
def catalog(spark, d):
    rows = L.catalog(X.tools(spark, d), ["chemistry", "energy"])
    return rows.select("id", "name", "slug", F.array_join("spheres", ",").alias("spheres"))


@query("catalog_sorted", f"""select id, name, created_at from tools_fx where created_at >= {_NOW} - interval 168 hour order by created_at desc, id desc""")
def catalog_sorted(spark, d):
    return L.catalog_sorted(X.tools(spark, d).select("id", "name", "created_at"), X.now(), "week")


@query("distinct_spheres", "select distinct unnest(spheres) as sphere from tools_fx order by 1")
def distinct_spheres(spark, d):
    return L.distinct_spheres(X.tools(spark, d))


@query("mixed_feed", f"""with n as (select id, title, original_url, updated_at, {_EVENT} as et from news_fx where {_PUB} and section = 'invention-tools'
 and {_EVENT} >= {_NOW} - interval 720 hour),
t as (select id, name, created_at, spheres from tools_fx)
select 'news' as kind, id, updated_at as date, title, original_url from n union all
select 'tool', id, created_at, name, null from t where list_has_any(spheres, ['materials']) and created_at >= {_NOW} - interval 720 hour""")
def mixed_feed(spark, d):
    rows = L.news_filter(X.news(spark, d), X.now(), section="invention-tools", freshness="month")
    cards = L.catalog_sorted(L.with_any_sphere(X.tools(spark, d), ["materials"]), X.now(), "month")
    return L.mixed_feed(rows, cards)


@query("recent_logs", "select id, source_id, status, created_at from parsing_logs_fx order by created_at desc, id desc limit 20")
def recent_logs(spark, d):
    return L.recent_logs(X.parsing_logs(spark, d)).select("id", "source_id", "status", "created_at")


@query("logs_by_source", "select id, source_id, status, created_at from parsing_logs_fx where source_id = 5 order by created_at desc, id desc limit 20")
def logs_by_source(spark, d):
    return L.recent_logs(X.parsing_logs(spark, d), 5).select("id", "source_id", "status", "created_at")


@query("reading_minutes", "select id, greatest(1, cast(ceil(length(coalesce(summary, '')) / 1000) as bigint)) as minutes from news_fx")
def reading_minutes(spark, d):
    from newsmill.functions.text import reading_minutes as f
    return X.news(spark, d).select("id", f(F.col("summary")).alias("minutes"))
