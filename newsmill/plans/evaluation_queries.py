"""Registered evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsmill import rules
from newsmill.functions import score as Z, text as T
from newsmill.operators import evaluation as V
from newsmill.plans import fixtures as X, sqltext as S
from newsmill.plans.registry import query

_NOW = f"timestamp '{X.NOW_TEXT}'"
_DOI = "'(?i)" + rules.DOI_PATTERN + "'"
_REPO = "'github\\.com/([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)'"
_SIG = f"""sig as (select page_id, url, list_filter(l, lambda x, i: list_position(l, x) = i) as links, list_filter(dd, lambda x, i: list_position(dd, x) = i) as dois, page_text from (
 select page_id, url, regexp_extract_all(html, '(?i)href=["''](http[^"'']*)["'']', 1) as l,
 list_transform(regexp_extract_all(html, {_DOI}), lambda x: regexp_replace(x, '[.)]+$', '')) as dd,
 {S.collapse("regexp_replace(html, '(?is)<(?:script|style)[^>]*>[\\s\\S]*?</(?:script|style)>|<[^>]*>', ' ', 'g')")} as page_text from pages_fx) z)"""


@query("page_signals", f"""with {_SIG} select page_id, array_to_string(links, ' ') as links, array_to_string(dois, ' ') as dois, page_text,
 list_filter(list_transform(links, lambda x: nullif(regexp_extract(x, {_REPO}, 1), '')), lambda x: x is not null)[1] as repo from sig""")
def page_signals(spark, d):
    s = V.page_signals(X.pages(spark, d))
    return s.select("page_id", F.array_join("links", " ").alias("links"), F.array_join("dois", " ").alias("dois"), "page_text", "repo")


_SRC = ["arxiv", "nature", "mit-tech-review", "src"]
_ENR = f"""{_SIG}, art as (select n.id, n.title, n.section, n.is_science, n.original_url, {X._sql_list(_SRC)}[n.id % 4 + 1] as source, n.id % 60 as trending_rank,
 case when n.id % 4 = 3 then cast(n.id % 50 as int) end as pre_points, coalesce(s.links, []::varchar[]) as links, coalesce(s.dois, []::varchar[]) as dois, s.page_text,
 list_filter(list_transform(s.links, lambda x: nullif(regexp_extract(x, {_REPO}, 1), '')), lambda x: x is not null)[1] as repo from news_fx n left join sig s on s.page_id = n.id),
hu as (select url, max(points) as p from hits_fx where url is not null group by url), ht as (select title, max(points) as p from hits_fx where title is not null group by title),
ds as (select lower(doi) as doi, cast(floor(max(score) + 0.5) as int) as altmetric from doi_scores_fx group by 1),
enr as (select a.*, coalesce(pre_points, nullif(hu.p, 0), ht.p, hu.p) as hn_points, ds.altmetric, r.stars, r.license, r.created_at as repo_created_at, r.description as repo_description, r.topics as repo_topics,
 r.full_name is not null as repo_found from art a left join hu on hu.url = a.original_url left join ht on ht.title = a.title left join ds on ds.doi = lower(a.dois[1]) left join repos_fx r on r.full_name = a.repo)"""


def enriched(spark, d):
    n = X.news(spark, d)
    i = F.col("id")
    articles = n.select(
        "id", "title", "section", "is_science", "original_url", "sphere_tags", "created_at", "status", X._pick(_SRC, i % 4).alias("source"),
        (i % 60).alias("trending_rank"), F.when(i % 4 == 3, (i % 50).cast("int")).alias("hn_points"),
    )
    signals = V.page_signals(X.pages(spark, d)).drop("url")
    articles = V.with_signals(articles, signals.withColumnRenamed("page_id", "id"))
    return V.enrich_signals(articles, X.hits(spark, d), X.doi_scores(spark, d), X.repos(spark, d))


@query("enrich_signals", f"with {_ENR} select id, hn_points, altmetric, repo, stars, license, repo_found from enr")
def enrich_signals(spark, d):
    return enriched(spark, d).select("id", "hn_points", "altmetric", "repo", "stars", "license", "repo_found")


@query("open_artifact", f"with {_ENR} select id, repo_found or len(list_filter(links, lambda x: regexp_matches(x, '{rules.ARTIFACT_LINK_PATTERN}'))) > 0 as open_artifact from enr")
def open_artifact(spark, d):
    return enriched(spark, d).select("id", Z.open_artifact(F.col("repo_found"), F.col("links")).alias("open_artifact"))


_lists = lambda names: "(" + ", ".join(S.lit(x) for x in names) + ")"
_EV = "concat_ws(' ', coalesce(title, ''), coalesce(page_text, ''), coalesce(repo_description, ''), coalesce(array_to_string(repo_topics, ' '), ''))"
_CRITERIA = [
    ("inv and section <> 'invention-tools'", "invention-reroute", 0), ("inv", "invention-tool-bonus", 25),
    ("sci and tier1", "tier1-source", 45), ("sci and not tier1 and tier2", "tier2-source", 30),
    ("sci and arx and artifact", "arxiv-with-code", 35), ("sci and arx and not artifact", "arxiv-preprint", 10), ("sci and altmetric >= 50", "altmetric-buzz", 20),
    (f"sci and {S.matches('low', rules.AI_TERMS, False)} and {S.matches('low', rules.SCIENCE_DOMAIN_TERMS, False)}", "ai-domain-intersection", 15),
    ("not sci and trending_rank <= 10", "github-trending-top10", 40), ("not sci and trending_rank > 10 and trending_rank <= 50", "github-trending-top50", 25),
    ("not sci and stars > 10000", "github-stars-10k", 30), ("not sci and stars > 1000 and stars <= 10000", "github-stars-1k", 20),
    (f"not sci and stars > 500 and stars <= 1000 and repo_created_at >= {_NOW} - interval 30 day", "github-stars-500-new", 25),
    ("not sci and coalesce(hn_points, 0) > 100", "social-traction-100", 30), ("not sci and coalesce(hn_points, 0) > 30 and coalesce(hn_points, 0) <= 100", "social-traction-30", 15),
    (f"not sci and {S.matches('low', rules.TECH_TREND_TERMS, False)}", "tech-trend-bonus", 15), ("not sci and license in ('MIT', 'Apache-2.0')", "open-license", 10),
]
_SCORE = f"""{_ENR}, ev as (select *, {_EV} as ev, lower({_EV}) as low, {S.invention(S.context('title', 'page_text'))} as inv,
 coalesce(is_science, false) or source in {_lists(rules.TIER1_SOURCES + rules.TIER2_SOURCES)} as sci, source in {_lists(rules.TIER1_SOURCES)} as tier1,
 original_url like '%arxiv.org%' or source = 'arxiv' or len(list_filter(links, lambda x: contains(x, 'arxiv.org'))) > 0 as arx,
 repo_found or len(list_filter(links, lambda x: regexp_matches(x, '{rules.ARTIFACT_LINK_PATTERN}'))) > 0 as artifact from enr),
ev2 as (select *, source in {_lists(rules.TIER2_SOURCES)} or {S.matches('ev', rules.CONFERENCE_TERMS, False)} as tier2 from ev),
scored as (select id, array_to_string(list_filter([{', '.join(f"case when {w} then '{n}' end" for w, n, _ in _CRITERIA)}], lambda x: x is not null), ',') as criteria,
 cast({' + '.join(f"case when {w} then {p} else 0 end" for w, _, p in _CRITERIA)} as int) as score, case when inv then 'invention-tools' else section end as section from ev2)"""


def scored(spark, d):
    return Z.score_articles(enriched(spark, d), X.now())


@query("score_article", f"with {_SCORE} select id, score, criteria, section from scored")
def score_article(spark, d):
    return scored(spark, d).select("id", "score", F.array_join(F.col("breakdown.criterion"), ",").alias("criteria"), "section")


@query("score_sum", f"with {_SCORE}, c as (select id, unnest(string_split(criteria, ',')) as criterion from scored) select criterion, count(*) as n from c where criterion <> '' group by criterion")
def score_sum(spark, d):
    return Z.criteria_counts(scored(spark, d))


@query("eval_top5", f"with {_SCORE} select id, score from scored order by score desc, id desc limit 5")
def eval_top5(spark, d):
    return scored(spark, d).select("id", "score").orderBy(F.col("score").desc(), F.col("id").desc()).limit(5)


@query("score_youtube", """with v as (select event_id, event_id % 3 <> 0 as t, event_id % 5000 as s, event_id % 4 = 0 as dedicated, event_id % 7 = 0 as relevant from events)
select event_id, case when t then 55 + case when dedicated or relevant then 15 else 0 end + case when s between 240 and 2700 then 10 else 0 end else 0 end::int as score,
 t and 55 + case when dedicated or relevant then 15 else 0 end + case when s between 240 and 2700 then 10 else 0 end > 65 as eligible, case when t then 'scored' else 'transcript-unavailable' end as reason from v""")
def score_youtube(spark, d):
    i = F.col("event_id")
    found = Z.score_youtube(i % 3 != 0, i % 5000, i % 4 == 0, i % 7 == 0)
    return X.events(spark, d).select("event_id", *[v.alias(k) for k, v in found.items()])


_DAY = "timestamp '2024-01-30 00:00:00'"
_TODAY = f"(select count(*) from news_fx where score >= 50 and status in ('pending', 'summarized', 'translated', 'published') and created_at >= {_DAY})"


@query("gate_and_cap", f"""with r as (select id, score, row_number() over (order by score desc nulls last, created_at desc, id desc) as k from news_fx where status = 'pending')
select id, case when score >= 50 and k <= greatest(0, 60 - {_TODAY}) then 'approved' when score >= 50 then 'rejected-daily-cap' else 'rejected-low-score' end as decision from r""")
def gate_and_cap(spark, d):
    n = X.news(spark, d)
    today = V.approved_today(n, X.ntz("2024-01-30 09:00:00"))
    return V.gate_and_cap(n.filter("status = 'pending'").select("id", "score", "created_at"), today, 60).select("id", "decision")


@query("gate_without_cap", "select id, case when score >= 50 then 'approved' else 'rejected-low-score' end as decision from news_fx")
def gate_without_cap(spark, d):
    return V.gate_and_cap(X.news(spark, d).select("id", "score", "created_at"), F.lit(0)).select("id", "decision")


@query("pending_for_eval", "select id from news_fx where status = 'pending' and score is null")
def pending_for_eval(spark, d):
    return V.pending_for_eval(X.news(spark, d)).select("id")


_MAN = "man as (select * from news_fx where status = 'pending' and content is null and score >= 66)"
_MAN_COLS = ["id", "title", "source", "language", "section", "score", "original_url", "published_at", "is_science", "science_field", "description", "original_title", "status"]


@query("manifest", f"with {_MAN} select {', '.join(_MAN_COLS)} from man")
def manifest(spark, d):
    return V.manifest(X.news(spark, d)).select(*_MAN_COLS)


@query("manifest_summary", f"""with {_MAN} select 'total' as kind, null as value, count(*) as n from man union all select 'status', status, count(*) from man group by status union all
select 'language', language, count(*) from man where language is not null group by language union all select 'source', source, count(*) from man group by source""")
def manifest_summary(spark, d):
    return V.manifest_summary(V.manifest(X.news(spark, d)))
