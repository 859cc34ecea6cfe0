"""Registered life-cycle, health and audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsmill.operators import health as H, lifecycle as Y
from newsmill.plans import fixtures as X
from newsmill.plans.registry import query
from newsmill.plans.reader_queries import categories
from newsmill import rules

_NOW = f"timestamp '{X.NOW_TEXT}'"


@query("upsert", f"""with n as (select id, name || ' (new)' as name, 'kind' as kind, {_NOW} as created_at from tools_fx where id % 3 = 0 union all
select id + 1000000, name, kind, {_NOW} from tools_fx where id % 5 = 0)
select coalesce(t.id, n.id) as id, coalesce(n.name, t.name) as name, coalesce(n.kind, t.kind) as kind, coalesce(t.created_at, n.created_at) as created_at
from tools_fx t full outer join n on n.id = t.id""")
def upsert(spark, d):
    t = X.tools(spark, d).select("id", "name", "kind", "created_at")
    changed = t.filter(F.col("id") % 3 == 0).select("id", F.concat("name", F.lit(" (new)")).alias("name"), F.lit("kind").alias("kind"), X.now().alias("created_at"))
    added = t.filter(F.col("id") % 5 == 0).select((F.col("id") + 1000000).alias("id"), "name", "kind", X.now().alias("created_at"))
    return Y.upsert(t, changed.unionAll(added), "id", ["name", "kind"])


@query("quarantine_invalid", r"""select id, array_to_string(list_filter([case when trim(coalesce(slug, '')) = '' then 'slug' end, case when trim(coalesce(name, '')) = '' then 'name' end,
 case when trim(coalesce(kind, '')) = '' then 'kind' end, case when len(spheres) = 0 then 'spheres' end, case when trim(coalesce(description, '')) = '' then 'description' end,
 case when not regexp_matches(official_url, '(?i)^https?://\S+$') then 'official_url' end], lambda x: x is not null), ',') as errors from tools_fx""")
def quarantine_invalid(spark, d):
    return Y.with_tool_errors(X.tools(spark, d)).select("id", F.array_join("errors", ",").alias("errors"))


@query("status_update", f"""select id, case when status = 'translated' then 'published' else status end as status, case when status = 'translated' then {_NOW} else updated_at end as updated_at,
 case when status = 'translated' then {_NOW} else platform_published_at end as platform_published_at from news_fx""")
def status_update(spark, d):
    n = X.news(spark, d).select("id", "status", "updated_at", "platform_published_at")
    return Y.set_status(n, n.filter(F.col("status") == "translated"), "published", X.now())


@query("purge_by_status", "select status, count(*) as n, status in ('pending', 'summarized', 'translated', 'published') as purged from news_fx group by status")
def purge_by_status(spark, d):
    return Y.purge_report(X.news(spark, d))


@query("purged", "select id, status from news_fx where status = 'rejected'")
def purged(spark, d):
    return Y.purge(X.news(spark, d)).select("id", "status")


@query("refresh_stamp", f"select id, updated_at, {_NOW} as last_verified_at from tools_fx")
def refresh_stamp(spark, d):
    return Y.refresh_stamp(X.tools(spark, d), X.now()).select("id", "updated_at", "last_verified_at")


_SETTING = "case type when 'api' then 'paths' when 'html' then 'selector' else 'feedUrl' end as setting"


@query("sources_admin", f"""select id, name, case when id % 7 = 0 then not enabled else enabled end as enabled, {_SETTING} from (select id, name, type, enabled from sources_fx
 union all select id + 1000000, name, type, true from sources_fx where type = 'html') s where id % 11 <> 0""")
def sources_admin(spark, d):
    s = X.sources(spark, d)
    new = s.filter("type = 'html'").select((F.col("id") + 1000000).alias("id"), "name", "url", "type")
    known = Y.add_sources(s, new)
    known = Y.toggle_sources(known, known.filter(F.col("id") % 7 == 0))
    return known.filter(F.col("id") % 11 != 0).select("id", "name", "enabled", "setting")


@query("backfill_recoverable", f"""select id from news_fx where published_at between {_NOW} - interval 96 hour and {_NOW} - interval 72 hour
and ((status = 'rejected' and metrics->>'$.decision' = 'rejected-daily-cap') or (status = 'pending' and score is null)) and id % 4 <> 0""")
def backfill_recoverable(spark, d):
    n = X.news(spark, d)
    then = F.lit("2024-01-29 00:00:00").cast("timestamp_ntz")
    return Y.recoverable(n, n.filter(F.col("id") % 4 == 0).select("id"), then).select("id")


@query("work_queue", """select 'summarize' as stage, id from news_fx where status = 'pending' and content is null union all
select 'translate', id from news_fx where status = 'summarized' and is_science union all select 'deploy', id from news_fx where status = 'translated'""")
def work_queue(spark, d):
    n = X.news(spark, d)
    parts = [Y.work_queue(n, s, science).select(F.lit(s).alias("stage"), "id") for s, science in (("summarize", None), ("translate", True), ("deploy", None))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("publishable_by_section", "select section, count(*) as n from news_fx where status = 'summarized' and coalesce(summary, '') <> '' group by section")
def publishable_by_section(spark, d):
    return Y.publishable_by_section(X.news(spark, d))


@query("proportional_batch", """with r as (select id, section, count(*) over (partition by section) as n, count(*) over () as total, row_number() over (partition by section order by id) as k
 from news_fx where status = 'summarized' and coalesce(summary, '') <> '') select id, section from r where k <= least(n, greatest(1, round_even(19 * n / total, 0))) order by section, id limit 19""")
def proportional_batch(spark, d):
    return Y.proportional_batch(X.news(spark, d))


@query("backfill_report", """select count(*) as total, count(*) filter (status = 'pending') as pending, count(*) filter (status = 'summarized') as summarized, count(*) filter (status = 'rejected') as rejected,
 count(*) filter (status = 'published') as published, count(*) filter (status = 'published' and source not like 'youtube-%') as published_text,
 count(*) filter (status = 'published' and source like 'youtube-%') as published_video from (select status, case when id % 3 = 0 then 'youtube-' || source else source end as source from news_fx) t""")
def backfill_report(spark, d):
    n = X.news(spark, d)
    return Y.backfill_report(n.withColumn("source", F.when(F.col("id") % 3 == 0, F.concat(F.lit("youtube-"), "source")).otherwise(F.col("source"))))


@query("failure_policy", """select article_id, stage, count(*) as attempts, arg_max(reason, {'t': ts, 'e': event_id}) as last_reason, max(ts) as last_at,
 (stage in ('fetch', 'extract') and count(*) >= 3) or bool_or(is_youtube and stage = 'fetch' and reason = 'youtube-transcript-unavailable') as reject from failures_fx group by article_id, stage""")
def failure_policy(spark, d):
    return Y.failure_policy(X.failures(spark, d))


_STATUS = "case when not accessible then 'failed' when not selector_works then 'degraded' else 'healthy' end"
_HEALTH = f"""hc as (select *, {_STATUS} as status, row_number() over (partition by source_id order by ts, event_id) as n from checks_fx),
hh as (select source_id, max(n) filter (status = 'healthy') as h from hc group by source_id),
health as (select hc.source_id, arg_max(status, n) as status, max(ts) as last_checked_at, max(ts) filter (status = 'healthy') as last_success_at, avg(accessible::int) as success_rate,
 avg(response_ms) as avg_response_ms, arg_max(error, n) filter (error is not null) as last_error, count(*) as n_checks, count(*) filter (n > coalesce(h, 0)) as consecutive_fails
 from hc join hh using (source_id) group by hc.source_id)"""


def _health(spark, d):
    return H.source_health(X.checks(spark, d))


@query("source_health", f"with {_HEALTH} select * replace (round(success_rate, 6) as success_rate, round(avg_response_ms, 4) as avg_response_ms) from health")
def source_health(spark, d):
    return _health(spark, d).withColumns({"success_rate": F.round("success_rate", 6), "avg_response_ms": F.round("avg_response_ms", 4)})


@query("source_plan", f"""with {_HEALTH}, j as (select s.id, s.name, h.status, coalesce(consecutive_fails, 0) as f, coalesce(success_rate, 1) as r from sources_fx s left join health h on h.source_id = s.id where enabled)
select id, name, case when f > 0 then 20 when coalesce(status = 'failed', false) then 10 else 50 end as max_articles,
 case when coalesce(status = 'failed', false) or f >= 3 then 'low' when f >= 1 then 'medium' else 'high' end as priority from j where not (f >= 5 or (r < 0.2 and f >= 3))""")
def source_plan(spark, d):
    return H.source_plan(X.sources(spark, d), _health(spark, d)).select("id", "name", "max_articles", "priority")


@query("health_transitions", f"""with h as (select source_id, event_id, ts, {_STATUS} as status, lag({_STATUS}) over (partition by source_id order by ts, event_id) as previous from checks_fx)
select source_id, event_id, status from h where previous = 'healthy' and status <> 'healthy'""")
def health_transitions(spark, d):
    return H.health_transitions(X.checks(spark, d)).select("source_id", "event_id", "status")


@query("sources_with_health", f"with {_HEALTH} select s.id, s.name, coalesce(h.status, 'unknown') as status, coalesce(h.consecutive_fails, 0) as consecutive_fails from sources_fx s left join health h on h.source_id = s.id")
def sources_with_health(spark, d):
    return H.sources_with_health(X.sources(spark, d), _health(spark, d)).select("id", "name", "status", "consecutive_fails")


@query("log_rollup", "select source_id, sum(articles_found)::bigint as found, sum(articles_new)::bigint as new, count(*) filter (status = 'failed') as failures, count(*) as runs from parsing_logs_fx group by source_id")
def log_rollup(spark, d):
    return H.log_rollup(X.parsing_logs(spark, d))


@query("run_metrics", "select sum(articles_found)::bigint as found, sum(articles_new)::bigint as new, count(*) filter (status = 'failed') as errors, string_agg(distinct error_message, '; ' order by error_message) as messages from parsing_logs_fx")
def run_metrics(spark, d):
    return H.run_metrics(X.parsing_logs(spark, d))


@query("run_messages", "select error_message as message, count(*) as n, min(created_at) as first_at, max(created_at) as last_at from parsing_logs_fx where error_message is not null group by 1")
def run_messages(spark, d):
    return H.run_messages(X.parsing_logs(spark, d))


_STAGES = """st as (select cycle_id, stage, arg_max(total, {'t': ts, 's': seq}) as total, arg_max(processed, {'t': ts, 's': seq}) as processed,
 arg_max(error, {'t': ts, 's': seq}) filter (error is not null) as error, min(ts) as started_at, max(ts) as updated_at from stage_events_fx group by cycle_id, stage)"""


@query("cycle_stages", f"with {_STAGES} select * from st")
def cycle_stages(spark, d):
    return H.cycle_stages(X.stage_events(spark, d))


@query("latest_cycle", f"with {_STAGES} select * from st where cycle_id = (select arg_max(cycle_id, {{'t': updated_at, 'c': cycle_id}}) from st)")
def latest_cycle(spark, d):
    return H.latest_cycle(H.cycle_stages(X.stage_events(spark, d)))


_AUDIT = """pr as (select news_id, arg_max({'h': http_status, 'd': dns_error}, {'t': ts, 'e': event_id}) as p from probes_fx group by news_id),
audit as (select n.id, case when p.d or p.h in (404, 410) then 'dead' when p.h between 200 and 399 then 'alive' else 'unknown' end as link, status as old from news_fx n left join pr on pr.news_id = n.id),
audited as (select id, link, case when link = 'dead' then 'rejected' else old end as status from audit)"""


@query("link_audit", f"with {_AUDIT} select id, link, status from audited")
def link_audit(spark, d):
    return H.link_audit(X.news(spark, d).select("id", "status"), X.probes(spark, d))


@query("link_audit_summary", f"""with {_AUDIT} select count(*) as total, count(*) filter (link = 'alive') as alive, count(*) filter (link = 'dead') as dead,
 count(*) filter (link = 'unknown') as unknown, count(*) filter (status = 'rejected') as rejected from audited""")
def link_audit_summary(spark, d):
    return H.link_audit_summary(H.link_audit(X.news(spark, d).select("id", "status"), X.probes(spark, d)))


_RETIRED = [*rules.RETIRED_CATEGORY_SLUGS, "automation"]
_FIRST_RETIRED = 100
_RETIRED_ROWS = ", ".join(f"({_FIRST_RETIRED + k}, '{slug}')" for k, slug in enumerate(rules.RETIRED_CATEGORY_SLUGS))


def _category_of_article():
    """Some articles, pending ones among them, are still filed under the first and the fourth retired category; none under automation."""
    i, usual = F.col("id"), F.col("category_id")
    return F.when(i % 40 == 7, _FIRST_RETIRED).when((i % 50 == 3) & (F.col("status") == "pending"), _FIRST_RETIRED + 3).when(usual == 3, 4).otherwise(usual)


@query("obsolete_categories", f"""with c as (select id, slug from categories_fx union all select * from (values {_RETIRED_ROWS})),
used as (select case when id % 40 = 7 then {_FIRST_RETIRED} when id % 50 = 3 and status = 'pending' then {_FIRST_RETIRED + 3} when category_id = 3 then 4 else category_id end as id from news_fx)
select c.id, c.slug from c where c.slug in ({', '.join(f"'{s}'" for s in _RETIRED)}) and c.id not in (select id from used)""")
def obsolete_categories(spark, d):
    old = spark.createDataFrame([(_FIRST_RETIRED + k, slug) for k, slug in enumerate(rules.RETIRED_CATEGORY_SLUGS)], "id bigint, slug string")
    used = X.news(spark, d).select(_category_of_article().cast("bigint").alias("id")).distinct()
    return categories(spark).select("id", "slug").unionAll(old).filter(F.col("slug").isin(_RETIRED)).join(used, "id", "left_anti")


@query("category_distribution", "select category_slug, count(*) as n from news_fx where category_slug is not null group by category_slug")
def category_distribution(spark, d):
    return X.news(spark, d).filter("category_slug is not null").groupBy("category_slug").agg(F.count("*").alias("n"))
