"""Registered reads of landed files and writes of published ones; each run lands its files in a folder of its own."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from newsmill.operators import evaluation as V
from newsmill.plans import fixtures as X
from newsmill.plans.evaluation_queries import _MAN, _MAN_COLS
from newsmill.plans.registry import query
from newsmill.session import shared_folder
from newsmill.sources import files as A

_FIELDS = {"event_id": "id", "title": "meta.props.k", "url": "url", "description": "description", "image_url": "imageUrl"}


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _payload_lines(spark, d):
    """A payload a line; some lines are cut off and some have another shape."""
    i = F.col("event_id")
    whole = F.concat(F.lit('{"articles": [{"id": '), i.cast("string"), F.lit(', "meta": {"props": '), "props", F.lit('}, "url": " https://e.com/'), i.cast("string"), F.lit('"}]}'))
    line = F.when(i % 17 == 0, F.concat(F.lit('{"articles": [{"id": '), i.cast("string"))).when(i % 19 == 0, F.concat(F.lit('{"items": '), i.cast("string"), F.lit("}"))).otherwise(whole)
    folder = _folder(spark)
    X.events(spark, d).select(line.alias("value")).write.text(folder)
    return A.landed_lines(spark, folder)


@query("landed_json", """select event_id::varchar as event_id, coalesce(props->>'$.k', '') as title, 'https://e.com/' || event_id as url, '' as description, null::varchar as image_url
from events where event_id % 17 <> 0 and event_id % 19 <> 0""")
def landed_json(spark, d):
    return A.read_json_payloads(_payload_lines(spark, d), fields=_FIELDS)[0].drop("file")


@query("landed_json_rejects", """select case when event_id % 17 = 0 then '{"articles": [{"id": ' || event_id else '{"items": ' || event_id || '}' end as line,
 case when event_id % 17 = 0 then 'not-json' else 'no-items' end as reason from events where event_id % 17 = 0 or event_id % 19 = 0""")
def landed_json_rejects(spark, d):
    return A.read_json_payloads(_payload_lines(spark, d), fields=_FIELDS)[1].select("line", "reason")


def _listing_lines(spark, d):
    i = F.col("id")
    s = i.cast("string")
    title = F.when(i % 13 != 0, F.concat(F.lit("Video "), s, F.lit(" ")))
    line = F.concat_ws("\t", F.concat(F.lit("v"), s), F.coalesce(title, F.lit("")), F.date_format("published_at", "yyyyMMdd"), F.when(i % 11 != 0, F.concat(F.lit("https://y.com/"), s)).otherwise(""))
    folder = _folder(spark)
    X.news(spark, d).select(line.alias("value")).write.text(folder)
    return A.landed_lines(spark, folder)


@query("landed_tsv", "select 'v' || id as video_id, 'Video ' || id as title, published_at::date::timestamp as published_at, 'https://y.com/' || id as url from news_fx where id % 13 <> 0 and id % 11 <> 0")
def landed_tsv(spark, d):
    return A.read_tsv_listing(_listing_lines(spark, d))[0]


@query("landed_tsv_rejects", "select case when id % 13 = 0 then 'no-title' else 'no-url' end as reason, count(*) as n from news_fx where id % 13 = 0 or id % 11 = 0 group by 1")
def landed_tsv_rejects(spark, d):
    return A.read_tsv_listing(_listing_lines(spark, d))[1].groupBy("reason").agg(F.count("*").alias("n"))


@query("manifest_file", f"with {_MAN} select {', '.join(_MAN_COLS)} from man")
def manifest_file(spark, d):
    """The manifest written as JSON files under a commit record, and read back."""
    sink = A.JsonSink(spark, _folder(spark))
    sink.write(V.manifest(X.news(spark, d)).select(*_MAN_COLS), "cycle-1", sources=F.approx_count_distinct("source"))
    return sink.read("cycle-1")
