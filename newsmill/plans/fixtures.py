"""Input tables of the registered queries, derived by Spark from the given tables.

Every function reads parquet lazily and returns a DataFrame whose size grows
with the given tables.  ``DUCK`` holds the same derivations as DuckDB CTEs for
the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsmill import rules

NOW_TEXT = "2024-01-31 00:00:00"
START_TEXT = "2024-01-01 00:00:00"

PHRASES = [
    ("GPT agent for chemistry: new catalyst discovered with machine learning", "protein folding and retrosynthesis"),
    ("Large language model updates: version v3 of the RAG pipeline", "retrieval augmented generation, MCP support"),
    ("AI for medicine: vaccine diagnosis breakthrough", "clinical patient data, deep learning"),
    ("Quantum computing qubit record without any neural helper", "physics laboratory"),
    ("Local football team wins championship", "sports report"),
    ("Deprecated AI chemistry tool shutdown", "the AI service is discontinued"),
    ("Benchmark comparison of coding agents versus humans", "swe-bench evaluation"),
    ("ИИ открыл новый материал и предложил химический синтез", "нейросеть для материалов"),
]


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def now() -> Column:
    return ntz(NOW_TEXT)


def minutes(col: Column) -> Column:
    return F.make_dt_interval(mins=col.cast("int"))


def start_plus(col: Column) -> Column:
    return ntz(START_TEXT) + minutes(col)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _n_docs(spark: SparkSession, d: str) -> Column:
    return table(spark, d, "documents").agg(F.count("*")).scalar()


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def _cases(col: Column, mapping: dict[int, str], default: str | None) -> Column:
    out = F
    for k, v in mapping.items():
        out = out.when(col == k, F.lit(v))
    return out.otherwise(F.lit(default))


def _div(col: Column, n: int) -> Column:
    return F.floor(col / n).cast("bigint")


def news(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    i = F.col("doc_id")
    injected = i % 5 == 0
    phrase = _div(i, 5) % 8
    first_line = F.trim(F.split_part(F.col("text"), F.lit("\n"), F.lit(1)))
    plain = F.col("text")
    status = _cases(i % 7, {0: "pending", 1: "summarized", 2: "translated", 3: "rejected"}, "published")
    base = i * 4337 % 43200
    category_id = i % 8 + 1
    science = i % 3 == 1
    return docs.select(
        i.alias("id"),
        F.when(injected, _pick([p[0] for p in PHRASES], phrase)).otherwise(first_line).alias("title"),
        F.when(injected, _pick([p[1] for p in PHRASES], phrase)).otherwise(plain).alias("description"),
        F.when(i % 10 == 0, "").when(i % 11 == 0, None).otherwise(plain).alias("summary"),
        F.when(status.isin("pending"), None).otherwise(F.col("text")).alias("content"),
        F.when(i % 6 != 0, F.col("text")).alias("original_content"),
        F.when(i % 7 == 2, F.concat(F.lit("tr "), F.col("lang"), F.lit(" "), F.col("source"))).alias("translation"),
        F.when(i % 9 == 0, F.concat(F.lit("Original "), first_line)).alias("original_title"),
        F.concat(
            F.lit("https://"), F.col("source"), F.lit(".example.com/"), F.col("lang"), F.lit("/"),
            (i % F.floor(_n_docs(spark, d) * 9 / 10)).cast("string"),
        ).alias("original_url"),
        F.col("source"),
        F.when(i % 17 != 0, F.col("lang")).alias("language"),
        _cases(i % 3, {0: "ai-news", 1: "science"}, "invention-tools").alias("section"),
        status.alias("status"),
        F.when(i % 13 != 0, (i * 31 % 101).cast("int")).alias("score"),
        category_id.alias("category_id"),
        _pick([c[1] for c in rules.CATEGORIES[:8]], category_id - 1).alias("category_slug"),
        science.alias("is_science"),
        F.when(science, _pick(list(rules.SCIENCE_FIELD_KEYWORDS), i % 6)).alias("science_field"),
        F.when(science, _pick(list(rules.CLASSIFICATION_TYPE_KEYWORDS), i % 4)).alias("classification_type"),
        start_plus(base).alias("published_at"),
        start_plus(base + 30).alias("created_at"),
        start_plus(base + 90).alias("updated_at"),
        F.when(i % 4 != 0, start_plus(base + 60)).alias("platform_published_at"),
        F.when(
            i % 6 != 5,
            F.concat(
                F.lit('{"decision":"'),
                F.when(i % 2 == 0, F.lit("rejected-daily-cap")).otherwise(F.lit("rejected-low-score")),
                F.lit('","hnPoints":'), (i % 50).cast("string"), F.lit("}"),
            ),
        ).alias("metrics"),
        F.when(i % 3 == 2, F.split(F.concat_ws(",", _pick([s[1] for s in rules.SPHERES], i % 12),
                                             _pick([s[1] for s in rules.SPHERES], i % 5)), ","))
        .otherwise(F.array().cast("array<string>")).alias("sphere_tags"),
        F.when(i % 8 != 0, F.concat(F.lit("ai, "), F.col("lang"), F.lit(",,"), F.col("source"))).alias("tags"),
    )


def news_id(spark: SparkSession, d: str) -> Column:
    return F.col("event_id") * 7 % _n_docs(spark, d)


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def read_status(spark: SparkSession, d: str) -> DataFrame:
    return (
        events(spark, d)
        .filter(F.col("event_type").isin("view", "click"))
        .groupBy("user_id", news_id(spark, d).alias("news_id"))
        .agg(F.max(F.col("event_type") == "view").alias("read"), F.max("ts").alias("read_at"))
    )


def favorites(spark: SparkSession, d: str) -> DataFrame:
    return (
        events(spark, d)
        .filter(F.col("event_type") == "purchase")
        .groupBy("user_id", news_id(spark, d).alias("news_id"))
        .agg(F.min("ts").alias("created_at"))
    )


def users(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("c_custkey")
    return table(spark, d, "customer").select(
        i.alias("id"),
        F.col("c_name").alias("name"),
        F.concat(F.lower(F.col("c_mktsegment")), F.lit("."), i.cast("string"), F.lit("@example.com")).alias("email"),
        F.when(F.col("c_nationkey") == 0, "admin").otherwise("user").alias("role"),
        start_plus(i * 13 % 43200).alias("created_at"),
        F.lit("x").alias("password_hash"),
        F.lit(1).alias("token_version"),
    )


def sources(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("s_suppkey")
    kind = _pick(["rss", "html", "api", "google_news"], F.col("s_nationkey") % 4)
    url = F.concat(F.lit("https://feed"), i.cast("string"), F.lit(".example.com/"))
    return table(spark, d, "supplier").select(
        i.alias("id"), F.col("s_name").alias("name"), url.alias("url"), kind.alias("type"),
        (F.col("s_acctbal") >= 0).alias("enabled"),
    )


def checks(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_type")
    return events(spark, d).select(
        F.col("user_id").alias("source_id"), "event_id", "ts",
        (e != "error").alias("accessible"),
        (~e.isin("error", "signup")).alias("selector_works"),
        F.col("value").alias("response_ms"),
        F.when(e == "error", F.concat(F.lit("HTTP "), (F.col("event_id") % 3 + 500).cast("string"))).alias("error"),
    )


def failures(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("user_id")
    return events(spark, d).filter(F.col("event_type") == "error").select(
        news_id(spark, d).alias("article_id"),
        _cases(u % 3, {0: "fetch", 1: "extract"}, "zen").alias("stage"),
        F.when(u % 10 == 0, "youtube-transcript-unavailable").otherwise("content-unavailable").alias("reason"),
        (u % 10 == 0).alias("is_youtube"),
        "ts", "event_id",
    )


def hits(spark: SparkSession, d: str) -> DataFrame:
    """Social hits: two of three carry the article's URL, the others only a title."""
    n = news(spark, d).select("id", "original_url", "title")
    return (
        events(spark, d).filter(F.col("event_type") == "click")
        .select("event_id", news_id(spark, d).alias("id"), F.col("value").cast("int").alias("points"), "ts")
        .join(n, "id")
        .select(
            "event_id",
            F.when(F.col("event_id") % 3 != 0, F.col("original_url")).alias("url"),
            F.when(F.col("event_id") % 4 != 0, F.col("title")).alias("title"),
            F.when(F.col("event_id") % 5 == 0, F.col("title")).alias("story_title"),
            (F.col("points") * 20).alias("points"),
            "ts",
        )
    )


def probes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 7
    return events(spark, d).filter(F.col("event_type") == "signup").select(
        news_id(spark, d).alias("news_id"), "ts", "event_id",
        F.when(k == 0, 404).when(k == 1, 410).when(k == 2, 403).when(k == 3, 503).when(k == 4, None).otherwise(200).alias("http_status"),
        (k == 4).alias("dns_error"),
    )


def parsing_logs(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value").cast("int")
    bad = F.col("event_type") == "error"
    return events(spark, d).select(
        F.col("event_id").alias("id"), F.col("user_id").alias("source_id"),
        F.when(bad, "failed").otherwise("completed").alias("status"),
        F.when(bad, 0).otherwise(v).alias("articles_found"),
        F.when(bad, 0).otherwise(F.floor(v / 3)).cast("int").alias("articles_new"),
        F.when(bad, F.concat(F.lit("HTTP "), (F.col("event_id") % 3 + 500).cast("string"))).alias("error_message"),
        F.col("ts").alias("created_at"),
    )


def stage_events(spark: SparkSession, d: str) -> DataFrame:
    """Progress reports of processing cycles (one cycle per order, one report per line)."""
    s = F.col("l_linenumber")
    q = F.col("l_quantity").cast("int")
    return table(spark, d, "lineitem").groupBy(
        F.concat(F.lit("cycle-"), F.col("l_orderkey").cast("string")).alias("cycle_id"), s.alias("seq")
    ).agg(
        F.max(_pick(["parse", "summarize", "translate", "deploy"], s % 4)).alias("stage"),
        F.max(q * 2).alias("total"), F.max(q).alias("processed"),
        F.max("l_shipdate").alias("ts"),
        F.max(F.when(F.col("l_returnflag") == "R", F.concat(F.lit("stage "), s.cast("string"), F.lit(" failed")))).alias("error"),
    )


def tools(spark: SparkSession, d: str) -> DataFrame:
    """Tool catalogue derived from the part table; some rows break catalogue rules."""
    i = F.col("p_partkey")
    slugs = [s[0] for s in rules.SPHERES]
    return table(spark, d, "part").select(
        i.alias("id"),
        F.when(i % 37 == 0, "").otherwise(F.concat(F.regexp_replace(F.col("p_name"), " ", "-"), F.lit("-"), i.cast("string"))).alias("slug"),
        F.when(i % 41 == 0, "  ").otherwise(F.concat(F.col("p_name"), F.lit(" "), i.cast("string"))).alias("name"),
        F.lower(F.col("p_type")).alias("kind"),
        F.when(i % 43 == 0, F.array().cast("array<string>"))
        .otherwise(F.array(_pick(slugs, i % 12), _pick(slugs, F.col("p_size") % 12))).alias("spheres"),
        F.when(i % 47 == 0, "").otherwise(F.concat(F.lit("Made by "), F.col("p_brand"))).alias("description"),
        F.when(i % 53 == 0, F.lit("ftp://x.example.com")).otherwise(
            F.concat(F.lit("https://tool"), i.cast("string"), F.lit(".example.com/"))).alias("official_url"),
        start_plus(i * 29 % 43200).alias("created_at"),
        start_plus(i * 29 % 43200 + 500).alias("updated_at"),
        F.when(i % 3 != 0, start_plus(i * 29 % 43200 + 700)).alias("last_verified_at"),
    )


def repos(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("p_partkey")
    return table(spark, d, "part").select(
        F.concat(F.lit("org"), (i % 50).cast("string"), F.lit("/repo"), i.cast("string")).alias("full_name"),
        F.when(i % 6 != 0, F.concat(F.col("p_name"), F.lit(" rag toolkit"))).alias("description"),
        (F.col("p_size") * F.col("p_size") * 13).cast("int").alias("stars"),
        F.when(i % 3 == 0, "MIT").when(i % 3 == 1, "GPL-3.0").alias("license"),
        start_plus(i * 97 % 43200).alias("created_at"),
        F.array(F.lit("llm"), F.lower(F.col("p_type"))).alias("topics"),
    )


def doi_scores(spark: SparkSession, d: str) -> DataFrame:
    """Attention scores by DOI, one row per embedding row."""
    return table(spark, d, "embeddings").select(
        F.concat(F.lit("10.1234/item."), F.col("vec_id").cast("string")).alias("doi"),
        (F.col("vec_id") % 120 + 0.5).alias("score"),
    )


def feed_items(spark: SparkSession, d: str) -> DataFrame:
    """Landed feed rows, one per document; position is the place inside its feed."""
    i = F.col("id")
    n = news(spark, d)
    return n.select(
        i.alias("item_id"), "source", i.alias("position"),
        F.when(i % 29 == 0, "  ").otherwise(F.concat(F.lit("  "), F.col("title"), F.lit("\n"))).alias("title"),
        F.when(i % 31 == 0, None).when(i % 23 == 0, F.lit("ftp://x.example.com/"))
        .otherwise(F.concat(F.lit(" "), F.col("original_url"))).alias("link"),
        F.when(i % 19 != 0, F.col("published_at")).alias("iso_date"),
        F.when(i % 6 != 0, F.col("description")).alias("description"),
        F.coalesce(F.col("language"), F.lit("en")).alias("language"),
        (i % 2 == 0).alias("is_science"),
    )


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Landed pages with outbound links and DOIs added inside the article body."""
    i = F.col("page_id")
    s = i.cast("string")
    extra = F.concat(
        F.lit('<p><a href="https://github.com/org'), (i % 50).cast("string"), F.lit("/repo"), s,
        F.lit('">code</a> <a href="https://zenodo.org/record/'), (i % 3).cast("string"),
        F.lit('">data</a> DOI 10.1234/item.'), s, F.lit(". (see 10.1234/item."), (i % 7).cast("string"),
        F.lit(')</p></article>'),
    )
    base = table(spark, d, "pages")
    html = F.when(i % 3 == 2, F.col("html")).otherwise(F.replace(F.col("html"), F.lit("</article>"), extra))
    return base.select("page_id", "url", html.alias("html"))


# ---------------------------------------------------------------------------
# DuckDB twins of the functions above

_START = f"timestamp '{START_TEXT}'"


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_PHRASE_TITLES = _sql_list([p[0] for p in PHRASES])
_PHRASE_DESCS = _sql_list([p[1] for p in PHRASES])
_SPHERE_LABELS = _sql_list([s[1] for s in rules.SPHERES])
_SPHERE_SLUGS = _sql_list([s[0] for s in rules.SPHERES])
_FIELDS = _sql_list(list(rules.SCIENCE_FIELD_KEYWORDS))
_TYPES = _sql_list(list(rules.CLASSIFICATION_TYPE_KEYWORDS))
_CAT_SLUGS = _sql_list([c[1] for c in rules.CATEGORIES[:8]])

DUCK: dict[str, str] = {
    "params_fx": f"select timestamp '{NOW_TEXT}' as now_ts, (select count(*) from documents) as n_docs",
    "categories_fx": "select * from (values "
    + ", ".join(f"({k + 1}, '{n}', '{s}', '{t}')" for k, (n, s, t) in enumerate(rules.CATEGORIES))
    + ") t(id, name, slug, type)",
    "doc_lines_fx": "select *, trim(split_part(text, chr(10), 1)) as first_line, text as plain from documents",
    "news_fx": f"""select d.doc_id as id,
 case when d.doc_id % 5 = 0 then {_PHRASE_TITLES}[d.doc_id // 5 % 8 + 1] else first_line end as title,
 case when d.doc_id % 5 = 0 then {_PHRASE_DESCS}[d.doc_id // 5 % 8 + 1] else plain end as description,
 case when d.doc_id % 10 = 0 then '' when d.doc_id % 11 = 0 then null else plain end as summary,
 case when d.doc_id % 7 = 0 then null else d.text end as content,
 case when d.doc_id % 6 <> 0 then d.text end as original_content,
 case when d.doc_id % 7 = 2 then 'tr ' || d.lang || ' ' || d.source end as translation,
 case when d.doc_id % 9 = 0 then 'Original ' || first_line end as original_title,
 'https://' || d.source || '.example.com/' || d.lang || '/' || cast(d.doc_id % (n_docs * 9 // 10) as varchar) as original_url,
 d.source as source,
 case when d.doc_id % 17 <> 0 then d.lang end as language,
 case d.doc_id % 3 when 0 then 'ai-news' when 1 then 'science' else 'invention-tools' end as section,
 case d.doc_id % 7 when 0 then 'pending' when 1 then 'summarized' when 2 then 'translated' when 3 then 'rejected' else 'published' end as status,
 case when d.doc_id % 13 <> 0 then cast(d.doc_id * 31 % 101 as int) end as score,
 d.doc_id % 8 + 1 as category_id,
 {_CAT_SLUGS}[d.doc_id % 8 + 1] as category_slug,
 d.doc_id % 3 = 1 as is_science,
 case when d.doc_id % 3 = 1 then {_FIELDS}[d.doc_id % 6 + 1] end as science_field,
 case when d.doc_id % 3 = 1 then {_TYPES}[d.doc_id % 4 + 1] end as classification_type,
 {_START} + interval '1' minute * (d.doc_id * 4337 % 43200) as published_at,
 {_START} + interval '1' minute * (d.doc_id * 4337 % 43200 + 30) as created_at,
 {_START} + interval '1' minute * (d.doc_id * 4337 % 43200 + 90) as updated_at,
 case when d.doc_id % 4 <> 0 then {_START} + interval '1' minute * (d.doc_id * 4337 % 43200 + 60) end as platform_published_at,
 case when d.doc_id % 6 <> 5 then '{{"decision":"' || case when d.doc_id % 2 = 0 then 'rejected-daily-cap' else 'rejected-low-score' end
   || '","hnPoints":' || cast(d.doc_id % 50 as varchar) || '}}' end as metrics,
 case when d.doc_id % 3 = 2 then [{_SPHERE_LABELS}[d.doc_id % 12 + 1], {_SPHERE_LABELS}[d.doc_id % 5 + 1]] else []::varchar[] end as sphere_tags,
 case when d.doc_id % 8 <> 0 then 'ai, ' || d.lang || ',,' || d.source end as tags
from doc_lines_fx d, params_fx""",
    "read_status_fx": """select user_id, event_id * 7 % n_docs as news_id, max(event_type = 'view') as read, max(ts) as read_at
from events, params_fx where event_type in ('view','click') group by 1, 2""",
    "favorites_fx": """select user_id, event_id * 7 % n_docs as news_id, min(ts) as created_at
from events, params_fx where event_type = 'purchase' group by 1, 2""",
    "users_fx": f"""select c_custkey as id, c_name as name, lower(c_mktsegment) || '.' || c_custkey || '@example.com' as email,
 case when c_nationkey = 0 then 'admin' else 'user' end as role,
 {_START} + interval '1' minute * (c_custkey * 13 % 43200) as created_at from customer""",
    "sources_fx": """select s_suppkey as id, s_name as name, 'https://feed' || s_suppkey || '.example.com/' as url,
 ['rss','html','api','google_news'][s_nationkey % 4 + 1] as type, s_acctbal >= 0 as enabled from supplier""",
    "checks_fx": """select user_id as source_id, event_id, ts, event_type <> 'error' as accessible,
 event_type not in ('error','signup') as selector_works, value as response_ms,
 case when event_type = 'error' then 'HTTP ' || (event_id % 3 + 500) end as error from events""",
    "failures_fx": """select event_id * 7 % n_docs as article_id,
 case user_id % 3 when 0 then 'fetch' when 1 then 'extract' else 'zen' end as stage,
 case when user_id % 10 = 0 then 'youtube-transcript-unavailable' else 'content-unavailable' end as reason,
 user_id % 10 = 0 as is_youtube, ts, event_id from events, params_fx where event_type = 'error'""",
    "hits_fx": """select event_id, case when event_id % 3 <> 0 then n.original_url end as url,
 case when event_id % 4 <> 0 then n.title end as title, case when event_id % 5 = 0 then n.title end as story_title,
 cast(trunc(value) as int) * 20 as points, ts
from events, params_fx, news_fx n where event_type = 'click' and n.id = event_id * 7 % n_docs""",
    "probes_fx": """select event_id * 7 % n_docs as news_id, ts, event_id,
 case event_id % 7 when 0 then 404 when 1 then 410 when 2 then 403 when 3 then 503 when 4 then null else 200 end as http_status,
 event_id % 7 = 4 as dns_error from events, params_fx where event_type = 'signup'""",
    "parsing_logs_fx": """select event_id as id, user_id as source_id,
 case when event_type = 'error' then 'failed' else 'completed' end as status,
 case when event_type = 'error' then 0 else cast(trunc(value) as int) end as articles_found,
 case when event_type = 'error' then 0 else cast(trunc(value) as int) // 3 end as articles_new,
 case when event_type = 'error' then 'HTTP ' || (event_id % 3 + 500) end as error_message, ts as created_at from events""",
    "stage_events_fx": """select 'cycle-' || l_orderkey as cycle_id, l_linenumber as seq,
 max(['parse','summarize','translate','deploy'][l_linenumber % 4 + 1]) as stage,
 max(cast(trunc(l_quantity) as int) * 2) as total, max(cast(trunc(l_quantity) as int)) as processed, max(l_shipdate) as ts,
 max(case when l_returnflag = 'R' then 'stage ' || l_linenumber || ' failed' end) as error
from lineitem group by 1, 2""",
    "tools_fx": f"""select p_partkey as id,
 case when p_partkey % 37 = 0 then '' else replace(p_name, ' ', '-') || '-' || p_partkey end as slug,
 case when p_partkey % 41 = 0 then '  ' else p_name || ' ' || p_partkey end as name, lower(p_type) as kind,
 case when p_partkey % 43 = 0 then []::varchar[] else [{_SPHERE_SLUGS}[p_partkey % 12 + 1], {_SPHERE_SLUGS}[p_size % 12 + 1]] end as spheres,
 case when p_partkey % 47 = 0 then '' else 'Made by ' || p_brand end as description,
 case when p_partkey % 53 = 0 then 'ftp://x.example.com' else 'https://tool' || p_partkey || '.example.com/' end as official_url,
 {_START} + interval '1' minute * (p_partkey * 29 % 43200) as created_at,
 {_START} + interval '1' minute * (p_partkey * 29 % 43200 + 500) as updated_at,
 case when p_partkey % 3 <> 0 then {_START} + interval '1' minute * (p_partkey * 29 % 43200 + 700) end as last_verified_at
from part""",
    "repos_fx": f"""select 'org' || (p_partkey % 50) || '/repo' || p_partkey as full_name,
 case when p_partkey % 6 <> 0 then p_name || ' rag toolkit' end as description,
 cast(p_size * p_size * 13 as int) as stars,
 case p_partkey % 3 when 0 then 'MIT' when 1 then 'GPL-3.0' end as license,
 {_START} + interval '1' minute * (p_partkey * 97 % 43200) as created_at, ['llm', lower(p_type)] as topics from part""",
    "doi_scores_fx": "select '10.1234/item.' || vec_id as doi, vec_id % 120 + 0.5 as score from embeddings",
    "feed_fx": """select id as item_id, source, id as position,
 case when id % 29 = 0 then '  ' else '  ' || title || chr(10) end as title,
 case when id % 31 = 0 then null when id % 23 = 0 then 'ftp://x.example.com/' else ' ' || original_url end as link,
 case when id % 19 <> 0 then published_at end as iso_date,
 case when id % 6 <> 0 then description end as description, coalesce(language, 'en') as language,
 id % 2 = 0 as is_science from news_fx""",
    "pages_fx": """select page_id, url, case when page_id % 3 = 2 then html else replace(html, '</article>',
 '<p><a href="https://github.com/org' || (page_id % 50) || '/repo' || page_id || '">code</a> <a href="https://zenodo.org/record/'
 || (page_id % 3) || '">data</a> DOI 10.1234/item.' || page_id || '. (see 10.1234/item.' || (page_id % 7) || ')</p></article>') end as html
from pages""",
}
