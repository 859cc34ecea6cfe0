"""Registered scalar, classification and model-batch queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsmill import rules
from newsmill.functions import classify as C, text as T, urls as U
from newsmill.operators import prompts as P
from newsmill.plans import fixtures as X, sqltext as S
from newsmill.plans.registry import query

c = F.col


@query("normalize_title", f"select id, {S.norm_title('title')} as title_key from news_fx")
def normalize_title(spark, d):
    return X.news(spark, d).select("id", T.normalize_title(c("title")).alias("title_key"))


_A = r"lower(trim(regexp_replace(title, '[^\x20-\x7E]', '', 'g')))"
_B = r"lower(trim(regexp_replace(coalesce(original_title, ''), '[^\x20-\x7E]', '', 'g')))"


@query("title_similarity", f"""select id, case when greatest(length({_A}), length({_B})) = 0 then 1.0
 else round(1 - levenshtein({_A}, {_B}) / greatest(length({_A}), length({_B})), 6) end as similarity from news_fx""")
def title_similarity(spark, d):
    a = F.lower(F.trim(T.ascii_only(c("title"))))
    b = F.lower(F.trim(T.ascii_only(T.or_empty(c("original_title")))))
    return X.news(spark, d).select("id", F.round(T.title_similarity(a, b), 6).alias("similarity"))


@query("title_similarity_whole")
def title_similarity_whole(spark, d):
    """As title_similarity, over all letters; SQL's edit distance would count bytes, so a test compares it with brute force."""
    a, b = F.lower(T.trim_ws(c("title"))), F.lower(T.trim_ws(T.or_empty(c("original_title"))))
    return X.news(spark, d).select("id", F.round(T.title_similarity(a, b), 6).alias("similarity"))


@query("normalize_url", f"select page_id, {S.norm_url('url')} as url_key from pages")
def normalize_url(spark, d):
    return X.table(spark, d, "pages").select("page_id", U.normalize_url(c("url")).alias("url_key"))


_DOI_URL = """case page_id % 4 when 0 then url || '/doi/10.1234/Item.' || page_id || ').' when 1 then 'https://www.nature.com/articles/s41586-024-' || page_id
 when 2 then 'https://nature.com/articles/d41586-' || page_id else url end"""


def _doi_url():
    s = c("page_id").cast("string")
    k = c("page_id") % 4
    return (
        F.when(k == 0, F.concat(c("url"), F.lit("/doi/10.1234/Item."), s, F.lit(").")))
        .when(k == 1, F.concat(F.lit("https://www.nature.com/articles/s41586-024-"), s))
        .when(k == 2, F.concat(F.lit("https://nature.com/articles/d41586-"), s))
        .otherwise(c("url"))
    )


_DOI_RX = "'(?i)" + rules.DOI_PATTERN + "'"


@query("extract_doi", f"""with p as (select page_id, {_DOI_URL} as u from pages) select page_id, u as url, coalesce(
 nullif(regexp_replace(regexp_extract(u, {_DOI_RX}), '[.)]+$', ''), ''),
 case when regexp_matches(u, '(?i)\\bnature\\.com/') and regexp_matches(regexp_extract(u, '/articles/([A-Za-z0-9-]+)', 1), '^s[0-9]{{5}}-')
 then '10.1038/' || regexp_extract(u, '/articles/([A-Za-z0-9-]+)', 1) end) as doi from p""")
def extract_doi(spark, d):
    return X.table(spark, d, "pages").select("page_id", _doi_url().alias("url")).withColumn("doi", U.extract_doi(c("url")))


@query("github_repo", """with r as (select p_partkey as id, case p_partkey % 4 when 0 then 'https://github.com/topics/' || replace(p_name, ' ', '-')
 when 1 then 'https://gitlab.com/a/b' || p_partkey else 'https://github.com/org' || (p_partkey % 50) || '/repo' || p_partkey || '/issues' end as url from part)
select id, case when regexp_extract(url, 'github\\.com/([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+)', 1) not in ('', 'topics', 'trending', 'collections', 'features')
 then regexp_extract(url, 'github\\.com/([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)', 1) end as repo from r""")
def github_repo(spark, d):
    i = c("p_partkey")
    url = (
        F.when(i % 4 == 0, F.concat(F.lit("https://github.com/topics/"), F.regexp_replace("p_name", " ", "-")))
        .when(i % 4 == 1, F.concat(F.lit("https://gitlab.com/a/b"), i.cast("string")))
        .otherwise(F.concat(F.lit("https://github.com/org"), (i % 50).cast("string"), F.lit("/repo"), i.cast("string"), F.lit("/issues")))
    )
    return X.table(spark, d, "part").select(i.alias("id"), U.github_repo(url).alias("repo"))


_YT = ["https://www.youtube.com/watch?v=", "https://youtu.be/", "https://youtube.com/shorts/", "https://www.youtube.com/watchlist", "https://example.com/"]


@query("is_youtube_url", f"""with u as (select event_id, {X._sql_list(_YT)}[event_id % 5 + 1] || event_id as url from events)
select event_id, regexp_matches(url, '(?i)(youtube\\.com/(watch|shorts)([/?#]|$)|youtu\\.be/)') as is_youtube from u""")
def is_youtube_url(spark, d):
    url = F.concat(X._pick(_YT, c("event_id") % 5), c("event_id").cast("string"))
    return X.events(spark, d).select("event_id", U.is_youtube_url(url).alias("is_youtube"))


# URL shapes; "{n}" is a number derived from the row
_URL_SHAPES = [
    "http://127.0.0.1:3000/{n}", "http://10.{n}.0.5/", "http://172.{n}.0.1/x", "http://192.168.1.{n}/", "http://169.254.{n}.254/latest",
    "http://100.{n}.0.1/", "http://213070{n}/", "http://127.{n}/", "http://0x7f0000{n}/", "http://0177.0.0.{n}/", "http://8.8.8.{n}/dns",
    "http://[fd00::{n}]/", "http://[2001:db8::{n}]/", "http://foo{n}.local/", "http://localhost:{n}/", "ftp://example.com/{n}", "not-a-url-{n}",
    "https://localhost.evil-{n}.com/", "https://github.com/org/{n}", "http:///{n}",
]


def _shape_sql():
    arms = " ".join(f"when {k} then '" + u.replace("{n}", "' || (event_id % 300) || '") + "'" for k, u in enumerate(_URL_SHAPES))
    return f"case event_id % {len(_URL_SHAPES)} {arms} end"


@query("url_safety", f"""with u as (select event_id, {_shape_sql()} as url from events),
h as (select *, lower(regexp_extract(url, '(?i)^([a-z][a-z0-9+.-]*:)', 1)) as scheme,
 lower(regexp_replace(regexp_extract(url, '(?i)^[a-z][a-z0-9+.-]*:[/]*([^/?#]*)', 1), ':[0-9]*$', '')) as host from u),
p as (select *, host like '[%' as v6, not host like '[%' and regexp_matches(host, '(^|\\.)([0-9]+|0x[0-9a-f]*)$') as numeric_host,
 list_transform(string_split(host, '.'), lambda q: case
  when regexp_matches(q, '^0x[0-9a-f]+$') then list_reduce(list_transform(string_split(substr(q, 3), ''), lambda ch: cast(strpos('0123456789abcdef', ch) - 1 as bigint)), lambda a, b: a * 16 + b)
  when regexp_matches(q, '^0[0-7]+$') then list_reduce(list_transform(string_split(q, ''), lambda ch: cast(strpos('01234567', ch) - 1 as bigint)), lambda a, b: a * 8 + b)
  when regexp_matches(q, '^[0-9]+$') then cast(q as bigint) end) as nums from h),
v as (select *, case when numeric_host and len(nums) <= 4 and len(list_filter(nums, lambda x: x is null)) = 0
  and len(list_filter(nums[1:len(nums) - 1], lambda x: x > 255)) = 0 and nums[len(nums)] < pow(256, 5 - len(nums))
  then cast(coalesce(list_sum(list_transform(nums[1:len(nums) - 1], lambda x, k: x * cast(pow(256, 4 - k) as bigint))), 0) + nums[len(nums)] as bigint) end as ip from p),
o as (select *, ip // 16777216 as a, ip // 65536 % 256 as b from v)
select event_id, url, case when scheme = '' then 'invalid URL' when scheme not in ('http:', 'https:') then 'scheme not allowed: ' || scheme
 when host = '' or (numeric_host and ip is null) then 'invalid URL'
 when host in ('localhost', 'localhost.localdomain') or regexp_matches(host, '\\.(localhost|internal|local|lan)$')
  or (v6 and (host in ('[::]', '[::1]') or regexp_matches(host, '^\\[(fe80:|fc|fd)')))
  or (numeric_host and (a in (0, 10, 127) or (a = 172 and b between 16 and 31) or (a = 192 and b = 168) or (a = 169 and b = 254) or (a = 100 and b between 64 and 127)))
 then 'private/internal host blocked: ' || case when numeric_host then a || '.' || b || '.' || (ip // 256 % 256) || '.' || (ip % 256) else host end end as reason from o""")
def url_safety(spark, d):
    shapes = F.array(*[F.lit(u) for u in _URL_SHAPES])
    shape = F.element_at(shapes, (c("event_id") % len(_URL_SHAPES)).cast("int") + 1)
    url = F.replace(shape, F.lit("{n}"), (c("event_id") % 300).cast("string"))
    return U.with_url_safety(X.events(spark, d).select("event_id", url.alias("url")), "url", "reason")


@query("topic_filter", f"""select id, title from news_fx
where {S.contains_any("lower(coalesce(title, ''))", rules.AI_TOPIC_KEYWORDS)} or {S.contains_any("lower(coalesce(description, ''))", rules.AI_TOPIC_KEYWORDS)}""")
def topic_filter(spark, d):
    return X.news(spark, d).filter(C.is_ai_topic(c("title"), c("description"))).select("id", "title")


@query("classify_article", f"""with t as (select id, lower(coalesce(title, '') || ' ' || coalesce(description, '')) as t from news_fx)
select id, {S.article_class('t')} from t""")
def classify_article(spark, d):
    rows = X.news(spark, d).select("id", C.article_text(c("title"), c("description")).alias("t"))
    return rows.select("id", *[v.alias(k) for k, v in C.classify_article(c("t")).items()])


@query("classify_invention", f"""with t as (select id, {S.trim("title || ' ' || description")} as t, is_science from news_fx)
select id, {S.invention('t')} as is_invention, array_to_string({S.spheres('t')}, ',') as spheres,
 case when {S.invention('t')} then 'invention-tools' when is_science then 'science' else 'ai-news' end as section from t""")
def classify_invention(spark, d):
    text = T.trim_ws(F.concat(c("title"), F.lit(" "), c("description")))
    rows = X.news(spark, d).select("id", "is_science", F.lower(text).alias("t")).withColumn("is_invention", C.is_invention(c("t")))
    return rows.select(
        "id", "is_invention", F.array_join(C.sphere_tags(c("t")), ",").alias("spheres"),
        C.section_of(c("is_invention"), c("is_science")).alias("section"),
    )


@query("invention_context", f"select id, {S.context('title', 'description', 'summary')} as context from news_fx")
def invention_context(spark, d):
    return X.news(spark, d).select("id", C.invention_context(c("title"), c("description"), c("summary")).alias("context"))


_TXT = "coalesce(title, '') || ' ' || coalesce(summary, '')"


@query("keyword_argmax", f"""with t as (select id, {_TXT} as t from news_fx) select id, {S.argmax('t', rules.SCIENCE_RULES, 'engineering')} as slug,
 cast(list_max([{', '.join(f"len(regexp_extract_all(t, {S.pat(p)}))" for _, p in rules.SCIENCE_RULES)}]) as int) as best from t""")
def keyword_argmax(spark, d):
    rows = _science_counts(X.news(spark, d))
    return rows.select(
        "id", C.keyword_argmax(c("counts"), rules.SCIENCE_RULES, rules.SCIENCE_DEFAULT).alias("slug"),
        F.array_max("counts").alias("best"),
    )


def _science_counts(news, table=rules.SCIENCE_RULES):
    rows = news.withColumn("_t", C.article_text(c("title"), c("summary")))
    return rows.withColumn("counts", C.keyword_counts(c("_t"), table))


_SRC = ["lancet", "cell", "arxiv", "nature", "src"]
_FLD = ["computer-science", "multidisciplinary", "medicine", "unknown"]


@query("classify_science", f"""with t as (select id, {_TXT} as t, {X._sql_list(_SRC)}[id % 5 + 1] as src, {X._sql_list(_FLD)}[id // 5 % 4 + 1] as fld from news_fx)
select id, case src when 'lancet' then 'medicine' when 'cell' then 'biology' when 'arxiv' then 'engineering' else
 case fld when 'computer-science' then 'engineering' when 'medicine' then 'medicine' else {S.argmax('t', rules.SCIENCE_RULES, 'engineering')} end end as slug from t""")
def classify_science(spark, d):
    src, fld = X._pick(_SRC, c("id") % 5), X._pick(_FLD, X._div(c("id"), 5) % 4)
    return _science_counts(X.news(spark, d)).select("id", C.classify_science(c("counts"), src, fld).alias("slug"))


@query("classify_tech_category", f"with t as (select id, {_TXT} as t from news_fx) select id, {S.argmax('t', rules.TECH_RULES, 'frameworks')} as slug from t")
def classify_tech_category(spark, d):
    rows = _science_counts(X.news(spark, d), rules.TECH_RULES)
    return rows.select("id", C.keyword_argmax(c("counts"), rules.TECH_RULES, rules.TECH_DEFAULT).alias("slug"))


@query("clean_text", f"""with l as (select doc_id, list_filter(list_transform(regexp_split_to_array({S.boilerplate('text')}, '\\n+'), lambda x: {S.trim('x')}), lambda x: x <> '') as lines from documents)
select doc_id, {S.collapse("array_to_string(list_filter(lines, lambda x, i: list_position(lines, x) = i), ' ')")} as cleaned from l""")
def clean_text(spark, d):
    return X.table(spark, d, "documents").select("doc_id", T.clean_text(c("text")).alias("cleaned"))


@query("garbage_text", f"""with t as (select doc_id as id, text as t from documents), g as ({S.garbage_sentences('t')})
select t.id as doc_id, length({S.trim('t.t')}) < 40 or g.id is not null as garbage, length({S.trim('t.t')}) < 40 as unusable_transcript from t left join g on g.id = t.id""")
def garbage_text(spark, d):
    return X.table(spark, d, "documents").select(
        "doc_id", T.is_garbage(c("text")).alias("garbage"),
        T.is_unusable(c("text"), F.lit("youtube-transcript")).alias("unusable_transcript"),
    )


@query("tags_list", "select id, array_to_string(list_filter(string_split(coalesce(tags, ''), ','), lambda x: x <> ''), '|') as tags from news_fx")
def tags_list(spark, d):
    return X.news(spark, d).select("id", F.array_join(T.tags_list(c("tags")), "|").alias("tags"))


@query("append_tag", """with t as (select id, list_filter(list_transform(string_split(coalesce(tags, ''), ','), lambda x: trim(x)), lambda x: x <> '') as t from news_fx)
select id, array_to_string(case when list_contains(t, 'src3') then t else list_append(t, 'src3') end, ',') as tags from t""")
def append_tag(spark, d):
    return X.news(spark, d).select("id", T.append_tag(c("tags"), "src3").alias("tags"))


@query("metrics_get", "select id, metrics->>'$.decision' as decision, metrics->>'$.hnPoints' as hn_points, metrics->>'$.none' as missing from news_fx")
def metrics_get(spark, d):
    m = c("metrics")
    return X.news(spark, d).select(
        "id", T.metrics_get(m, "decision").alias("decision"), T.metrics_get(m, "hnPoints").alias("hn_points"),
        T.metrics_get(m, "none").alias("missing"),
    )


@query("metrics_merge", """with m as (select id, json_merge_patch(coalesce(metrics, '{}')::json, ('{"decision":"approved","score":' || coalesce(score, 0) || '}')::json) as m from news_fx)
select id, m->>'$.decision' as decision, m->>'$.hnPoints' as hn_points, m->>'$.score' as score from m""")
def metrics_merge(spark, d):
    patch = F.concat(F.lit('{"decision":"approved","score":'), F.coalesce("score", F.lit(0)).cast("string"), F.lit("}"))
    m = X.news(spark, d).select("id", T.metrics_merge(c("metrics"), patch).alias("m"))
    return m.select(
        "id", T.metrics_get(c("m"), "decision").alias("decision"), T.metrics_get(c("m"), "hnPoints").alias("hn_points"),
        T.metrics_get(c("m"), "score").alias("score"),
    )


@query("clip", "select id, substr(description, 1, 500) as short_description, substr(description, 1, 2000) as transcript_description from news_fx")
def clip(spark, d):
    return X.news(spark, d).select(
        "id", T.clip(c("description"), 500).alias("short_description"), T.clip(c("description"), 2000).alias("transcript_description"))


@query("llm_requests", """with q as (select *, coalesce(original_content, '') as body, cast(greatest(1, ceil(length(coalesce(original_content, '')) / 24000)) as int) as n_chunks
 from news_fx where status = 'pending' and score >= 66), k as (select *, cast(unnest(generate_series(1, n_chunks)) as int) as chunk_no from q)
select id, chunk_no, n_chunks, 'Название: ' || title || chr(10) || 'Источник: ' || source || chr(10) || chr(10) || '--- BEGIN ARTICLE (UNTRUSTED) ---' || chr(10)
 || substr(body, (chunk_no - 1) * 24000 + 1, 24000) || chr(10) || '--- END ARTICLE ---' as prompt from k""")
def llm_requests(spark, d):
    queue = X.news(spark, d).filter((c("status") == "pending") & (c("score") >= rules.MANIFEST_MIN_SCORE))
    return P.prompt_requests(queue)


def responses(spark, d):
    """Raw model answers made from the assistant turns, whole; some are malformed."""
    text = c("text")
    k = (c("conv_id") + c("turn")) % 8
    good = F.to_json(F.struct(text.alias("title_ru"), F.concat(F.lit(" "), text).alias("summary")))
    raw = (
        F.when(k == 0, F.concat(F.lit("```json\n"), good, F.lit("\n```")))
        .when(k == 1, F.concat(F.lit("Here it is: "), good, F.lit(" done")))
        .when(k == 2, text)
        .when(k == 3, F.concat(F.lit('{"title_ru": "x", "summary": '), F.lit("} "), text))
        .when(k == 4, F.lit('{"x": {"title_ru": "s"}, "title_ru": 5, "summary": "y"}'))
        .when(k == 5, F.lit('{"title_ru": " ", "summary": "x"}'))
        .when(k == 6, F.to_json(F.struct(text.alias("summary"), F.lit("too short").alias("title_ru"))))
        .otherwise(good)
    )
    return X.table(spark, d, "conversations").filter(c("role") == "assistant").select("conv_id", "turn", raw.alias("raw"))


_RESP = r"""responses_raw as (select conv_id, turn, text as plain, (conv_id + turn) % 8 as k from conversations where role = 'assistant'),
responses_all as (select conv_id, turn, case k when 0 then '```json' || chr(10) || good || chr(10) || '```' when 1 then 'Here it is: ' || good || ' done' when 2 then plain
 when 3 then '{"title_ru": "x", "summary": } ' || plain when 4 then '{"x": {"title_ru": "s"}, "title_ru": 5, "summary": "y"}' when 5 then '{"title_ru": " ", "summary": "x"}'
 when 6 then json_object('summary', plain, 'title_ru', 'too short')::varchar else good end as raw
 from (select *, json_object('title_ru', plain, 'summary', ' ' || plain)::varchar as good from responses_raw) z),
found as (select *, case when regexp_matches(c, '(?s)\{.*"title_ru".*"summary".*\}') then regexp_extract(c, '(?s)\{.*"title_ru".*"summary".*\}') else regexp_extract(c, '(?s)\{.*\}') end as f
 from (select *, regexp_replace(raw, '```json\s*|```\s*', '', 'g') as c from responses_all) y),
parsed as (select *, case when f <> '' and json_valid(f) then f::json end as j from found),
fields as (select *, case when json_type(j, '$.title_ru') = 'VARCHAR' then trim(j->>'$.title_ru') end as title_ru,
 case when json_type(j, '$.summary') = 'VARCHAR' then trim(j->>'$.summary') end as summary from parsed),
pieces as (select conv_id * 1000 + turn as id, title_ru as t from fields where title_ru is not null),
g as (""" + S.garbage_sentences("pieces") + """),
usable as (select conv_id, turn, case when f = '' then 'no JSON object' when j is null then 'invalid JSON'
 when coalesce(title_ru, '') = '' or coalesce(summary, '') = '' then 'missing fields'
 when length(title_ru) < 40 or length(summary) < 40 or g.id is not null then 'unusable text' end as reason, title_ru, summary
 from fields left join g on g.id = conv_id * 1000 + turn)"""


@query("llm_responses", f"with {_RESP} select conv_id, turn, reason, case when reason is null then title_ru end as title_ru, case when reason is null then summary end as summary from usable")
def llm_responses(spark, d):
    rows = P.with_parsed_response(responses(spark, d), "raw")
    ok = c("reason").isNull()
    return rows.select("conv_id", "turn", "reason", F.when(ok, c("title_ru")).alias("title_ru"), F.when(ok, c("summary")).alias("summary"))


@query("save_summary", f"""with {_RESP}, r as (select conv_id as id, title_ru, summary from (select *, row_number() over (partition by conv_id order by turn) as rn from usable where reason is null) w where rn = 1),
x as (select n.*, r.title_ru, r.summary as new_summary, {S.context('coalesce(r.title_ru, n.title)', 'r.summary', 'n.original_content')} as ctx from news_fx n left join r on r.id = n.id),
y as (select *, new_summary is not null and {S.invention('ctx')} as inv from x)
select id, coalesce(title_ru, title) as title, case when new_summary is not null then coalesce(nullif(original_title, ''), title) else original_title end as original_title,
 coalesce(new_summary, summary) as summary, case when new_summary is not null then 'summarized' else status end as status, original_url,
 case when inv then 'invention-tools' else section end as section,
 array_to_string(case when inv then {S.spheres('ctx')} else sphere_tags end, ',') as sphere_tags from y""")
def save_summary(spark, d):
    # a filter on a row number isn't pushed below the parsing steps; there, each would be repeated wherever it is used
    parsed = P.with_parsed_response(responses(spark, d), "raw").withColumn("number", F.monotonically_increasing_id())
    usable = parsed.filter(c("reason").isNull() & (c("number") >= 0))
    first = usable.groupBy(c("conv_id").alias("id")).agg(
        F.min_by("title_ru", "turn").alias("title_ru"), F.min_by("summary", "turn").alias("summary"))
    out = P.save_summary(X.news(spark, d), first, X.now())
    return out.select("id", "title", "original_title", "summary", "status", "original_url", "section",
                      F.array_join("sphere_tags", ",").alias("sphere_tags"))


@query("title_translate_fallback", """with t as (select id, case id % 3 when 0 then ' x ' when 1 then 'Перевод ' || id end as translated_title, case when id % 4 = 0 then 'ru' else language end as lang2 from news_fx)
select n.id, case when status = 'summarized' and coalesce(lang2, '') <> 'ru' and length(coalesce(trim(translated_title), '')) >= 3 then trim(translated_title) else title end as title,
 case when status = 'summarized' then case when lang2 = 'ru' then coalesce(nullif(original_content, ''), nullif(content, ''), summary) else coalesce(nullif(content, ''), summary) end else translation end as translation,
 case when status = 'summarized' then 'translated' else status end as status from news_fx n join t on t.id = n.id""")
def title_translate_fallback(spark, d):
    i = c("id")
    n = X.news(spark, d).withColumn("language", F.when(i % 4 == 0, "ru").otherwise(c("language")))
    titles = X.news(spark, d).select(
        "id", F.when(i % 3 == 0, " x ").when(i % 3 == 1, F.concat(F.lit("Перевод "), i.cast("string"))).alias("translated_title"))
    return P.translate_fallback(n, titles, X.now()).select("id", "title", "translation", "status")
