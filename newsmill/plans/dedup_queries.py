"""Registered duplicate queries; their SQL compares all pairs of titles whose lengths allow it."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsmill.functions import text as T, urls as U
from newsmill.operators import dedup as D
from newsmill.plans import fixtures as X, sqltext as S
from newsmill.plans.collect_queries import CANDIDATES, candidates
from newsmill.plans.registry import query

def _key(title):
    return T.normalize_title(title)


def _first_half(spark, d):
    return X.news(spark, d).filter(F.col("id") % 2 == 0)


@query("title_similarity_join", f"""with k as materialized (select {S.norm_title('title')} as k from news_fx), p as ({S.similar_titles('k', 'k')})
select l as left_key, r as right_key, round(1 - d / n, 6) as similarity from p where l < r""")
def title_similarity_join(spark, d):
    keys = X.news(spark, d).select(_key(F.col("title")).alias("k"))
    return D.similar_keys(keys, keys).filter("left_key < right_key").withColumn("similarity", F.round("similarity", 6))


@query("dedup_history", "select id as match_id, coalesce(original_title, title) as title from news_fx where id % 2 = 0")
def dedup_history(spark, d):
    return D.history_titles(_first_half(spark, d))


_MATCHES = f"""old as materialized (select id, original_url, {S.norm_title('coalesce(original_title, title)')} as k from news_fx where id % 2 = 0),
new as materialized (select id, original_url, {S.norm_title('coalesce(original_title, title)')} as k from news_fx where id % 2 = 1), p as ({S.similar_titles('new', 'old')}),
best as (select l, o.id as match_id, 1 - d / n as similarity, row_number() over (partition by l order by 1 - d / n desc, o.id) as place from p join old o on o.k = p.r)"""


@query("dedup_against_history", f"""with {_MATCHES}, u as (select distinct original_url from old) select new.id, case when u.original_url is not null then 'url-exists' when b.match_id is not null then 'semantic-title' else 'unique' end as reason,
 case when u.original_url is null then b.match_id end as match_id, case when u.original_url is null then round(b.similarity, 6) end as similarity
from new left join u on u.original_url = new.original_url left join best b on b.l = new.k and b.place = 1""")
def dedup_against_history(spark, d):
    old = _first_half(spark, d)
    new = X.news(spark, d).filter(F.col("id") % 2 == 1).select("id", F.col("original_url").alias("url"), F.coalesce("original_title", "title").alias("t"))
    out = D.dedup_against_history(new, D.history_titles(old), old.select("original_url"), _key(F.col("t")), _key(F.col("title")))
    return out.select("id", "reason", "match_id", F.round("similarity", 6).alias("similarity"))


@query("dedup_in_batch", f"""with recursive {CANDIDATES}, r as materialized (select item_id as n, source, title, link, {S.norm_url('link')} as u, lower({S.trim('title')}) as k from cand),
p as ({S.similar_titles('r', 'r')}), c as (select b.n as n, a.n as a from r a join r b on a.u = b.u and a.n < b.n union select b.n, a.n from p join r a on a.k = p.l join r b on b.k = p.r and a.n < b.n),
conflicts as materialized (select r.n, coalesce(list(c.a) filter (c.a is not null), []) as before from r left join c on c.n = r.n group by r.n), {S.earlier_kept('conflicts')}
select r.n as item_id, source, title, link, r.n in (select n from stay) as keep from r""")
def dedup_in_batch(spark, d):
    rows = candidates(spark, d).select("item_id", "source", "title", "link")
    return D.dedup_in_batch(rows, "item_id", U.normalize_url(F.col("link")), F.lower(T.trim_ws(F.col("title"))))
