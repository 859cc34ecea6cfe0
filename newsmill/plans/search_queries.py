"""Registered searches of an inverted index, which each run builds over all news in a folder of its own."""

from __future__ import annotations

import uuid

from newsmill.functions.stems import stem
from newsmill.operators import listing as L
from newsmill.plans import fixtures as X
from newsmill.plans.reader_queries import _EVENT, _NOW
from newsmill.plans.registry import query
from newsmill.session import shared_folder
from newsmill.sources.text_index import TextIndex, unstemmed


def index_of_news(spark, d, stemmer) -> TextIndex:
    index = TextIndex(spark, f"{shared_folder(spark)}/text-index-{uuid.uuid4().hex}", stemmer, n_buckets=64)
    index.append(0, X.news(spark, d).select("id", L.search_text().alias("text")))
    return index


def _published(spark, d, ids):
    rows = L.news_filter(X.news(spark, d), X.now()).select("id", L.event_time().alias("event_time"))
    return rows.join(ids, "id", "left_semi")


@query("fts_indexed", f"""with tok as (select id, status, {_EVENT} as et, regexp_split_to_array(lower(concat_ws(' ', coalesce(title,''),
 coalesce(summary,''), coalesce(content,''), coalesce(translation,''))), '[^\\p{{L}}\\p{{N}}]+') as t from news_fx)
select id, et as event_time from tok where status = 'published' and et <= {_NOW} and list_contains(t, 'learning') and list_contains(t, 'machine')""")
def fts_indexed(spark, d):
    return _published(spark, d, index_of_news(spark, d, unstemmed).search("  Machine the LEARNING "))


@query("fts_stemmed")
def fts_stemmed(spark, d):
    return _published(spark, d, index_of_news(spark, d, stem).search("new catalysts discovering"))


@query("index_stems")
def index_stems(spark, d):
    """Each stem of the news with the number of its documents, from the posting lists alone."""
    index = index_of_news(spark, d, stem)
    return index.documents_per_stem()
