"""Landed payloads as rows: JSON by path, tab-separated listings, captions, legacy encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsmill import rules
from newsmill.functions import text as T

FIELDS = {"title": "title", "url": "url", "description": "description", "pub_date": "publishedAt", "image_url": "imageUrl"}


def json_path_extract(payloads: DataFrame, payload: str, items: str = "articles", fields: dict[str, str] | None = None) -> DataFrame:
    """A row per element of the array at ``items``; fields by dotted path, missing ones empty, a missing image null.

    A payload that isn't JSON, or has no array there, gives no rows.
    """
    array = F.try_variant_get(F.try_parse_json(payload), f"$.{items}", "array<variant>")
    d = payloads.withColumn("_item", F.explode(array))
    text = lambda path: T.or_empty(T.trim_ws(F.try_variant_get("_item", f"$.{path}", "string")))
    d = d.withColumns({name: text(path) for name, path in (fields or FIELDS).items()}).drop("_item", payload)
    return d.withColumn("image_url", F.nullif("image_url", F.lit(""))) if "image_url" in d.columns else d


def tsv_listing(lines: DataFrame, line: str = "line") -> DataFrame:
    """(video_id, title, published_at, url) of lines ``id, title, yyyymmdd, url``; a bad date is null, a missing part drops the line."""
    parts = F.split(line, "\t")
    part = lambda i: F.get(parts, F.lit(i))
    date = F.when(part(2).rlike(r"^\d{8}$"), F.try_to_date(part(2), "yyyyMMdd").cast("timestamp_ntz"))
    d = lines.filter((T.or_empty(part(0)) != "") & (T.or_empty(part(1)) != "") & (T.or_empty(part(3)) != ""))
    return d.select(part(0).alias("video_id"), T.trim_ws(part(1)).alias("title"), date.alias("published_at"), T.trim_ws(part(3)).alias("url"))


def collapse_repeats(lines: Column) -> Column:
    """An array without the elements that equal the one before them."""
    return F.filter(lines, lambda x, i: (i == 0) | (x != F.get(lines, i - 1)))


def vtt_lines(raw: Column) -> Column:
    """Spoken lines of a VTT text: no headers, times, tags or blanks."""
    kept = F.filter(F.split(raw, "\r?\n"), lambda x: ~x.rlike("^(WEBVTT|Kind:|Language:|NOTE)|-->"))
    clean = lambda x: T.trim_ws(F.replace(F.replace(F.replace(F.regexp_replace(x, "<[^>]+>", ""), F.lit("&amp;"), F.lit("&")), F.lit("&#39;"), F.lit("'")), F.lit("&quot;"), F.lit('"')))
    return F.filter(F.transform(kept, clean), lambda x: x != "")


def json3_text(raw: Column) -> Column:
    events = F.from_json(raw, "struct<events: array<struct<segs: array<struct<utf8: string>>>>>")["events"]
    lines = F.transform(events, lambda e: F.array_join(F.transform(e["segs"], lambda s: T.or_empty(s["utf8"])), ""))
    return F.array_join(F.filter(lines, lambda x: T.trim_ws(x) != ""), " ")


def with_caption_text(captions: DataFrame, raw: str, kind: str, name: str = "text", min_chars: int = rules.MIN_TRANSCRIPT_CHARS) -> DataFrame:
    """Adds the text of ``vtt`` or ``json3`` captions; NULL below ``min_chars``."""
    d = captions.withColumn("_lines", F.when(F.col(kind) == "vtt", vtt_lines(F.col(raw))))
    text = T.collapse_ws(F.when(F.col(kind) == "vtt", F.array_join(collapse_repeats(F.col("_lines")), " ")).otherwise(json3_text(F.col(raw))))
    return d.withColumn(name, F.when(F.length(text) >= min_chars, text)).drop("_lines")


def pick_caption_track(tracks: DataFrame) -> DataFrame:
    """One of each video's tracks (video_id, position, lang, ext, automatic, url): native first, English first, json3 first."""
    lang, ext = F.col("lang"), F.col("ext")
    language = F.when(lang == "en", 0).when(lang.rlike("(?i)^en[-_]") & ~lang.rlike("(?i)auto"), 1).when(lang.rlike("(?i)^en"), 2).otherwise(3)
    form = F.when(ext == "json3", 0).when(ext == "vtt", 1).otherwise(2)
    order = F.struct("automatic", language.alias("l"), F.when(language == 3, F.col("position")).otherwise(0).alias("p"), form.alias("f"), "position")
    rest = F.struct(*[c for c in tracks.columns if c != "video_id"])
    return tracks.filter("url is not null").groupBy("video_id").agg(F.min_by(rest, order).alias("_t")).select("video_id", "_t.*")


def first_nonempty_by_priority(rows: DataFrame, key: str, priority: str) -> DataFrame:
    """The rows of each key's best priority that has any."""
    best = rows.groupBy(key).agg(F.min(priority).alias("_best"))
    return rows.join(best, key).filter(F.col(priority) == F.col("_best")).drop("_best")


#: The upper half of windows-1251, in order.
_UPPER_1251 = bytes(range(128, 152)).decode("cp1251") + "\x98" + bytes(range(153, 256)).decode("cp1251")
_UPPER_LATIN = "".join(map(chr, range(128, 256)))


def decoded(body: Column, content_type: Column) -> Column:
    """Bytes as text: windows-1251 where the content type says so, else UTF-8."""
    charset = F.lower(F.regexp_extract(content_type, r"(?i)charset=[\"']?([\w-]+)", 1))
    return F.when(charset == "windows-1251", F.translate(F.decode(body, "ISO-8859-1"), _UPPER_LATIN, _UPPER_1251)).otherwise(F.decode(body, "UTF-8"))
