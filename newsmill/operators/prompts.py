"""Batches for an external language model: request rows out, response rows in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsmill import rules
from newsmill.functions import classify as C, text as T


def prompt_requests(queue: DataFrame, max_tokens: int = rules.PROMPT_TOKENS) -> DataFrame:
    """Prompts of every queued article, its body fenced as untrusted, in as many numbered chunks as it needs."""
    size = max_tokens * rules.CHARS_PER_TOKEN
    body = T.or_empty(F.col("original_content"))
    n = F.greatest(F.lit(1), F.ceil(F.length(body) / size)).cast("int")
    chunks = queue.select(
        "id", "title", "source", body.alias("body"), n.alias("n_chunks"), F.explode(F.sequence(F.lit(1), n)).alias("chunk_no")
    )
    head, begin, end = rules.PROMPT_FRAME
    prompt = F.concat(
        F.format_string(head, F.col("title"), F.col("source")), F.lit(begin),
        F.substr("body", (F.col("chunk_no") - 1) * size + 1, F.lit(size)), F.lit(end),
    )
    return chunks.select("id", "chunk_no", "n_chunks", prompt.alias("prompt"))


def with_parsed_response(rows: DataFrame, raw: str) -> DataFrame:
    """Adds ``title_ru``, ``summary`` and ``reason`` (NULL when usable) of a raw answer.

    The object is found and parsed once, in a column of its own that later ones
    use more than once, so it isn't repeated for each of them.
    """
    plain = F.regexp_replace(F.col(raw), r"```json\s*|```\s*", "")
    d = rows.withColumn("_plain", plain)
    both = F.regexp_extract("_plain", r'(?s)\{.*"title_ru".*"summary".*\}', 0)
    d = d.withColumn("_found", F.coalesce(F.nullif(both, F.lit("")), F.regexp_extract("_plain", r"(?s)\{.*\}", 0)))
    d = d.withColumn("_parsed", F.try_parse_json("_found"))

    def text(field: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get("_parsed", f"$.{field}", "variant"))
        return F.when(kind == "STRING", T.trim_ws(F.try_variant_get("_parsed", f"$.{field}", "string")))

    d = d.withColumns({"title_ru": text("title_ru"), "summary": text("summary")})
    title, summary = F.col("title_ru"), F.col("summary")
    reason = (
        F.when(F.col("_found") == "", F.lit("no JSON object"))
        .when(F.col("_parsed").isNull(), F.lit("invalid JSON"))
        .when(T.is_blank(title) | T.is_blank(summary), F.lit("missing fields"))
        .when(T.is_garbage(title) | T.is_garbage(summary), F.lit("unusable text"))
    )
    return d.withColumn("reason", reason).drop("_plain", "_found", "_parsed")


def without_artifact_lines(text: Column) -> Column:
    keep = F.filter(F.split(text, "\n"), lambda line: ~line.rlike("(?u)" + rules.MODEL_ARTIFACT_LINE))
    return T.trim_ws(F.array_join(keep, "\n"))


def first_paragraph(text: Column) -> Column:
    parts = F.filter(F.transform(F.split(text, r"\n\n+"), T.trim_ws), lambda p: p != "")
    return F.coalesce(F.get(parts, 0), T.trim_ws(text))


def save_summary(news: DataFrame, responses: DataFrame, now: Column) -> DataFrame:
    """Apply usable responses ``(id, title_ru, summary)``; the URL never changes."""
    r = responses.select("id", "title_ru", F.col("summary").alias("_summary"))
    d = news.join(r, "id", "left")
    hit = F.col("_summary").isNotNull()
    context = C.invention_context(
        F.coalesce("title_ru", "title"), F.col("_summary"), F.col("original_content")
    )
    d = d.withColumn("_context", F.lower(F.when(hit, context)))
    d = d.withColumn("_invention", hit & C.is_invention(F.col("_context")))
    return d.withColumns(
        {
            "original_title": F.when(hit, F.coalesce(F.nullif("original_title", F.lit("")), "title")).otherwise(F.col("original_title")),
            "title": F.coalesce("title_ru", "title"),
            "summary": F.coalesce("_summary", "summary"),
            "status": F.when(hit, F.lit("summarized")).otherwise(F.col("status")),
            "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
            "section": F.when(F.col("_invention"), F.lit("invention-tools")).otherwise(F.col("section")),
            "sphere_tags": F.when(F.col("_invention"), C.sphere_tags(F.col("_context"))).otherwise(F.col("sphere_tags")),
        }
    ).drop("title_ru", "_summary", "_invention", "_context")


def translate_fallback(news: DataFrame, titles: DataFrame, now: Column) -> DataFrame:
    """Apply translated titles ``(id, translated_title)`` to summarized rows."""
    d = news.join(titles, "id", "left")
    todo = F.col("status") == "summarized"
    russian = F.coalesce(F.col("language") == "ru", F.lit(False))
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    new_title = T.trim_ws(F.col("translated_title"))
    text = F.when(russian, F.coalesce(blank("original_content"), blank("content"), F.col("summary"))).otherwise(
        F.coalesce(blank("content"), F.col("summary"))
    )
    keep = russian | (F.length(F.coalesce(new_title, F.lit(""))) < 3)
    return d.withColumns(
        {
            "title": F.when(todo & ~keep, new_title).otherwise(F.col("title")),
            "translation": F.when(todo, text).otherwise(F.col("translation")),
            "updated_at": F.when(todo, now).otherwise(F.col("updated_at")),
            "status": F.when(todo, F.lit("translated")).otherwise(F.col("status")),
        }
    ).drop("translated_title")
