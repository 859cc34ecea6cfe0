"""The daily digest: sections of each day, message text, and messages of bounded length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsmill import rules
from newsmill.functions import text as T
from newsmill.operators.listing import event_time, readable
from newsmill.operators.skew import bucketed_rank


def digest_items(news: DataFrame) -> DataFrame:
    """Readable rows with the digest ``day`` they belong to (that of the next midnight), ``section`` and ``rank`` in it, newest first."""
    route = F.when(T.or_empty(F.col("section")) != "", F.col("section")).when(F.coalesce("is_science", F.lit(False)), "science").otherwise("ai-news")
    d = readable(news).withColumns({"section": route, "at": event_time()}).filter(F.col("section").isin([s for s, *_ in rules.DIGEST_HEADINGS]))
    d = d.withColumn("day", F.date_add(F.col("at").cast("date"), 1))
    return bucketed_rank(d, ["day", "section"], [F.col("at").desc(), F.col("id").desc()], -F.hour("at"))


def digest_sections(items: DataFrame, top: int = rules.DIGEST_ITEMS_PER_SECTION, themes: int = rules.DIGEST_THEMES) -> DataFrame:
    """(day, section, n, items, overflow, themes): the ``top`` newest rows, how many more there are, and their first themes."""
    keys = ["day", "section"]
    row = F.struct("rank", "id", "title", "original_url", "summary")
    sums = items.groupBy(*keys).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("rank") <= top, row))).alias("items"))
    tags = items.filter(F.col("rank") > top).select(*keys, "rank", F.posexplode("sphere_tags").alias("_pos", "tag"))
    first = tags.groupBy(*keys, "tag").agg(F.min(F.struct("rank", "_pos")).alias("_at"))
    order = Window.partitionBy(*keys).orderBy("_at")  # as many rows as there are themes
    few = first.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= themes)
    few = few.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_n", "tag"))).alias("_t")).select(*keys, F.col("_t.tag").alias("themes"))
    d = sums.join(few, keys, "left").withColumn("themes", F.coalesce("themes", F.array().cast("array<string>")))
    return d.select(*keys, "n", "items", F.greatest(F.col("n") - top, F.lit(0)).alias("overflow"), "themes")


def _section_text(heading: tuple[str, str, str]) -> Column:
    _, emoji, name = heading

    def line(item: Column) -> Column:
        short = T.escape_markdown(F.substring(T.collapse_ws(item.summary), 1, rules.DIGEST_DESCRIPTION_CHARS))
        return F.concat(F.lit("▫️ ["), T.escape_markdown(item.title), F.lit("]("), item.original_url, F.lit(")"), F.when(T.or_empty(item.summary) != "", F.concat(F.lit(" — "), short)).otherwise(""))

    about = F.when(F.size("themes") > 0, F.concat(F.lit(" про "), F.array_join("themes", ", "))).otherwise(" материалов по теме")
    more = F.when(F.col("overflow") > 0, F.concat(F.lit("\nЕщё "), F.col("overflow").cast("string"), F.lit(" новостей"), about, F.lit(" — в дашборде."))).otherwise("")
    head = F.concat(F.lit(f"{emoji} *{name}* — "), F.col("n").cast("string"), F.lit("\n"))
    return F.concat(head, F.array_join(F.transform("items", line), "\n"), more, F.lit("\n\n"))


def digest_text(sections: DataFrame) -> DataFrame:
    """(day, text): the message of each day, its sections in fixed order; every day has at most as many rows as there are headings."""
    place = F.lit(None).cast("int")
    body = F.lit(None).cast("string")
    for k, heading in enumerate(rules.DIGEST_HEADINGS):
        mine = F.col("section") == heading[0]
        place, body = F.when(mine, k).otherwise(place), F.when(mine, _section_text(heading)).otherwise(body)
    d = sections.select("day", "n", F.struct(place.alias("k"), body.alias("b")).alias("p")).groupBy("day").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list("p")).alias("p"))
    months = F.array(*map(F.lit, rules.MONTHS_OF))
    date = F.concat_ws(" ", F.dayofmonth("day"), F.element_at(months, F.month("day")), F.year("day"), F.lit("г."))
    head, counted, foot = rules.DIGEST_FRAME
    return d.select("day", F.concat(F.lit(head), date, F.lit("_\n\n"), F.format_string(counted, F.col("n")), F.lit("\n\n"), F.array_join("p.b", ""), F.lit(foot)).alias("text"))


def split_text(text: Column, max_chars: int = rules.DIGEST_MESSAGE_CHARS) -> Column:
    """Chunks of at most ``max_chars``, cut at the last line end that fits or else hard; line ends at a cut are dropped."""

    def step(s: Column, _: Column) -> Column:
        head = F.substring(s.rest, 1, max_chars + 1)
        at = F.when(F.contains(head, F.lit("\n")), F.length(head) - F.length(F.substring_index(head, "\n", -1)) - 1).otherwise(max_chars)
        cut = F.struct(
            F.regexp_replace(F.substr(s.rest, at + 1), "^\n+", "").alias("rest"), F.array_append(s.done, F.substr(s.rest, F.lit(1), at)).alias("done")
        )
        return F.when(F.length(s.rest) > max_chars, cut).otherwise(s)

    start = F.struct(text.alias("rest"), F.array().cast("array<string>").alias("done"))
    steps = F.sequence(F.lit(0), F.size(F.split(text, "\n")) + F.ceil(F.length(text) / max_chars).cast("int"))
    return F.aggregate(steps, start, step, lambda s: F.when((s.rest != "") | (F.size(s.done) == 0), F.array_append(s.done, s.rest)).otherwise(s.done))
