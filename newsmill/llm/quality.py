"""Line-first quality rules, in DataFrame functions only.

Each line is judged by its punctuation, navigation and boilerplate marks;
failing lines go, and a document that loses too much of its text, or fails the
base statistics, is rejected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsmill.llm.common import BLANKS, ascii_lower, table

SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›•·"
OUTCRIES = "!?"
LINE_ENDS = list(""".!?…:;"'”’»)]。！？""")
BOILERPLATE = [
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "uses cookies",
    "accept cookies", "enable javascript", "click here", "read more", "sign up for", "subscribe to our newsletter",
    "follow us on", "share this", "skip to content", "back to top", "lorem ipsum",
]
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A document is rejected when more of its non-blank characters than this go with the failing lines.
MAX_LOST_PERCENT = 50
#: Lines below this many words may end without punctuation, as headings do.
HEADING_WORDS = 10
#: Boilerplate phrases count in lines of at most so many characters.
BOILERPLATE_CHARS = 160

_BLANK_RUN = r"[\x20\x09-\x0D]+"
_WINDOW = 5


def _count(text: Column, chars: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, chars, ""))


def _has(text: Column, chars: str) -> Column:
    found = [F.contains(text, F.lit(c)) for c in chars]
    return reduce(Column.__or__, found)


def line_fails(line: Column) -> Column:
    """True for a line that is navigation, symbols, outcries, unfinished or boilerplate; never for a blank one.

    Each rule begins with a cheap test that most lines of prose don't pass, so
    that counting is rare.
    """
    words = _count(F.btrim(line, F.lit(BLANKS)), " ") + 1
    separators = _count(line, SEPARATORS)
    end = F.substring(F.rtrim(line, F.lit(BLANKS)), -1, 1)
    return (
        (_has(line, SEPARATORS) & (separators >= 2) & (separators * 4 >= words))
        | (_has(line, SYMBOLS) & (_count(line, SYMBOLS) * 10 > F.char_length(F.translate(line, BLANKS, ""))))
        | (_has(line, OUTCRIES) & (words >= 3) & (_count(line, OUTCRIES) * 2 >= words))
        | (~end.isin(["", *LINE_ENDS]) & (words >= HEADING_WORDS))
        | ((F.char_length(line) <= BOILERPLATE_CHARS) & ascii_lower(line).rlike("|".join(BOILERPLATE)))
    )


def _repeat_words(d: DataFrame) -> DataFrame:
    """Adds n_repeat_words: the words that lie in a window of five found at least twice in the text.

    Windows are compared by a 64-bit hash over the words' 64-bit hashes.  Each
    step is a column of its own that the next one uses more than once, so none
    is evaluated again for every element.
    """
    d = d.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    d = d.withColumn(
        "windows",
        F.when(F.size("hashes") >= _WINDOW, F.transform(
            F.sequence(F.lit(0), F.size("hashes") - _WINDOW),
            lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(_WINDOW)]),
        )),
    )
    d = d.withColumn(
        "sorted",
        F.when(F.size(F.array_distinct("windows")) < F.size("windows"),
               F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    )
    d = d.withColumn(
        "places",
        F.sort_array(F.transform(
            F.filter("sorted", lambda s, i: (s.h == F.get("sorted", i - 1).h) | (s.h == F.get("sorted", i + 1).h)),
            lambda s: s.i,
        )),
    )
    reach = F.transform("places", lambda p, i: F.least(F.coalesce(F.get("places", i + 1) - p, F.lit(_WINDOW)), F.lit(_WINDOW)))
    total = F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)
    return d.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long")))


def judge(docs: DataFrame, carry: str | None = None) -> DataFrame:
    """(doc_id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    n_failed_lines, lost_chars, clean_text): one row per input row.

    A null text counts as empty: no words, base_failed, not kept.  clean_text has
    the lines that pass, joined by \\n.  Ids may be null or repeat; each row is
    judged alone.  Other columns are not read, but the one named ``carry`` is
    returned as well.
    """
    also = [carry] if carry else []
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *also)
    d = d.select(
        "doc_id", "text", *also,
        F.filter(F.split("text", _BLANK_RUN, -1), lambda w: w != "").alias("words"),
        F.split("text", "\n", -1).alias("lines"),
    )
    d = _repeat_words(d)
    spoken = F.filter("lines", lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    d = d.select(
        "doc_id", "text", *also, "lines", "n_repeat_words",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        _count(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        spoken.alias("spoken"),
        F.filter("lines", lambda x: ~line_fails(x)).alias("passed"),
    )
    d = d.select(
        "doc_id", "text", *also, "n_words", "word_chars", "n_symbols", "n_repeat_words",
        (F.size("spoken") - F.size(F.array_distinct("spoken"))).cast("long").alias("n_dup_lines"),
        (F.size("lines") - F.size("passed")).cast("long").alias("n_failed_lines"),
        F.array_join("passed", "\n").alias("clean_text"),
    )
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    lost = F.when(F.col("n_failed_lines") == 0, 0).otherwise(
        F.col("word_chars") - F.char_length(F.translate("clean_text", BLANKS, ""))
    )
    d = d.withColumns({"base_failed": base_failed, "lost_chars": lost.cast("long")})
    return d.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= MAX_LOST_PERCENT * F.col("word_chars")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_failed_lines", "lost_chars",
    )
