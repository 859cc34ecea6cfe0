"""Text helpers as Column expressions (all stay inside the JVM)."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from newsmill import rules

# White space as the web platform defines it; Java's \s covers ASCII only.
WS = r"[\s\x{000B}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
WS_CHARS = " \t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

# \b in the rule tables means a boundary between ASCII word characters.
_WORD = "[A-Za-z0-9_]"
_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def pattern(text: str, ignore_case: bool = True) -> str:
    """Turn a pattern of the rule tables into a Java pattern."""
    body = text.replace(r"\b", _BOUNDARY).replace(".*", r"[^\n\r\x{2028}\x{2029}]*")
    return ("(?iu)" if ignore_case else "") + body


def any_contains(text: Column, keywords: Iterable[str]) -> Column:
    return reduce(or_, (text.contains(k) for k in keywords))


def _marks(pat: str) -> list[tuple[int, str, int]]:
    """(position, character, depth) of the characters outside of escapes and character classes."""
    out, depth, i = [], 0, 0
    while i < len(pat):
        ch = pat[i]
        if ch == "\\":
            i = pat.index("}", i) if pat[i + 1 : i + 3] in ("p{", "P{", "x{") else i + 1
        elif ch == "[":
            i += 2 if pat[i + 1 : i + 2] == "^" else 1
            while pat[i] != "]":
                i += (pat.index("}", i) - i + 1 if pat[i + 1 : i + 3] in ("p{", "P{", "x{") else 2) if pat[i] == "\\" else 1
        else:
            depth -= ch == ")"
            out.append((i, ch, depth))
            depth += ch == "("
        i += 1
    return out


def _alternatives(pat: str) -> list[str]:
    """Alternatives of a pattern; a group around all of one is opened."""
    marks = _marks(pat)
    cuts = [i for i, ch, depth in marks if ch == "|" and depth == 0]
    parts = [pat[a + 1 : b] for a, b in zip([-1, *cuts], [*cuts, len(pat)])]
    if len(parts) > 1:
        return [a for part in parts for a in _alternatives(part)]
    closes = [i for i, ch, depth in marks if ch == ")" and depth == 0]
    if pat.startswith("(") and not pat.startswith("(?") and closes[:1] == [len(pat) - 1]:
        return _alternatives(pat[1:-1])
    return [pat]


def _needle(alternative: str) -> str:
    """A piece of plain text that every match of the alternative contains; empty where none can be told."""
    runs, run, i, n = [], "", 0, len(alternative)
    closing = {i: next(j for j, c, d in _marks(alternative) if c == ")" and d == depth and j > i)
               for i, ch, depth in _marks(alternative) if ch == "("}
    while i < n:
        ch, after = alternative[i], i + 1
        plain = ch
        if ch == "\\":
            plain = alternative[i + 1] if not alternative[i + 1].isalnum() else ""
            after = i + 2
            if alternative[i + 1 : i + 3] in ("p{", "P{", "x{"):
                after = alternative.index("}", i) + 1
        elif ch == "[":
            later = [j for j, _, _ in _marks(alternative) if j > i]
            plain, after = "", later[0] if later else n
        elif ch == "(":
            plain, after = "", closing[i] + 1
        elif ch in ".^$|":
            plain = ""
        repeat = re.match(r"[*?]|\+|\{[^}]*\}", alternative[after:])
        if repeat:
            after += repeat.end() + (alternative[after + repeat.end() : after + repeat.end() + 1] in ("?", "+"))
            runs += [run + plain if repeat[0] == "+" else run]
            run = ""
        elif plain:
            run += plain
        else:
            runs.append(run)
            run = ""
        i = after
    return max([*runs, run], key=len)


def has_any(text: Column, pat: str) -> Column:
    """True when ``pat`` occurs in ``text``.

    A regular expression over many alternatives is slow on whole texts, so each
    alternative is first looked for by a plain substring it must contain; the
    expression itself only runs on rows that have one.
    """
    bare = pat.replace(r"\b", "")
    alternatives = _alternatives(bare)
    if bare != pat:
        return any_contains(text, dict.fromkeys(map(_needle, alternatives))) & text.rlike(pattern(pat, False))
    tests = [
        text.contains(n) if n == a else text.contains(n) & text.rlike(pattern(a, False))
        for a, n in ((a, _needle(a)) for a in alternatives)
    ]
    return reduce(or_, tests)


def count_matches(text: Column, pat: str) -> Column:
    """Number of matches in lower-cased ``text``; 0 without running the pattern where possible."""
    p = pat.lower()
    needles = dict.fromkeys(map(_needle, _alternatives(p.replace(r"\b", ""))))
    found = F.regexp_count(text, F.lit(pattern(p, False)))
    return F.when(any_contains(text, needles), found).otherwise(F.lit(0))


def trim_ws(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_CHARS))


def collapse_ws(text: Column) -> Column:
    return trim_ws(F.regexp_replace(text, WS + "+", " "))


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def is_blank(text: Column) -> Column:
    return trim_ws(or_empty(text)) == ""


def clip(text: Column, length: int) -> Column:
    return F.substring(text, 1, length)


def normalize_title(title: Column, stop_words: Iterable[str] = rules.TITLE_STOP_WORDS) -> Column:
    words = F.split(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]", " "), " +")
    stop = list(stop_words)
    return F.array_join(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(stop)), " ")


def edit_budget(length: Column, percent: int = rules.SIMILARITY_PERCENT) -> Column:
    """Most edits two titles may differ by when the longer one has this length."""
    return F.floor(length * (100 - percent) / 100).cast("int")


def title_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def remove_boilerplate(text: Column) -> Column:
    for phrase in rules.BOILERPLATE_PHRASES:
        text = F.regexp_replace(text, pattern(phrase), " ")
    return text


def clean_text(text: Column) -> Column:
    """Distinct non-empty lines in first-seen order, without boilerplate, on one line."""
    lines = F.transform(F.split(remove_boilerplate(text), "\n+"), trim_ws)
    kept = F.array_distinct(F.filter(lines, lambda line: line != ""))
    return collapse_ws(F.array_join(kept, " "))


def has_repeated_sentence(text: Column, more_than: int = 3) -> Column:
    """True when one sentence occurs more than ``more_than`` times.

    The sentences of one text are sorted inside the row; equal ones are then
    neighbours, so no shuffle of sentences is needed.
    """
    parts = F.split(text, r"(?<=[.!?])" + WS + "+")
    keys = F.array_sort(
        F.filter(F.transform(parts, lambda s: F.lower(trim_ws(s))), lambda s: s != "")
    )
    return F.exists(
        F.arrays_zip(
            keys.alias("a"), F.slice(keys, more_than + 1, F.greatest(F.size(keys), F.lit(1))).alias("b")
        ),
        lambda pair: pair["a"].eqNullSafe(pair["b"]),
    )


def is_garbage(text: Column) -> Column:
    short = F.length(trim_ws(or_empty(text))) < 40
    return short | has_repeated_sentence(or_empty(text))


def is_unusable(text: Column, kind: Column) -> Column:
    """Web text must pass the repetition test, transcripts only the length test."""
    short = F.length(trim_ws(or_empty(text))) < 40
    return short | ((kind == "web-article") & has_repeated_sentence(or_empty(text)))


def reading_minutes(summary: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(or_empty(summary)) / 1000)).cast("bigint")


def tags_list(tags: Column) -> Column:
    return F.filter(F.split(or_empty(tags), ","), lambda t: t != "")


def append_tag(tags: Column, tag: str) -> Column:
    parts = F.filter(F.transform(F.split(or_empty(tags), ","), trim_ws), lambda t: t != "")
    return F.array_join(
        F.when(F.array_contains(parts, tag), parts).otherwise(F.array_append(parts, F.lit(tag))), ","
    )


def metrics_get(metrics: Column, key: str) -> Column:
    return F.get_json_object(metrics, "$." + key)


def metrics_merge(metrics: Column, patch: Column) -> Column:
    """Shallow merge of two JSON objects; keys of ``patch`` win."""
    kind = "map<string,variant>"
    new = F.from_json(patch, kind)
    old = F.coalesce(F.from_json(metrics, kind), F.from_json(F.lit("{}"), kind))
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k))
    return F.to_json(F.map_concat(kept, new))


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, r"([_*\[\]`])", r"\\$1")


def ascii_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x20-\x7E]", "")
