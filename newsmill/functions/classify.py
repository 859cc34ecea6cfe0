"""Rule classification as Column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from newsmill import rules
from newsmill.functions import text as T


def first_matching(text: Column, table: dict[str, list[str]]) -> Column:
    """Name of the first keyword list with a keyword inside ``text``."""
    out = F
    for name, words in table.items():
        out = out.when(T.any_contains(text, words), F.lit(name))
    return out


def is_ai_topic(title: Column, description: Column) -> Column:
    return T.any_contains(F.lower(T.or_empty(title)), rules.AI_TOPIC_KEYWORDS) | T.any_contains(
        F.lower(T.or_empty(description)), rules.AI_TOPIC_KEYWORDS
    )


def article_text(title: Column, description: Column) -> Column:
    return F.lower(F.concat(T.or_empty(title), F.lit(" "), T.or_empty(description)))


def classify_article(text: Column) -> dict[str, Column]:
    """``is_science, science_field, category_slug, classification_type`` of lower-cased text."""
    field = first_matching(text, rules.SCIENCE_FIELD_KEYWORDS)
    ai = reduce(or_, (T.has_any(text, p) for p in rules.SCIENCE_AI_PATTERNS))
    is_science = field.isNotNull() & ai
    return {
        "is_science": is_science,
        "science_field": F.when(is_science, field),
        "category_slug": first_matching(text, rules.CATEGORY_KEYWORDS),
        "classification_type": F.when(
            is_science, first_matching(text, rules.CLASSIFICATION_TYPE_KEYWORDS)
        ),
    }


def is_invention(text: Column) -> Column:
    """Of lower-cased text."""
    return T.has_any(text, "|".join(rules.INVENTION_TERMS).lower())


def sphere_tags(text: Column) -> Column:
    """Labels of all matching spheres of lower-cased text, in table order."""
    return F.array_compact(
        F.array(*[F.when(T.has_any(text, pat.lower()), F.lit(label)) for _, label, pat in rules.SPHERES])
    )


def section_of(invention: Column, science: Column) -> Column:
    return (
        F.when(invention, F.lit("invention-tools"))
        .when(science, F.lit("science"))
        .otherwise(F.lit("ai-news"))
    )


def invention_context(*parts: Column) -> Column:
    """Trimmed non-empty parts joined by ``". "`` (the first part always stays)."""
    head, *rest = parts
    cells = [T.trim_ws(T.or_empty(head))]
    cells += [F.when(~T.is_blank(p), T.trim_ws(p)) for p in rest]
    return F.concat_ws(". ", *cells)


def keyword_counts(text: Column, table: list[tuple[str, str]]) -> Column:
    """Matches per rule in lower-cased text, in table order."""
    return F.array(*[T.count_matches(text, p) for _, p in table])


def keyword_argmax(counts: Column, table: list[tuple[str, str]], default: str) -> Column:
    """Rule with the most matches; the first rule wins ties, ``default`` when none matches."""
    best = F.array_max(counts)
    name = F.element_at(
        F.array(*[F.lit(n) for n, _ in table]), F.array_position(counts, best).cast("int")
    )
    return F.when(best > 0, name).otherwise(F.lit(default))


def classify_science(counts: Column, source: Column, field: Column) -> Column:
    """Source override, then field map, then the counts of ``SCIENCE_RULES``."""
    out = F
    for name, slug in rules.SCIENCE_SOURCE_OVERRIDE.items():
        out = out.when(source == name, F.lit(slug))
    for name, slug in rules.SCIENCE_FIELD_MAP.items():
        if slug:
            out = out.when(field == name, F.lit(slug))
    return out.otherwise(keyword_argmax(counts, rules.SCIENCE_RULES, rules.SCIENCE_DEFAULT))
