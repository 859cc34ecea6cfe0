"""Builders for the oracle statements (DuckDB dialect)."""

from __future__ import annotations

from newsmill import rules
from newsmill.functions.text import WS, WS_CHARS


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pat(text: str, ignore_case: bool = True) -> str:
    body = text.replace(".*", r"[^\n\r\x{2028}\x{2029}]*")
    return lit(("(?i)" if ignore_case else "") + body)


def trim(expr: str) -> str:
    return f"trim({expr}, {lit(WS_CHARS)})"


def collapse(expr: str) -> str:
    return trim(f"regexp_replace({expr}, {lit(WS + '+')}, ' ', 'g')")


def boilerplate(expr: str) -> str:
    for p in rules.BOILERPLATE_PHRASES:
        expr = f"regexp_replace({expr}, {pat(p)}, ' ', 'g')"
    return expr


def contains_any(expr: str, words) -> str:
    return "(" + " or ".join(f"contains({expr}, {lit(w)})" for w in words) + ")"


def first_matching(expr: str, table) -> str:
    return "case " + " ".join(f"when {contains_any(expr, w)} then {lit(k)}" for k, w in table.items()) + " end"


def matches(expr: str, p: str, ignore_case: bool = True) -> str:
    return f"regexp_matches({expr}, {pat(p, ignore_case)})"


def ai_signal(expr: str) -> str:
    return "(" + " or ".join(matches(expr, p, False) for p in rules.SCIENCE_AI_PATTERNS) + ")"


def article_class(text: str) -> str:
    """select list over an already lower-cased text expression"""
    sci = f"({first_matching(text, rules.SCIENCE_FIELD_KEYWORDS)} is not null and {ai_signal(text)})"
    return (
        f"{sci} as is_science, case when {sci} then {first_matching(text, rules.SCIENCE_FIELD_KEYWORDS)} end as science_field, "
        f"{first_matching(text, rules.CATEGORY_KEYWORDS)} as category_slug, "
        f"case when {sci} then {first_matching(text, rules.CLASSIFICATION_TYPE_KEYWORDS)} end as classification_type"
    )


def invention(expr: str) -> str:
    return matches(expr, "|".join(rules.INVENTION_TERMS))


def spheres(expr: str) -> str:
    cells = ", ".join(f"case when {matches(expr, p)} then {lit(label)} end" for _, label, p in rules.SPHERES)
    return f"list_filter([{cells}], lambda x: x is not null)"


def context(*parts: str) -> str:
    head, *rest = parts
    cells = [trim(f"coalesce({head}, '')")]
    cells += [f"nullif({trim(f'coalesce({p}, {chr(39)*2})')}, '')" for p in rest]
    return f"concat_ws('. ', {', '.join(cells)})"


def argmax(expr: str, table, default: str) -> str:
    counts = "[" + ", ".join(f"len(regexp_extract_all({expr}, {pat(p)}))" for _, p in table) + "]"
    names = "[" + ", ".join(lit(n) for n, _ in table) + "]"
    return f"case when list_max({counts}) > 0 then {names}[list_position({counts}, list_max({counts}))] else {lit(default)} end"


def norm_title(expr: str) -> str:
    stop = "[" + ", ".join(lit(w) for w in rules.TITLE_STOP_WORDS) + "]"
    words = f"regexp_split_to_array(regexp_replace(lower({expr}), '[^\\p{{L}}\\p{{N}}]', ' ', 'g'), ' +')"
    return f"array_to_string(list_filter({words}, lambda w: length(w) > 1 and not list_contains({stop}, w)), ' ')"


#: DuckDB's edit distance counts bytes, so each of these letters becomes a byte that no lower-case title holds.
_LETTERS = "абвгдеёжзийклмнопрстуфхцчшщъыьэюя" + "ßàáâäçèéêëíñóôöùúüœ"
_BYTES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(map(chr, [*range(1, 9), *range(14, 32)]))


def one_byte(expr: str) -> str:
    return f"translate({expr}, {lit(_LETTERS)}, {lit(_BYTES)})"


def similar_titles(keys: str, others: str) -> str:
    """(l, r, d, n) of keys(k) and others(k) with an edit similarity of 0.85 or more, equal ones included"""
    near = "abs(length(a.k) - length(b.k)) * 100 <= 15 * greatest(length(a.k), length(b.k))"
    return (
        f"select l, r, d, n from (select a.k as l, b.k as r, levenshtein({one_byte('a.k')}, {one_byte('b.k')}) as d, greatest(length(a.k), length(b.k)) as n "
        f"from (select distinct k from {keys} where k <> '') a join (select distinct k from {others} where k <> '') b on {near}) p where d * 100 <= 15 * n"
    )


def earlier_kept(conflicts: str) -> str:
    """n of conflicts(n, before) that stay when rows with an earlier kept one in before go, in rising n"""
    return (
        f"ordered as materialized (select n, before, row_number() over (order by n) as i from {conflicts}), "
        "steps(i, kept) as (select 0::bigint, []::bigint[] union all select s.i + 1, case when list_has_any(before, kept) then kept else list_append(kept, n) end "
        "from steps s join ordered o on o.i = s.i + 1), stay as (select unnest(arg_max(kept, i)) as n from steps)"
    )


def norm_url(expr: str) -> str:
    u = trim(expr)
    rx = "'(?i)^(https?)://(?:[^/?#@]*@)?([^/?#]+)([^?#]*)'"
    host = f"lower(regexp_extract({u}, {rx}, 2))"
    path = f"lower(regexp_extract({u}, {rx}, 3))"
    return (
        f"case when regexp_matches({u}, {rx}) then regexp_replace(regexp_replace(regexp_replace({host}, "
        f"case when {u} ilike 'https:%' then ':443$' else ':80$' end, '') || {path}, '/$', ''), '^www\\.', '') else lower({u}) end"
    )


def garbage_sentences(source: str) -> str:
    """source(id, t) -> ids having one sentence more than three times"""
    return (
        f"select distinct id from (select id, lower({trim('s')}) as k from (select id, unnest(string_split(regexp_replace(t, "
        f"{lit('([.!?])' + WS + '+')}, '\\1' || chr(1), 'g'), chr(1))) as s from {source}) q) r where k <> '' group by id, k having count(*) > 3"
    )
