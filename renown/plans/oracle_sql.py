"""SQL fragments shared by the DuckDB oracles (rendered from the lexicons)."""

from __future__ import annotations

from renown.functions import lexicons as lx
from renown.operators.tagging import regulatory_label
from renown.plans.oracle_fixtures import arr, py_strip, q


def lower_nn(t: str) -> str:
    return f"lower(coalesce({t}, ''))"


def any_contains(t: str, needles) -> str:
    lt = lower_nn(t)
    return "(" + " OR ".join(f"contains({lt}, {q(n)})" for n in needles) + ")"


def regulatory_sql(t: str) -> str:
    lt = lower_nn(t)
    items = ", ".join(f"CASE WHEN contains({lt}, {q(b)}) THEN {q(regulatory_label(b))} END" for b in lx.REGULATORY_BODIES)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def crisis_sql(t: str) -> str:
    cats = ", ".join(f"CASE WHEN {any_contains(t, pats)} THEN {q(cat)} END" for cat, pats in lx.CRISIS_PATTERNS)
    reg = regulatory_sql(t)
    reg_tag = f"CASE WHEN len({reg}) > 0 THEN {q(lx.REGULATORY_FLAG_PREFIX)} || array_to_string({reg}, ', ') END"
    return f"list_sort(list_distinct(list_filter([{cats}, {reg_tag}], lambda x: x IS NOT NULL)))"


def geo_sql(text: str, url: str) -> str:
    host = f"lower(coalesce(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), ''))"
    return f"(ends_with({host}, {q(lx.GEO_DOMAIN_SUFFIX)}) OR {any_contains(text, lx.GEO_KEYWORDS)})"


def analyzable_sql(t: str) -> str:
    return f"({t} IS NOT NULL AND length({py_strip(t)}) >= 10)"


def join_arr(x: str, sep: str = "|") -> str:
    return f"array_to_string(coalesce({x}, []), {q(sep)})"


def quote_sql(t: str) -> str:
    return f"CASE WHEN length(coalesce({t}, '')) > 200 THEN substring({t}, 1, 200) || '...' ELSE coalesce({t}, '') END"


def avg_rating_sql(x: str) -> str:
    a = f"avg(CAST({x} AS DOUBLE))"
    return f"CASE WHEN {a} IS NULL OR {a} = 0 THEN NULL ELSE CAST(printf('%.1f', {a}) AS DOUBLE) END"


ALIAS_KEYS = [a for a, _ in lx.COMPANY_ALIASES]


def title_sql(x: str) -> str:
    parts = f"regexp_extract_all(lower({x}), '(\\p{{L}}+|[^\\p{{L}}]+)')"
    return f"array_to_string(list_transform({parts}, lambda p: upper(substring(p, 1, 1)) || substring(p, 2)), '')"


__all__ = ["arr", "q", "py_strip"]
