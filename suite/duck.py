"""DuckDB expressions the SQL counterparts share. They follow the rules, not the Spark code."""

from __future__ import annotations

from evalflow.functions.text import WHITESPACE

_WS = "'" + WHITESPACE + "'"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {_WS})"


def json_text(x: str, field: str) -> str:
    return f"CASE WHEN json_valid({x}) THEN json_extract_string({x}, '$.{field}') END"


def extract_sql(x: str) -> str:
    longest = (
        f"list_reduce(list_transform(regexp_extract_all({x}, '(?s)```\\s*(.*?)\\s*```', 1), lambda b: {strip('b')}), "
        "lambda p, q: CASE WHEN length(q) > length(p) THEN q ELSE p END)"
    )
    select = "'(?is)\\bSELECT\\b.+?(?:;|$)'"
    return f"""CASE
        WHEN regexp_matches({x}, '(?s)```sql\\s*(.*?)\\s*```')
          THEN {strip(f"regexp_extract({x}, '(?s)```sql\\s*(.*?)\\s*```', 1)")}
        WHEN regexp_matches({x}, '(?s)```\\s*(.*?)\\s*```') THEN {longest}
        WHEN regexp_matches({x}, {select}) THEN {strip(f"regexp_extract({x}, {select})")}
        ELSE coalesce({json_text(x, "gen_sql")}, '') END"""


def word(x: str, w: str) -> str:
    edge = r"[^\p{L}\p{N}_]"
    return f"regexp_matches({x}, '(?i)(?:^|{edge}){w}(?:$|{edge})')"


_KEY = "'(?i)resolve_yn\\s*:?\\s*[''\"]?(yes|no)[''\"]?'"


def body(x: str) -> str:
    fence = "'(?s)```(?:json)?\\s*(.*?)\\s*```'"
    return f"CASE WHEN regexp_matches({x}, {fence}) THEN regexp_extract({x}, {fence}, 1) ELSE {x} END"


def strict_verdict(b: str) -> str:
    """Verdict of an unfenced text column."""
    return f"""CASE
        WHEN {json_text(b, "resolve_yn")} IS NOT NULL THEN trim(lower({json_text(b, "resolve_yn")}))
        WHEN regexp_matches({b}, '(?i)[''"]resolve_yn[''"]:\\s*[''"]yes[''"]') THEN 'yes'
        WHEN regexp_matches({b}, '(?i)[''"]resolve_yn[''"]:\\s*[''"]no[''"]') THEN 'no'
        WHEN regexp_matches({b}, {_KEY}) THEN lower(regexp_extract({b}, {_KEY}, 1))
        WHEN {word(b, "yes")} THEN 'yes'
        WHEN {word(b, "no")} THEN 'no'
        ELSE 'unknown' END"""


def lenient_verdict(c: str) -> str:
    return f"""CASE
        WHEN {json_text(c, "resolve_yn")} IS NOT NULL THEN trim(lower({json_text(c, "resolve_yn")}))
        WHEN regexp_matches({c}, {_KEY}) THEN lower(regexp_extract({c}, {_KEY}, 1))
        WHEN contains(lower({c}), 'yes') THEN 'yes'
        WHEN contains(lower({c}), 'no') THEN 'no'
        ELSE 'unknown' END"""


def normalized_verdict(v: str) -> str:
    return f"""CASE
        WHEN {strip(f"lower({v})")} IN ('yes', 'no', 'unknown') THEN {strip(f"lower({v})")}
        WHEN starts_with(lower({v}), 'yes') THEN 'yes'
        WHEN starts_with(lower({v}), 'no') THEN 'no'
        WHEN contains({v}, '''resolve_yn'': ''yes''') OR contains({v}, '"resolve_yn": "yes"') THEN 'yes'
        WHEN contains({v}, '''resolve_yn'': ''no''') OR contains({v}, '"resolve_yn": "no"') THEN 'no'
        WHEN {json_text(v, "resolve_yn")} IS NOT NULL THEN {strip(f"lower({json_text(v, 'resolve_yn')})")}
        ELSE {v} END"""


def fill(template: str, **slots: str) -> str:
    """A template with SQL expressions in its slots."""
    import string

    parts = []
    for text, slot, _, _ in string.Formatter().parse(template):
        if text:
            parts.append(lit(text))
        if slot in slots:
            parts.append(f"coalesce({slots[slot]}, '')")
    return " || ".join(parts)


def seconds(start: str, end: str) -> str:
    return f"((epoch_us({end}) - epoch_us({start})) / 1e6)"


def percent(part: str, whole: str) -> str:
    return f"coalesce(CAST({part} AS DOUBLE) * 100 / nullif({whole}, 0), 0)"


def ratio(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0)"
