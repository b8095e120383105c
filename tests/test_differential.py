"""Spark expressions against small Python readings of the same rules on generated texts."""

import json
import random
import re

from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st

from evalflow.functions import dialect, sql_text, verdict

PIECES = [
    "```", "```sql", "```json", "``", "SELECT", "select a", ";", "\n", " ", "\xa0", "\r\n", "칼럼", "é", "_",
    "yes", "no", "Yes", "know", "resolve_yn", "'resolve_yn': 'no'", '"resolve_yn":"yes"', ":", "'", '{"resolve_yn": "No "}',
    '{"gen_sql": "X"}', "{", "}", "text", "1", "ſelect", "none", "\t", "½", "\u0301", "\x1c", "𝒳",
]


def fences(text):
    parts = text.split("```")
    return [parts[i].strip() for i in range(1, len(parts) - 1, 2)]


def load(text):
    try:
        value = json.loads(text)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def is_word(c):
    return c.isalnum() or c == "_"


def python_sql(text):
    at = text.find("```sql")
    if at >= 0 and "```" in text[at + 6 :]:
        return text[at + 6 :].split("```")[0].strip()
    blocks = fences(text)
    if blocks:
        return max(blocks, key=len)
    for m in re.finditer("select", text, re.IGNORECASE):
        before, after = text[: m.start()][-1:], text[m.end() :]
        if after and not (before and is_word(before)) and not is_word(after[0]):
            semicolon = after.find(";", 1)
            end = len(after) if semicolon < 0 else semicolon + 1
            return (m.group() + after[:end]).strip()
    value = load(text)
    return value["gen_sql"] if value and "gen_sql" in value else ""


def has_word(text, word):
    for m in re.finditer(word, text, re.IGNORECASE):
        edges = text[: m.start()][-1:] + text[m.end() :][:1]
        if not any(is_word(c) for c in edges):
            return True
    return False


def python_verdict(text):
    parts = text.split("```", 2)
    body = text
    if len(parts) == 3:
        body = parts[1].removeprefix("json").strip()
    value = load(body)
    if value and "resolve_yn" in value:
        return value["resolve_yn"].lower().strip()
    quoted = re.findall(r"""['"]resolve_yn['"]:\s*['"](yes|no)['"]""", body, re.IGNORECASE)
    if quoted:
        return "yes" if any(q.lower() == "yes" for q in quoted) else "no"
    loose = re.search(r"""resolve_yn\s*:?\s*['"]?(yes|no)""", body, re.IGNORECASE)
    if loose:
        return loose.group(1).lower()
    return "yes" if has_word(body, "yes") else "no" if has_word(body, "no") else "unknown"


def random_texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_many_texts(evaluate):
    texts = random_texts(7, 4000)
    for got, text in zip(evaluate(texts, sql_text.extract_sql), texts, strict=True):
        assert got == python_sql(text), repr(text)
    for got, text in zip(evaluate(texts, verdict.strict_verdict), texts, strict=True):
        assert got == python_verdict(text), repr(text)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck), phases=[Phase.generate])
@given(st.lists(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=3)), max_size=8).map("".join), min_size=60, max_size=60))
def test_generated_texts(evaluate, texts):
    # A surrogate or NUL cannot be held by a Spark string column.
    texts = [t.encode("utf-8", "ignore").decode().replace("\x00", "") for t in texts]
    assert evaluate(texts, sql_text.extract_sql) == [python_sql(t) for t in texts]
    assert evaluate(texts, verdict.strict_verdict) == [python_verdict(t) for t in texts]


DIALECT_PIECES = [
    "limit 5 , 10", "ifnull", "(", ")", "`칼럼`", "`", "offset 3", "RETURNING", "é", "½", "_", " ", "\xa0", "'", "::text", "array", "[",
    "]", "pragma", "rowid", "insert or ignore", "top 5", "isnull", "@@", "x", "rownum", "from dual", "minus", "nvl", "decode", ",",
    "number", "1", "\n", "serial", "identity", "𝒳", "\u0301",
]


def test_dialects(evaluate):
    rng = random.Random(11)
    texts = ["".join(rng.choice(DIALECT_PIECES) for _ in range(rng.randint(0, 10))) for _ in range(4000)]
    for got, text in zip(evaluate(texts, dialect.pattern_dialects), texts, strict=True):
        want = [n for n, patterns in sorted(dialect.DIALECT_PATTERNS.items()) if any(re.search(p, text.lower()) for p in patterns)]
        assert got == want, repr(text)
