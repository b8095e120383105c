"""Expressions against hand-derived rows."""

import pytest
from pyspark.sql import functions as F

from evalflow.functions import dialect, errors, latency, naming, responses, sql_text, text, verdict


def check(evaluate, expression, cases):
    got = evaluate([c[0] for c in cases], expression)
    assert got == [c[1] for c in cases]


def test_strip(evaluate):
    check(evaluate, text.strip, [(" \t a b　\x1c\n", "a b"), ("", ""), ("\xa0", ""), (None, None)])


def test_json_object_is_strict(evaluate):
    cases = [
        ('{"a": 1}', "1"),
        (' \n{"a": 1} \n', "1"),
        ('{"a": 1} tail', None),
        ('{"a": 1}] tail', None),
        ('{"a": 1}, {"a": 2}', None),
        ('{"a": 1', None),
        ("[1]", None),
        ("", None),
        (None, None),
        ('{"a": true}', "true"),
        ('{"a": null}', None),
        ('{"b": 1}', None),
        ('{"a": "x]}\\" y"}', 'x]}" y'),
    ]
    check(evaluate, lambda c: text.json_field(c, "a"), cases)


def test_extract_sql(evaluate):
    cases = [
        ("x ```sql\nSELECT 1;\n``` y", "SELECT 1;"),
        ("```a``` ```bbb```", "bbb"),
        ("```aaa``` ```bbb```", "aaa"),
        ("```SQL\nSELECT 2\n```", "SQL\nSELECT 2"),
        ("so select a from b; tail", "select a from b;"),
        ("select a\nfrom b", "select a\nfrom b"),
        ("SELECT;x;", "SELECT;x;"),
        ("SELECT", ""),
        ("preselect a", ""),
        ("selected SELECT a; b", "SELECT a;"),
        ('{"gen_sql": "SELECT 1"}', 'SELECT 1"}'),
        ('{"gen_sql": "VALUES (1)"}', "VALUES (1)"),
        ("nothing here", ""),
        ("```sql\n``` SELECT 1;", ""),
        ("``` open SELECT 1", "SELECT 1"),
        ("에서SELECT x;", ""),
        ("에서 SELECT 칼럼;", "SELECT 칼럼;"),
        ("", ""),
        (None, None),
    ]
    check(evaluate, sql_text.extract_sql, cases)


def test_generated_sql(evaluate):
    cases = [
        ('{"gen_sql": "SELECT 1"}', ("SELECT 1", None, None, "ok")),
        ('{"gen_sql": "S", "reasoning": "r", "description": "d"}', ("S", "r", "d", "ok")),
        ("nothing here", (None, None, None, "rejected")),
        ("```sql SELECT 1```", ("SELECT 1", None, None, "ok")),
        ("", (None, None, None, "empty")),
        (None, (None, None, None, "empty")),
    ]
    check(evaluate, sql_text.generated_sql, cases)


def test_strict_verdict(evaluate):
    cases = [
        ('{"resolve_yn": " YES "}', "yes"),
        ('```json\n{"resolve_yn":"no"}\n```', "no"),
        ('```\n{"resolve_yn":"maybe"}\n``` yes', "maybe"),
        ("{'resolve_yn': 'yes'}", "yes"),
        ("{'resolve_yn': 'no'} and \"resolve_yn\": \"yes\"", "yes"),
        ("resolve_yn: no", "no"),
        ("resolve_yn  'yes", "yes"),
        ("no, well yes", "yes"),
        ("I know", "unknown"),
        ("No.", "no"),
        ("예yes", "unknown"),
        ("", "unknown"),
        (None, None),
    ]
    check(evaluate, verdict.strict_verdict, cases)


def test_lenient_verdict(evaluate):
    cases = [("I know", "no"), ("yesterday no", "yes"), ('{"resolve_yn": "No"}', "no"), ("RESOLVE_YN = no, resolve_yn: yes", "yes"), ("x", "unknown")]
    check(evaluate, verdict.lenient_verdict, cases)


def test_normalized_verdict(evaluate):
    cases = [
        ("Yes, same", "yes"),
        ("not sure", "no"),
        ("none", "no"),
        ("maybe", "maybe"),
        (" UNKNOWN ", "unknown"),
        (" yes, but", " yes, but"),
        ("x 'resolve_yn': 'no'", "no"),
        ('{"resolve_yn":"YES"}', "yes"),
        (None, None),
    ]
    check(evaluate, verdict.normalized_verdict, cases)


def test_response_content(evaluate):
    cases = [
        ('{"choices":[{"message":{"content":"a"}}],"response":"b"}', "a"),
        ('{"choices":[],"response":"b"}', "b"),
        ('{"message":{"content":"c"}}', "c"),
        ('{"error":"x"}', None),
        ("no json", None),
    ]
    check(evaluate, responses.response_content, cases)


def test_recovered_prompt(evaluate):
    cases = [
        ('{"prompt": "p"}', "p"),
        ('{"request": {"prompt": "q"}}', "q"),
        ("{'prompt': 'it\\'s', 'stream': False, 'format': None}", "it's"),
        ("{'request': {'prompt': \"x\"}}", "x"),
        ("{'model': 'm'}", None),
        ('{"model": "m"}', None),
        ("plain text", "plain text"),
        ("{broken", "{broken"),
        (None, None),
    ]
    check(evaluate, responses.recovered_prompt, cases)


def test_plain_python_literals_are_read_without_python(evaluate, spark):
    cases = [
        ("{'prompt': 'it\\'s \"so\"', 'stream': False, 'format': None, 'n': [1, -2.5e3, {'a': True}]}", "it's \"so\""),
        ("{'request': {'prompt': \"x\\\\\\n'y'\"}}", "x\\\n'y'"),
        ("{'model': 'm', 'prompt': None}", None),
        (" {'prompt': 'Straße \U0001f600 \ttab'}", None),
    ]
    cases[3] = (cases[3][0].replace("\t", " "), "Straße \U0001f600  tab")
    check(evaluate, lambda c: responses.recovered_prompt(c, fallback=False), cases)
    # Left to Python: tuples, other escapes, trailing commas, numbers as prompts, joined strings, repeated keys.
    left = ["{'prompt': ('a',)}", "{'prompt': '\\x41'}", "{'prompt': 'a',}", "{'prompt': 1.0}", "{'prompt': 'a' 'b'}", "{'prompt': 'a', 'prompt': 'b'}"]
    assert evaluate(left, lambda c: responses.recovered_prompt(c, fallback=False)) == left
    assert evaluate(left, responses.recovered_prompt) == ["('a',)", "A", "a", "1.0", "ab", "b"]
    plan = spark.range(1).select(responses.recovered_prompt(F.col("id").cast("string"), fallback=False))._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan


def test_literals_are_read_as_python_reads_them(evaluate):
    import random

    rng = random.Random(6)
    pieces = ["a", "'", '"', "\\", "\n", "\t", "é", "\U0001f600", "{", "}", ":", ", ", "None", "\x00", "\x7f", "\u2028", "x" * 50]

    def value(depth):
        kind = rng.randrange(7 if depth else 4)
        if kind < 3:
            return "".join(rng.choice(pieces) for _ in range(rng.randrange(6)))
        if kind == 3:
            return rng.choice([True, False, None, 0, -7, 1.5, 1e30, 10**25])
        if kind == 4:
            return [value(depth - 1) for _ in range(rng.randrange(3))]
        return {rng.choice(["prompt", "request", "a", "b"]): value(depth - 1) for _ in range(rng.randrange(4))}

    texts = [repr({"prompt" if rng.random() < 0.7 else "request": value(3), "k": value(2)}) for _ in range(400)]
    texts += [t[: rng.randrange(len(t))] + rng.choice(["", "'", "}", "\\"]) + t[rng.randrange(len(t)) :] for t in texts[:150]]

    def wanted(text):
        found = responses._python_literal_prompts([text]).iloc[0]
        return found["prompt"] if found["parsed"] else text

    import json

    def is_json(text):
        try:
            json.loads(text)
            return True
        except ValueError:
            return False

    texts = [t for t in texts if not is_json(t)]
    assert evaluate(texts, responses.recovered_prompt) == [wanted(t) for t in texts]


def test_translation(evaluate):
    got = evaluate(['{"question": "q", "sql_query": "s"}', '{"question": "q"}', "text"], responses.translation)
    assert got == [("q", "s"), ("q", ""), (None, None)]
    assert evaluate(["text"], lambda c: responses.translation(c, compat=True)) == [("", "")]


def test_processors():
    assert responses.processor_for("evaluation") is verdict.strict_verdict
    assert responses.processor_for("anything") is responses.processor_for("generate")


def test_response_latency(spark):
    full = '{"total_duration": 2000000000, "eval_duration": 1500000000, "prompt_eval_duration": 100000000, "eval_count": 10}'
    cases = [
        (full, (0.1, 0.5, 2.0, 10, 5.0)),
        ('{"total_duration": 1999999999, "eval_duration": 1, "eval_count": 7}', (None, 1.999999, 1.999999, 7, 3.5)),
        ('{"eval_count": 10}', (None, None, 3.0, 10, 3.33)),
        ('{"error": "x", "eval_count": 10}', (None, None, 3.0, None, None)),
        ("bad", (None, None, 3.0, None, None)),
    ]
    df = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(cases)], "i int, text string")
    rows = latency.with_response_latency(df, F.col("text"), F.lit(3.0)).orderBy("i").collect()
    assert [tuple(r)[2:] for r in rows] == [want for _, want in cases]


def test_text_latency(evaluate):
    cases = [
        ("load 1500ms first token 20ms eval count:  7 token(s) eval count: 12 token(s)", (1.5, 0.02, 2.0, 12, 6.0)),
        ("loaded m in 250.5ms\nfirst token in 10ms\ngenerated 3 tokens", (0.2505, 0.01, 2.0, 3, 1.5)),
        ("eval 4 tokens", (None, None, 2.0, 4, 2.0)),
        ("", (None, None, 2.0, None, None)),
    ]
    check(evaluate, lambda c: latency.text_latency(c, F.lit(2.0)), cases)


def test_resource_sample(evaluate):
    cases = [("12.5%,300.1MiB / 2GiB", (12.5, 300.1)), ("0%,1.2GiB", (0.0, None)), ("x", (None, None))]
    check(evaluate, latency.resource_sample, cases)


def test_pattern_dialects(evaluate):
    cases = [
        ("SELECT * FROM t LIMIT 5, 10", ["MySQL"]),
        ("SELECT x FROM dual WHERE ROWNUM < 5", ["Oracle"]),
        ("SELECT [a] FROM t WHERE b ILIKE 'x'", ["PostgreSQL", "SQL Server"]),
        ("select `칼럼`", ["MySQL"]),
        ("select 'x'::text", ["PostgreSQL"]),
        ("insert or ignore into t", ["SQLite"]),
        ("identity (1, 1)", ["SQL Server"]),
        ("a MINUS b", ["Oracle"]),
        ("select 1", []),
        (None, None),
    ]
    check(evaluate, dialect.pattern_dialects, cases)


@pytest.mark.parametrize(
    "patterns, parsed, want",
    [
        (["MySQL"], ["MySQL", "SQLite"], ["MySQL"]),
        (["MySQL"], ["Oracle"], ["MySQL", "Oracle"]),
        ([], [], []),
        ([], ["SQLite", "MySQL"], ["MySQL", "SQLite"]),
        (["Oracle"], [], ["Oracle"]),
    ],
)
def test_combined_dialects(spark, patterns, parsed, want):
    df = spark.createDataFrame([(patterns, parsed)], "a array<string>, b array<string>")
    assert df.select(dialect.combined_dialects(F.col("a"), F.col("b"))).first()[0] == want


def test_dialect_label(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a", "b"],), (["a"],), ([],)], "d array<string>")
    assert [r[0] for r in df.select(dialect.dialect_label(F.col("d"))).collect()] == ["General DBMS", "a", "a", None]
    assert [r[0] for r in df.select(dialect.dialect_label(F.col("d"), compat=True)).collect()] == ["General DBMS", "a", None, None]


def test_dialect_hint(evaluate):
    got = evaluate(["ORACLE", "General DBMS", None], dialect.dialect_hint)
    assert "FETCH FIRST" in got[0] and got[1:] == ["", ""]


def test_safe_name(evaluate):
    cases = [("a/b:c:test.m:7b", "a_b-c-test.m-7b"), ("nul", "_nul"), ("", "_"), ("x. .", "x"), ("COM10", "COM10"), ('<>"\\|?*', "_______")]
    check(evaluate, naming.safe_name, cases)


def test_model_size(evaluate):
    check(evaluate, naming.model_size, [("gemma3:27b", "27-30B"), ("qwen2.5-coder:7b", "7B"), ("m:1.7b", "Unknown"), ("x", "Unknown")])
    check(evaluate, lambda c: naming.model_size(c, compat=True), [("gemma3:27b", "7B"), ("phi4:14b", "13-14B")])


def test_provider_kind(evaluate):
    check(evaluate, naming.provider_kind, [("GPT-4o", "chat"), ("o1-mini", "chat"), ("O3", "chat"), ("qwq", "prompt")])


def test_endpoint_kind(evaluate):
    cases = [
        ("https://h/openai/deployments/d/chat/completions?x=1", "chat/completions"),
        ("https://api.x.com/v1/embeddings", "embeddings"),
        ("http://localhost:11434/api/generate", "generate"),
        ("http://localhost/api/generate", None),
    ]
    check(evaluate, naming.endpoint_kind, cases)


def test_error_class(evaluate):
    cases = [("Rate limit reached", "rate_limit"), ("x rate_limit_y", "rate_limit"), ("timeout", "other"), (None, None)]
    check(evaluate, errors.error_class, cases)
    api = lambda c: errors.error_class(F.lit(None).cast("string"), c)
    check(evaluate, api, [("RATE LIMIT", "rate_limit"), ("bad", "api"), (None, None)])
