"""Extraction from free text, dialects, names and prompt parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalflow.functions import responses as R
from evalflow.functions.dialect import DIALECT_HINTS, DIALECT_PATTERNS, dialect_hint, dialect_label, pattern_dialects
from evalflow.functions.latency import resource_sample, text_latency, with_response_latency
from evalflow.functions.naming import artifact_key, endpoint_kind, model_size, provider_kind, safe_name
from evalflow.functions.sql_text import extract_sql, extract_sql_without_json, generated_sql
from evalflow.functions.text import strip
from evalflow.functions.verdict import normalized_verdict
from evalflow.operators.outcomes import parse_counts, transform_counts, verdict_distribution, verdict_summary, with_lenient_verdict, with_verdict
from evalflow.operators.shape import (
    QUESTION_METADATA,
    PromptHandler,
    parse_prompts,
    skipped_prompts,
    tag_dialects,
    transform_and_tag,
    transform_prompts,
    untagged_rows,
    with_dialect_class,
    with_dialects,
)
from evalflow.plans.flows import transform_flow
from evalflow.staging import stage_path
from suite import duck
from suite.registry import query
from suite.views import view


@query("extract_sql", f"SELECT task_id, {duck.extract_sql('content')} AS gen_sql FROM {{responses}} v")
def _(spark, sf):
    return view(spark, sf, "responses").select("task_id", extract_sql(F.col("content")).alias("gen_sql"))


@query(
    "extract_sql_without_json",
    f"""SELECT task_id, CASE WHEN starts_with(content, '{{"gen_sql": "VALUES') THEN ''
        ELSE {duck.extract_sql('content')} END AS gen_sql FROM {{responses}} v""",
)
def _(spark, sf):
    return view(spark, sf, "responses").select("task_id", extract_sql_without_json(F.col("content")).alias("gen_sql"))


_GENERATED = f"""
    SELECT task_id, model, content, reasoning, description,
           CASE WHEN json_sql IS NOT NULL THEN json_sql WHEN found <> '' THEN found END AS gen_sql,
           CASE WHEN content = '' THEN 'empty' WHEN json_sql IS NULL AND found = '' THEN 'rejected' ELSE 'ok' END AS parse_status
    FROM (SELECT task_id, model, content, {duck.extract_sql('content')} AS found,
                 {duck.json_text('content', 'gen_sql')} AS json_sql,
                 {duck.json_text('content', 'reasoning')} AS reasoning,
                 {duck.json_text('content', 'description')} AS description
          FROM {{responses}} v) w"""


def _generated(spark, sf):
    return view(spark, sf, "responses").select("task_id", "model", generated_sql(F.col("content")).alias("g")).select(
        "task_id", "model", "g.*"
    )


@query("generated_sql", f"SELECT task_id, model, gen_sql, reasoning, description, parse_status FROM ({_GENERATED}) g")
def _(spark, sf):
    return _generated(spark, sf)


@query(
    "generated_sql_status",
    f"""SELECT model, CAST(count(*) FILTER (parse_status = 'ok') AS BIGINT) AS success_count,
        CAST(count(*) FILTER (parse_status <> 'ok') AS BIGINT) AS error_count FROM ({_GENERATED}) g GROUP BY model""",
)
def _(spark, sf):
    return parse_counts(_generated(spark, sf), ["model"])


_STRICT = f"""SELECT task_id, model, content, body, {duck.strict_verdict('body')} AS resolve_yn
    FROM (SELECT task_id, model, content, {duck.body('content')} AS body FROM {{verdicts}} v) w"""


@query("verdict_strict", f"SELECT task_id, resolve_yn FROM ({_STRICT}) s")
def _(spark, sf):
    return with_verdict(view(spark, sf, "verdicts")).select("task_id", "resolve_yn")


@query("verdict_lenient", f"SELECT task_id, {duck.lenient_verdict('content')} AS resolve_yn FROM {{verdicts}} v")
def _(spark, sf):
    return with_lenient_verdict(view(spark, sf, "verdicts")).select("task_id", "resolve_yn")


@query("verdict_normalized", f"SELECT task_id, {duck.normalized_verdict('content')} AS resolve_yn FROM {{verdicts}} v")
def _(spark, sf):
    return view(spark, sf, "verdicts").select("task_id", normalized_verdict(F.col("content")).alias("resolve_yn"))


@query(
    "verdict_distribution",
    f"""SELECT model, resolve_yn, CAST(count(*) AS BIGINT) AS n
        FROM (SELECT model, {duck.normalized_verdict('resolve_yn')} AS resolve_yn FROM ({_STRICT}) s) t
        GROUP BY model, resolve_yn""",
)
def _(spark, sf):
    read = with_verdict(view(spark, sf, "verdicts"))
    return verdict_distribution(read.withColumn("resolve_yn", normalized_verdict(F.col("resolve_yn"))), ["model"])


@query(
    "verdict_summary",
    f"""SELECT model, CAST(count(*) FILTER (resolve_yn = 'yes') AS BIGINT) AS yes, CAST(count(*) FILTER (resolve_yn = 'no') AS BIGINT) AS no,
        CAST(count(*) FILTER (resolve_yn NOT IN ('yes', 'no')) AS BIGINT) AS other FROM ({_STRICT}) s GROUP BY model""",
)
def _(spark, sf):
    return verdict_summary(with_verdict(view(spark, sf, "verdicts")), ["model"])


# --- responses in both provider shapes ---------------------------------------------------------


def _provider_responses(spark, sf):
    """The free-text answers wrapped like saved model responses."""
    chat = F.struct(F.array(F.struct(F.struct(F.col("content").alias("content")).alias("message"))).alias("choices"))
    plain = F.struct(F.col("content").alias("response"))
    bare = F.struct(F.struct(F.col("content").alias("content")).alias("message"))
    broken = F.concat(F.lit("HTTP 502 "), F.col("content"))
    response = (
        F.when(F.col("task_id") % 4 == 0, F.to_json(chat))
        .when(F.col("task_id") % 4 == 1, F.to_json(plain))
        .when(F.col("task_id") % 4 == 2, F.to_json(bare))
        .otherwise(broken)
    )
    return view(spark, sf, "responses").withColumn("response", response)


@query(
    "content_from_responses",
    "SELECT task_id, CASE WHEN task_id % 4 < 3 THEN content END AS content FROM {responses} v",
)
def _(spark, sf):
    return _provider_responses(spark, sf).select("task_id", R.response_content(F.col("response")).alias("content"))


@query(
    "processor_by_mode",
    f"""SELECT task_id, CASE WHEN json_sql IS NOT NULL THEN json_sql WHEN found <> '' THEN found END AS generate,
        {duck.strict_verdict('body')} AS evaluation, {duck.strip('content')} AS translate
        FROM (SELECT task_id, content, {duck.body('content')} AS body, {duck.extract_sql('content')} AS found,
              {duck.json_text('content', 'gen_sql')} AS json_sql FROM {{responses}} v) w""",
)
def _(spark, sf):
    content = F.col("content")
    return view(spark, sf, "responses").select(
        "task_id", *[R.processor_for(mode)(content).alias(mode) for mode in ("generate", "evaluation", "translate")]
    )


@query(
    "translation_fields",
    """SELECT task_id, CASE WHEN task_id % 3 = 0 THEN question WHEN task_id % 3 = 1 THEN '' END AS e_question,
       CASE WHEN task_id % 3 < 2 THEN 'SELECT ' || task_id END AS e_answer FROM {qa} v""",
)
def _(spark, sf):
    whole = F.to_json(F.struct("question", F.concat(F.lit("SELECT "), F.col("task_id")).alias("sql_query")))
    partial = F.to_json(F.struct(F.concat(F.lit("SELECT "), F.col("task_id")).alias("sql_query")))
    content = F.when(F.col("task_id") % 3 == 0, whole).when(F.col("task_id") % 3 == 1, partial).otherwise(F.col("question"))
    return view(spark, sf, "qa").select("task_id", R.translation(content).alias("t")).select("task_id", "t.*")


@query(
    "prompt_recovery",
    """SELECT task_id, CASE WHEN task_id % 5 = 3 THEN NULL ELSE question END AS prompt, question AS field,
       CASE WHEN task_id % 5 = 4 THEN question ELSE '{}' END AS passed FROM {qa} v""",
)
def _(spark, sf):
    qa = view(spark, sf, "qa")
    prompt = F.col("question").alias("prompt")
    quoted = F.concat(
        F.lit("{'model': 'm', 'stream': False, 'prompt': '"),
        F.replace(F.replace("question", F.lit("'"), F.lit("\\'")), F.lit("\n"), F.lit("\\n")),
        F.lit("', 'format': None}"),
    )
    nested = F.to_json(F.struct(F.struct(prompt).alias("request"), F.lit(1).alias("task_id")))
    text = (
        F.when(F.col("task_id") % 5 == 0, F.to_json(F.struct(F.lit("m").alias("model"), prompt)))
        .when(F.col("task_id") % 5 == 1, nested)
        .when(F.col("task_id") % 5 == 2, quoted)
        .when(F.col("task_id") % 5 == 3, F.lit('{"model": "m"}'))
        .otherwise(F.col("question"))
    )
    result = F.to_json(F.struct(F.col("question").alias("gen_sql")))
    plain = F.when(F.col("task_id") % 5 == 4, F.col("question")).otherwise(F.lit("{}"))
    return qa.select(
        "task_id",
        R.recovered_prompt(text).alias("prompt"),
        R.output_field(result, "gen_sql").alias("field"),
        R.output_field(plain, "gen_sql").alias("passed"),
    )


# --- latency -----------------------------------------------------------------------------------

_NANOS = """SELECT event_id, value, CAST(floor(value * 1000) AS BIGINT) * 1000000 + event_id AS total,
    CAST(floor(value * 10) AS BIGINT) * 1234567 AS load, CAST(floor(value * 500) AS BIGINT) * 1000000 AS eval,
    CAST(floor(value) AS BIGINT) AS n FROM {events}"""


@query(
    "latency_fields",
    f"""SELECT event_id, CASE WHEN usable AND load <> 0 THEN (load // 1000) / 1e6 END AS load_s,
          CASE WHEN timed THEN ((total - eval) // 1000) / 1e6 END AS first_token_s, micros / 1e6 AS total_s,
          CASE WHEN usable THEN n END AS tokens,
          CASE WHEN usable AND n <> 0 AND micros > 0 THEN (n * 100000000 // micros) / 100.0::DOUBLE END AS tokens_per_s
        FROM (SELECT *, CASE WHEN timed THEN total // 1000 ELSE CAST(round((value + 1) * 1e6) AS BIGINT) END AS micros
          FROM (SELECT *, event_id % 11 > 1 AS usable, event_id % 11 > 1 AND total <> 0 AND eval <> 0 AS timed FROM ({_NANOS}) a) b) c""",
)
def _(spark, sf):
    value = F.col("value")
    body = F.struct(
        F.lit("done").alias("response"),
        (F.floor(value * 1000).cast("bigint") * 1000000 + F.col("event_id")).alias("total_duration"),
        (F.floor(value * 10).cast("bigint") * 1234567).alias("prompt_eval_duration"),
        (F.floor(value * 500).cast("bigint") * 1000000).alias("eval_duration"),
        F.floor(value).cast("bigint").alias("eval_count"),
    )
    text = (
        F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("{bad "), F.col("props")))
        .when(F.col("event_id") % 11 == 1, F.to_json(F.struct(F.col("props").alias("error"))))
        .otherwise(F.to_json(body))
    )
    events = spark.read.parquet(f"{sf}/events.parquet")
    return with_response_latency(events, text, value + 1).select("event_id", "load_s", "first_token_s", "total_s", "tokens", "tokens_per_s")


def _verbose_text():
    """Verbose run texts in several wordings."""
    ms = F.floor(F.col("value") * 100).cast("string")
    n = F.floor("value").cast("string")
    return (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("load "), ms, F.lit("ms\nfirst token "), ms, F.lit("ms\neval count:  "), n, F.lit(" token(s)\neval count: 3 token(s)")))
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit("loaded model x in "), ms, F.lit("ms\nfirst token in "), ms, F.lit("ms\ngenerated "), n, F.lit(" tokens")))
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit("eval "), n, F.lit(" tokens, props "), F.col("props")))
        .otherwise(F.col("props"))
    )


@query(
    "latency_from_text",
    """SELECT event_id, CASE WHEN event_id % 4 < 2 THEN floor(value * 100) / 1000 END AS load_s,
         CASE WHEN event_id % 4 < 2 THEN floor(value * 100) / 1000 END AS first_token_s, value + 1 AS total_s, n AS tokens,
         CASE WHEN n <> 0 THEN (n * 100000000 // CAST(round((value + 1) * 1e6) AS BIGINT)) / 100.0::DOUBLE END AS tokens_per_s
       FROM (SELECT event_id, value, CASE event_id % 4 WHEN 0 THEN greatest(CAST(floor(value) AS BIGINT), 3) WHEN 3 THEN NULL
             ELSE CAST(floor(value) AS BIGINT) END AS n FROM {events}) x""",
)
def _(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    return events.select("event_id", text_latency(_verbose_text(), F.col("value") + 1).alias("l")).select("event_id", "l.*")


@query(
    "resource_samples",
    """SELECT event_id, floor(value) / 2 AS cpu_pct, CASE WHEN event_id % 3 < 2 THEN CAST(event_id AS DOUBLE) END AS mem_mib
       FROM {events}""",
)
def _(spark, sf):
    unit = F.when(F.col("event_id") % 3 == 2, "GiB").otherwise("MiB")
    line = F.concat((F.floor("value") / 2).cast("string"), F.lit("%,"), F.col("event_id").cast("string"), unit, F.lit(" / 8GiB"))
    events = spark.read.parquet(f"{sf}/events.parquet")
    return events.select("event_id", resource_sample(line).alias("r")).select("event_id", "r.*")


@query(
    "model_catalogue",
    "SELECT event_id, unnest(['model-' || user_id, event_type]) AS model FROM {events}",
)
def _(spark, sf):
    name = F.concat(F.lit("model-"), F.col("user_id"))
    listed = F.array(F.struct(name.alias("name")), F.struct(F.col("event_type").alias("name")))
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.to_json(F.struct(listed.alias("models"))).alias("body"))
    return events.select("event_id", F.explode(R.catalogue_models(F.col("body"))).alias("model"))


# --- dialects ----------------------------------------------------------------------------------

_HITS = "list_filter([%s], lambda d: d IS NOT NULL)" % ", ".join(
    "CASE WHEN " + " OR ".join(f"regexp_matches(lower(sql), {duck.lit(p)})" for p in patterns) + f" THEN {duck.lit(name)} END"
    for name, patterns in sorted(DIALECT_PATTERNS.items())
)
_TAGGED = f"""SELECT *, list_sort(CASE WHEN len(list_intersect(found, parsed)) > 0 THEN list_intersect(found, parsed)
      ELSE list_distinct(list_concat(found, parsed)) END) AS dbms
    FROM (SELECT id, sql, {_HITS} AS found,
            CASE WHEN candidates = '' THEN []::VARCHAR[] ELSE string_split(candidates, ',') END AS parsed FROM {{sqls}} v) w"""


def _sqls(spark, sf):
    listed = F.when(F.col("candidates") == "", F.array().cast("array<string>")).otherwise(F.split("candidates", ","))
    return view(spark, sf, "sqls").withColumn("parsed", listed)


def _joined(name):
    return F.array_join(name, ",").alias(name)


@query("dialect_patterns", f"SELECT id, array_to_string(found, ',') AS found FROM ({_TAGGED}) t")
def _(spark, sf):
    found = F.array_join(pattern_dialects(F.col("sql")), ",")
    return _sqls(spark, sf).select("id", found.alias("found"))


@query("dialect_combined", f"SELECT id, array_to_string(dbms, ',') AS dbms FROM ({_TAGGED}) t WHERE len(dbms) > 0")
def _(spark, sf):
    return tag_dialects(_sqls(spark, sf), "sql", "dbms", "parsed").select("id", _joined("dbms"))


@query("dialect_rejects", f"SELECT id, sql FROM ({_TAGGED}) t WHERE len(dbms) = 0")
def _(spark, sf):
    return untagged_rows(_sqls(spark, sf), "sql", "parsed").select("id", "sql")


@query(
    "dialect_class",
    f"""SELECT id, CASE len(dbms) WHEN 0 THEN 'INVALID' WHEN 5 THEN 'GENERAL' ELSE 'SPECIFIC' END AS dbms_class
        FROM ({_TAGGED}) t""",
)
def _(spark, sf):
    return with_dialect_class(with_dialects(_sqls(spark, sf), "sql", "dbms", "parsed")).select("id", "dbms_class")


_LABEL = "CASE WHEN len(dbms) > 2 THEN 'General DBMS' WHEN len(dbms) > 0 THEN dbms[1] END"


@query(
    "dialect_hint",
    f"""SELECT id, label, CASE WHEN len(dbms) = 1 THEN NULL ELSE label END AS compat_label,
        CASE lower(label) {' '.join(f"WHEN {duck.lit(k)} THEN {duck.lit(v)}" for k, v in DIALECT_HINTS.items())} ELSE '' END AS hint
        FROM (SELECT id, dbms, {_LABEL} AS label FROM ({_TAGGED}) t) u""",
)
def _(spark, sf):
    tagged = with_dialects(_sqls(spark, sf), "sql", "dbms", "parsed")
    label = dialect_label(F.col("dbms"))
    return tagged.select(
        "id",
        label.alias("label"),
        dialect_label(F.col("dbms"), compat=True).alias("compat_label"),
        dialect_hint(F.upper(label)).alias("hint"),
    )


# --- prompt parsing ----------------------------------------------------------------------------

_PARSED = f"""SELECT id, role, {duck.strip('completion')} AS answer,
      {duck.strip("CASE WHEN m > q + 9 THEN substr(prompt, q + 9, m - q - 9) ELSE '' END")} AS question,
      {duck.strip("CASE WHEN starts_with(rest, '```') THEN regexp_replace(substr(rest, 4), '(?s)```[^`]*$', '') ELSE rest END")} AS context
    FROM (SELECT *, instr(prompt, 'question:') AS q, instr(prompt, 'metadata:') AS m,
            {duck.strip("substr(prompt, instr(prompt, 'metadata:') + 9)")} AS rest FROM {{prompts}} p) x
    WHERE q > 0 AND m > 0"""


@query("prompt_transform", f"SELECT id, context, question, answer FROM ({_PARSED}) t")
def _(spark, sf):
    return transform_prompts(view(spark, sf, "prompts"), keep=["id"])


@query(
    "prompt_transform_counts",
    """SELECT role, CAST(count(*) FILTER (contains(prompt, 'question:') AND contains(prompt, 'metadata:')) AS BIGINT) AS retained,
       CAST(count(*) FILTER (NOT (contains(prompt, 'question:') AND contains(prompt, 'metadata:'))) AS BIGINT) AS skipped
       FROM {prompts} p GROUP BY role""",
)
def _(spark, sf):
    return transform_counts(parse_prompts(view(spark, sf, "prompts")), F.col("parsed").isNotNull(), ["role"])


@query(
    "prompt_rejects",
    "SELECT id, role FROM {prompts} p WHERE NOT (contains(prompt, 'question:') AND contains(prompt, 'metadata:'))",
)
def _(spark, sf):
    return skipped_prompts(view(spark, sf, "prompts")).select("id", "role")


_PLAIN_QUESTION = PromptHandler(
    applies=lambda prompt: prompt.startswith("question:"),
    parse=lambda prompt, completion: F.when(
        F.length(prompt) > 100,
        F.struct(
            F.lit("").alias("context"),
            strip(F.substr(prompt, F.lit(10))).alias("question"),
            strip(completion).alias("answer"),
        ),
    ),
)


@query(
    "handler_chain",
    f"""SELECT id, context, question, answer FROM ({_PARSED}) t
        UNION ALL SELECT id, '' AS context, {duck.strip("substr(prompt, 10)")} AS question, {duck.strip('completion')} AS answer
        FROM {{prompts}} p WHERE starts_with(prompt, 'question:') AND NOT contains(prompt, 'metadata:') AND length(prompt) > 100""",
)
def _(spark, sf):
    return transform_prompts(view(spark, sf, "prompts"), [QUESTION_METADATA, _PLAIN_QUESTION], keep=["id"])


@query(
    "transform_and_tag",
    f"""SELECT id, context, question, answer, 'MySQL' AS dbms FROM ({_PARSED}) t""",
)
def _(spark, sf):
    return transform_and_tag(view(spark, sf, "prompts"), keep=["id"]).withColumn("dbms", F.array_join("dbms", ","))


@query(
    "transform_flow",
    f"""SELECT id, context, question, answer, split, CAST(count(*) OVER () AS INTEGER) AS retained,
          CAST((SELECT count(*) FROM {{prompts}} p) - count(*) OVER () AS INTEGER) AS skipped
        FROM (SELECT t.*, p.role AS split FROM ({_PARSED}) t JOIN {{prompts}} p ON p.id = t.id) u""",
)
def _(spark, sf):
    rows, target = view(spark, sf, "prompts").withColumn("split", F.col("role")), stage_path(spark, "transformed")
    counts = transform_flow(rows, target, keep=["id", "split"])
    published = spark.read.parquet(target).select("id", "context", "question", "answer", "split")
    return published.withColumns({name: F.lit(counts[name]).cast("int") for name in ("retained", "skipped")})


# --- names -------------------------------------------------------------------------------------

_RESERVED = "regexp_matches(upper(k), '^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$')"


@query(
    "artifact_key",
    f"""SELECT event_id, CASE WHEN k = '' OR {_RESERVED} THEN '_' || k ELSE k END AS name,
        rtrim(replace(regexp_replace('org/set:' || event_type || '?.' || model, '[<>"/\\\\|?*]', '_', 'g'), ':', '-'), '. ') AS key
        FROM (SELECT *, rtrim(replace(regexp_replace(model, '[<>"/\\\\|?*]', '_', 'g'), ':', '-'), '. ') AS k FROM {{models}} m) x""",
)
def _(spark, sf):
    dataset = F.concat(F.lit("org/set:"), F.col("event_type"), F.lit("?"))
    return view(spark, sf, "models").select(
        "event_id", safe_name(F.col("model")).alias("name"), artifact_key(dataset, F.col("model")).alias("key")
    )


@query(
    "model_size",
    """SELECT event_id, CASE n WHEN 7 THEN '7B' WHEN 8 THEN '8B' WHEN 13 THEN '13-14B' WHEN 14 THEN '13-14B' WHEN 27 THEN '27-30B'
         WHEN 30 THEN '27-30B' WHEN 70 THEN '70B' ELSE 'Unknown' END AS size,
       CASE WHEN m LIKE '%7b%' THEN '7B' WHEN m LIKE '%8b%' THEN '8B' WHEN m LIKE '%13b%' OR m LIKE '%14b%' THEN '13-14B'
         WHEN m LIKE '%27b%' OR m LIKE '%30b%' THEN '27-30B' WHEN m LIKE '%70b%' THEN '70B' ELSE 'Unknown' END AS compat_size
       FROM (SELECT event_id, lower(model) AS m,
               TRY_CAST(regexp_extract(lower(model), '(?:^|[^0-9.])([0-9]+)b(?:$|[^a-z0-9])', 1) AS INTEGER) AS n FROM {models} v) x""",
)
def _(spark, sf):
    model = F.col("model")
    return view(spark, sf, "models").select(
        "event_id", model_size(model).alias("size"), model_size(model, compat=True).alias("compat_size")
    )


@query(
    "provider_kind",
    """SELECT event_id, CASE WHEN lower(model) LIKE 'gpt%' OR lower(model) LIKE 'o1%' OR lower(model) LIKE 'o3%'
       THEN 'chat' ELSE 'prompt' END AS provider FROM {models} m""",
)
def _(spark, sf):
    return view(spark, sf, "models").select("event_id", provider_kind(F.col("model")).alias("provider"))


@query(
    "endpoint_kind",
    """SELECT page_id, nullif(CASE
          WHEN proto = 'https' AND seg[2] = 'openai' AND seg[3] = 'deployments' THEN array_to_string(seg[5:], '/')
          WHEN proto = 'https' AND length(seg[2]) > 1 AND seg[2][1] = 'v' AND try_cast(seg[2][2:] AS INTEGER) IS NOT NULL THEN array_to_string(seg[3:], '/')
          WHEN proto = 'http' AND contains(seg[1], ':') AND seg[2] = 'api' THEN array_to_string(seg[3:], '/') END, '') AS endpoint
        FROM (SELECT page_id, string_split(url, '://')[1] AS proto, string_split(string_split(string_split(url, '://')[2], '?')[1], '/') AS seg FROM {urls} u) x""",
)
def _(spark, sf):
    return view(spark, sf, "urls").select("page_id", endpoint_kind(F.col("url")).alias("endpoint"))
