"""Prompts, requests, model calls, joins and attempt statistics."""

from __future__ import annotations

import json
import warnings
import zlib

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from evalflow.functions import templates as T
from evalflow.functions.dialect import DIALECT_HINTS
from evalflow.functions.tokens import python_tokens
from evalflow.operators import ids, invoke, joins, outcomes, prompts, shape, timeline
from evalflow.plans import flows, runs
from evalflow.sources import artifacts, logs, stats
from evalflow.sources.datasets import ColumnRoles, apply_roles, output_column
from evalflow.staging import stage, stage_path
from suite import duck
from suite.registry import query
from suite.views import table, view


def _qa(spark, sf):
    return view(spark, sf, "qa")


def _gen(df):
    """A generated query per row, wrong for every third row."""
    return df.withColumn("gen_sql", F.concat(F.lit("SELECT "), F.col("task_id") % 3))


# --- ids and limits ----------------------------------------------------------------------------


@query("task_ids", "SELECT row_number() OVER (ORDER BY source, doc_id) - 1 AS task_id, doc_id FROM documents")
def _(spark, sf):
    documents = table(spark, sf, "documents").select("source", "doc_id")
    return ids.assign_task_ids(documents, ["source", "doc_id"]).select("task_id", "doc_id")


@query("keyed_task_ids", """SELECT sha256('{"source":"' || source || '","doc_id":' || doc_id || '}') AS task_id, doc_id FROM documents""")
def _(spark, sf):
    documents = table(spark, sf, "documents").select("source", "doc_id")
    return ids.keyed_task_ids(documents, ["source", "doc_id"]).select("task_id", "doc_id")


@query("batch_numbers", "SELECT task_id, CAST(floor(task_id / 20) AS BIGINT) AS batch_no FROM (SELECT row_number() OVER (ORDER BY task_id) - 1 AS task_id FROM {qa} q) x")
def _(spark, sf):
    qa = _qa(spark, sf).select(F.col("task_id").alias("key"))
    return ids.batch_numbers(ids.assign_task_ids(qa, ["key"]), 20).select("task_id", "batch_no")


_HEAD = "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents) x WHERE n <= %d"


@query("split_head", _HEAD % 50)
def _(spark, sf):
    return ids.limit_per_group(table(spark, sf, "documents").select("doc_id", "lang"), 50, ["doc_id"], ["lang"])


@query("split_head_large", "SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events) x WHERE n <= 1500")
def _(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type", "ts")
    return ids.limit_per_group(events, 1500, ["ts", "event_id"], ["event_type"]).select("event_id", "event_type")


@query("dataset_head", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100")
def _(spark, sf):
    return ids.limit_rows(table(spark, sf, "documents").select("doc_id"), 100, ["doc_id"])


# --- prompts and requests ----------------------------------------------------------------------

_SLOTS = {"schema": "context", "ddl": "context", "question": "question", "gt_sql": "answer", "sql": "answer",
          "answer": "answer", "gen_sql": "'SELECT ' || (task_id % 3)"}


def _fill(name, **extra):
    return duck.fill(T.TEMPLATES[name], **{**_SLOTS, **extra})


_MODEL_OF = "CASE task_id % 3 WHEN 0 THEN 'SQLCoder:15b' WHEN 1 THEN 'gpt-4o' ELSE 'qwq' END"


def _model_of():
    return F.when(F.col("task_id") % 3 == 0, "SQLCoder:15b").when(F.col("task_id") % 3 == 1, "gpt-4o").otherwise("qwq")


@query(
    "render_generation",
    f"SELECT task_id, CASE WHEN task_id % 3 = 0 THEN {_fill('generate_tagged')} ELSE {_fill('generate')} END AS prompt FROM {{qa}} q",
)
def _(spark, sf):
    return prompts.generation_prompts(_qa(spark, sf), _model_of()).select("task_id", "prompt")


@query("render_verdict", f"SELECT task_id, {_fill('verdict')} AS prompt FROM {{qa}} q")
def _(spark, sf):
    return prompts.verdict_prompts(_gen(_qa(spark, sf))).select("task_id", "prompt")


@query("render_translation", f"SELECT task_id, {_fill('translate')} AS prompt FROM {{qa}} q")
def _(spark, sf):
    return prompts.translation_prompts(_qa(spark, sf), ColumnRoles(input="question")).select("task_id", "prompt")


_ALTERNATES = [
    "generate_reasoning", "generate_long", "generate_dialect", "generate_tagged_long", "generate_korean",
    "verdict_tolerant", "verdict_result_set", "verdict_intent",
]


@query(
    "render_alternates",
    "SELECT task_id, "
    + ", ".join(
        f"{_fill(n, dbms=duck.lit('Oracle'), dbms_instructions=duck.lit(DIALECT_HINTS['oracle']))} AS {n}"
        for n in _ALTERNATES
    )
    + " FROM {qa} q",
)
def _(spark, sf):
    rows = _gen(_qa(spark, sf)).withColumn("dbms", F.lit("Oracle"))
    for name in _ALTERNATES:
        rows = prompts.render_prompts(rows, name, name=name)
    return rows.select("task_id", *_ALTERNATES)


@query("training_text", f"SELECT task_id, {_fill('generate')} || chr(10) || answer AS text FROM {{qa}} q")
def _(spark, sf):
    return prompts.training_text(_qa(spark, sf), "qwq").select("task_id", "text")


@query(
    "training_rows",
    "SELECT item_id, text, db_id FROM (SELECT p_partkey AS item_id, CASE WHEN p_type <> 'ECONOMY' THEN p_name END AS text, p_size AS db_id FROM part) x WHERE text IS NOT NULL AND db_id <> 1",
)
def _(spark, sf):
    rows = table(spark, sf, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.when(F.col("p_type") != "ECONOMY", F.col("p_name")).alias("text"),
        F.col("p_size").alias("db_id"),
    )
    return shape.training_rows(rows, ["item_id"])


@query(
    "probe_prompts",
    "SELECT conv_id, turn, length(text) AS size, substr(repeat('Summarise the following text. ', 1 + CAST(length(text) / 30 AS INTEGER)), 1, length(text)) AS prompt, 'Summarise the following text. Its length is about ' || length(text) || '.' AS named FROM conversations",
)
def _(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").alias("size"))
    sized = prompts.probe_prompts(rows, F.col("size"))
    named = prompts.probe_prompts(sized, F.col("size"), "named", compat=True)
    return named.withColumn("size", F.col("size").cast("bigint"))


def _requests(spark, sf, mode="generate"):
    prompted = prompts.generation_prompts(_qa(spark, sf), _model_of())
    return prompts.build_requests(prompted, _model_of(), mode)


@query(
    "request_jobs",
    f"""SELECT task_id, {_MODEL_OF} AS model, CASE WHEN task_id % 3 = 1 THEN 'system' END AS role,
        CASE WHEN task_id % 3 = 1 THEN {_fill('generate')} END AS content, CASE WHEN task_id % 3 = 1 THEN 'json_object' END AS response_format,
        CASE task_id % 3 WHEN 0 THEN {_fill('generate_tagged')} WHEN 2 THEN {_fill('generate')} END AS prompt,
        CASE WHEN task_id % 3 <> 1 THEN 'false' END AS stream, CASE WHEN task_id % 3 <> 1 THEN '["gen_sql"]' END AS required,
        CASE WHEN task_id % 3 = 1 THEN 3 ELSE 4 END AS fields FROM {{qa}} q""",
)
def _(spark, sf):
    jobs = prompts.request_jobs(_requests(spark, sf))

    def field(path):
        return F.get_json_object("request", f"$.{path}")

    return jobs.select(
        "task_id",
        field("model").alias("model"),
        field("messages[0].role").alias("role"),
        field("messages[0].content").alias("content"),
        field("response_format.type").alias("response_format"),
        field("prompt").alias("prompt"),
        field("stream").alias("stream"),
        field("format.required").alias("required"),
        F.size(F.json_object_keys("request")).alias("fields"),
    )


@query(
    "request_formats",
    """SELECT task_id, '["resolve_yn"]' AS verdict, '["question","sql_query"]' AS translate,
       '["reasoning","description","gen_sql"]' AS reasoning, CAST(NULL AS VARCHAR) AS text, 'user' AS mini_role,
       CAST(NULL AS VARCHAR) AS mini_format FROM {qa} q""",
)
def _(spark, sf):
    rows = _qa(spark, sf).select("task_id", F.col("question").alias("prompt"))

    def required(mode, only_sql=True):
        request = prompts.build_requests(rows, "qwq", mode, only_sql)
        return request.select("task_id", F.get_json_object(F.to_json("request"), "$.format.required").alias("r"))

    mini = prompts.build_requests(rows, "o1-mini").select(
        "task_id",
        F.get_json_object(F.to_json("request"), "$.messages[0].role").alias("mini_role"),
        F.get_json_object(F.to_json("request"), "$.response_format").alias("mini_format"),
    )
    out = mini
    for name, mode, only in (("verdict", "verdict", True), ("translate", "translate", True), ("reasoning", "generate", False), ("text", "text", True)):
        out = out.join(required(mode, only).withColumnRenamed("r", name), "task_id")
    return out



def _count(x):
    return f"CAST(len(regexp_extract_all({x}, '[\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}]+|[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}\\s]')) AS BIGINT)"


@query(
    "token_cost",
    f"""SELECT task_id, CASE WHEN task_id % 3 = 1 THEN 4 + 1 + {_count(_fill('generate'))} + 2 + 15
        WHEN task_id % 3 = 0 THEN {_count(_fill('generate_tagged'))} + 15 ELSE {_count(_fill('generate'))} + 15 END AS tokens FROM {{qa}} q""",
)
def _(spark, sf):
    endpoint = F.when(F.col("task_id") % 3 == 1, "chat/completions").otherwise("generate")
    return prompts.with_token_cost(_requests(spark, sf), endpoint).select("task_id", "tokens")


@query(
    "token_cost_shapes",
    """SELECT task_id, CASE task_id % 3 WHEN 0 THEN 4 - 1 + 3 + 2 + 2 * 7 WHEN 1 THEN len(string_split(question, ' ')) + len(string_split(answer, ' ')) + 2 * 2 * 30
       ELSE len(string_split(question, ' ')) END AS tokens FROM {qa} q""",
)
def _(spark, sf):
    message = F.struct(F.lit("user").alias("role"), F.lit("hi").alias("content"), F.lit("n").alias("name"))
    request = (
        F.when(F.col("task_id") % 3 == 0, F.to_json(F.struct(F.array(message).alias("messages"), F.lit(7).alias("max_tokens"), F.lit(2).alias("n"))))
        .when(F.col("task_id") % 3 == 1, F.to_json(F.struct(F.array("question", "answer").alias("prompt"), F.lit(30).alias("max_tokens"), F.lit(2).alias("n"))))
        .otherwise(F.to_json(F.struct(F.col("question").alias("input"))))
    )
    endpoint = F.when(F.col("task_id") % 3 == 0, "chat").when(F.col("task_id") % 3 == 1, "generate").otherwise("embeddings")
    counter = python_tokens(lambda text: text.split(" "))
    rows = _qa(spark, sf).withColumn("request", request)
    costed = prompts.with_token_cost(rows, endpoint, counter=counter)
    return costed.select("task_id", "tokens")


@query("role_mapping", "SELECT task_id, context, question, answer FROM {qa} q")
def _(spark, sf):
    path = "org/synthetic_text_to_sql:a:b"
    rows = _qa(spark, sf).withColumnsRenamed({"context": "sql_context", "question": "sql_prompt", "answer": "sql"})
    return apply_roles(rows, ColumnRoles.for_dataset(path), keep=("task_id",))


@query(
    "role_mapping_compat",
    "SELECT task_id, answer AS context, question, answer, question AS input, 'gen_sql response translation response' AS outputs FROM {qa} q",
)
def _(spark, sf):
    roles = ColumnRoles.for_dataset("org/other:x", compat=True, input="question")
    names = [output_column("generate"), output_column("text"), output_column("translate"), output_column("translate", runner="batch")]
    return apply_roles(_qa(spark, sf), roles, keep=("task_id",)).withColumn("outputs", F.lit(" ".join(names)))


# --- joins -------------------------------------------------------------------------------------

_STRICT = f"""SELECT task_id, model, {duck.strict_verdict('body')} AS resolve_yn
    FROM (SELECT task_id, model, {duck.body('content')} AS body FROM {{verdicts}} v) w"""
_DOCS = "SELECT doc_id AS task_id, text AS question, lang AS context, source AS answer, 'SELECT ' || n_chars AS gen_sql FROM documents"
_CASES = f"""SELECT s.task_id, d.question, d.context, d.answer AS gt_sql, d.gen_sql, s.resolve_yn
    FROM ({_STRICT}) s JOIN ({_DOCS}) d ON d.task_id = s.task_id WHERE s.resolve_yn = """


def _dataset(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("task_id"),
        F.col("source").alias("tested_model"),
        F.col("text").alias("question"),
        F.col("lang").alias("context"),
        F.col("source").alias("answer"),
        F.concat(F.lit("SELECT "), F.col("n_chars")).alias("gen_sql"),
    )


def _verdicts(spark, sf):
    read = outcomes.with_verdict(view(spark, sf, "verdicts"))
    return joins.tidy_verdicts(read.select(F.col("task_id").cast("string").alias("task_id"), F.col("model").alias("tested_model"), "resolve_yn"))


def _cases(spark, sf, verdict):
    joined = joins.join_verdicts(_verdicts(spark, sf), _dataset(spark, sf).drop("tested_model"))
    return shape.cases(joined.select("task_id", "question", "context", "gt_sql", "gen_sql", "resolve_yn"), verdict)


@query("success_cases", _CASES + "'yes'")
def _(spark, sf):
    return _cases(spark, sf, "yes")


@query("failure_cases", _CASES + "'no'")
def _(spark, sf):
    return _cases(spark, sf, "no")


@query(
    "accuracy_by_model",
    f"""SELECT d.source AS tested_model, CAST(count(*) AS BIGINT) AS test_size, CAST(count(*) FILTER (s.resolve_yn = 'yes') AS BIGINT) AS successful_count,
        round(count(*) FILTER (s.resolve_yn = 'yes') * 100.0::DOUBLE / count(*), 4) AS accuracy
        FROM documents d LEFT JOIN ({_STRICT}) s ON s.task_id = d.doc_id GROUP BY d.source""",
)
def accuracy_by_model(spark, sf):
    """Verdict answers, read, normalised, joined to their rows and counted per model."""
    # The verdicts carry their model, so nothing has to be joined to count them.
    stats = outcomes.verification_stats(_dataset(spark, sf).select("tested_model"), _verdicts(spark, sf))
    return stats.select("tested_model", "test_size", "successful_count", F.round("accuracy", 4).alias("accuracy"))


_HAS_RESULT = "length(answer) > length(question)"


def _results(spark, sf):
    """Processed results as the runner stores them; rows with a short answer have none."""
    stored = F.to_json(F.struct(F.concat(F.lit("SELECT "), F.col("task_id")).alias("gen_sql")))
    return _qa(spark, sf).where(_HAS_RESULT).select("task_id", stored.alias("result"))


@query("attach_results", f"SELECT task_id, question, CASE WHEN {_HAS_RESULT} THEN 'SELECT ' || task_id END AS gen_sql FROM {{qa}} q")
def _(spark, sf):
    return joins.attach_results(_qa(spark, sf).select("task_id", "question"), _results(spark, sf))


@query(
    "request_response_pairs",
    f"""SELECT question AS request, '{{"gen_sql":"SELECT ' || task_id || '"}}' AS response, task_id AS index FROM {{qa}} q WHERE {_HAS_RESULT}""",
)
def _(spark, sf):
    requests = _qa(spark, sf).select("task_id", F.col("question").alias("request"))
    return joins.request_response_pairs(requests, _results(spark, sf).withColumnRenamed("result", "response"))


@query(
    "lost_requests",
    "SELECT DISTINCT task_id, 'request was not processed (lost)' AS error FROM {attempts} a WHERE task_id NOT IN (SELECT task_id FROM {attempts} b WHERE error IS NULL)",
)
def _(spark, sf):
    attempts = view(spark, sf, "attempts")
    return joins.lost_requests(attempts.select("task_id").distinct(), attempts.where("error IS NULL"))


@query(
    "complete_log",
    f"""SELECT task_id, CAST(NULL AS VARCHAR) AS error, 'ok' AS response FROM {{qa}} q WHERE {_HAS_RESULT}
       UNION ALL SELECT task_id, 'request was not processed (lost)', NULL FROM {{qa}} q WHERE NOT ({_HAS_RESULT})""",
)
def _(spark, sf):
    log = _results(spark, sf).select("task_id", F.lit(None).cast("string").alias("error"), F.lit("ok").alias("response"))
    return joins.complete_log(_qa(spark, sf), log)


@query("resume_rows", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    return shape.pending_rows(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), ["doc_id"])


@query("run_matrix", "SELECT DISTINCT d.source AS base_model, l.lang AS verifying_model FROM documents d, (SELECT DISTINCT lang FROM documents) l")
def _(spark, sf):
    documents = table(spark, sf, "documents")
    return joins.run_matrix(documents.select("source").distinct(), documents.select("lang"), "source", "lang")


@query(
    "benchmark_matrix",
    "SELECT DISTINCT source AS model, n AS test_no, substr(repeat('Summarise the following text. ', 4), 1, 100) AS prompt FROM documents, (SELECT unnest([1, 2, 3, 4, 5])::INTEGER AS n) t",
)
def _(spark, sf):
    models = table(spark, sf, "documents").select(F.col("source").alias("model")).distinct()
    return prompts.probe_prompts(joins.benchmark_matrix(models, 5), 100)


# --- attempts ----------------------------------------------------------------------------------

_LIMITED = "regexp_matches(lower(coalesce({x}, '')), 'rate limit|rate_limit')"
_CLASS = f"""CASE WHEN {_LIMITED.format(x='api_error')} OR {_LIMITED.format(x='error')} THEN 'rate_limit'
    WHEN api_error IS NOT NULL THEN 'api' WHEN error IS NOT NULL THEN 'other' END"""
_CLASSED = f"SELECT *, {_CLASS} AS error_class FROM {{attempts}} a"


def _classed(spark, sf):
    return outcomes.error_classes(view(spark, sf, "attempts"), api_error="api_error")


@query("error_classes", f"SELECT event_id, error_class FROM ({_CLASSED}) c")
def _(spark, sf):
    return _classed(spark, sf).select("event_id", "error_class")


_STATUS = """SELECT task_id, count(*) AS attempts, CASE WHEN bool_or(ok) THEN 'success' WHEN count(*) < 3 THEN 'retry' ELSE 'failed' END AS status
    FROM {attempts} a GROUP BY task_id"""


@query("final_status", f"SELECT task_id, CAST(attempts AS BIGINT) AS attempts, status FROM ({_STATUS}) s")
def _(spark, sf):
    return outcomes.final_status(view(spark, sf, "attempts"))


@query(
    "status_counters",
    f"""SELECT CAST(t.n AS BIGINT) AS tasks_started, CAST(t.p AS BIGINT) AS tasks_in_progress, CAST(t.s AS BIGINT) AS tasks_succeeded,
        CAST(t.f AS BIGINT) AS tasks_failed, CAST(e.r AS BIGINT) AS rate_limit_errors, CAST(e.a AS BIGINT) AS api_errors, CAST(e.o AS BIGINT) AS other_errors
        FROM (SELECT count(*) AS n, count(*) FILTER (status = 'retry') AS p, count(*) FILTER (status = 'success') AS s,
                count(*) FILTER (status = 'failed') AS f FROM ({_STATUS}) x) t,
             (SELECT count(*) FILTER (error_class = 'rate_limit') AS r, count(*) FILTER (error_class = 'api') AS a,
                count(*) FILTER (error_class = 'other') AS o FROM ({_CLASSED}) y) e""",
)
def _(spark, sf):
    attempts = _classed(spark, sf)
    return outcomes.status_counters(attempts, outcomes.final_status(attempts))


@query(
    "latest_outcome",
    "SELECT task_id, attempt, event_id, ok, error FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY attempt DESC) AS n FROM {attempts} a) x WHERE n = 1",
)
def _(spark, sf):
    attempts = view(spark, sf, "attempts").select("task_id", "attempt", "event_id", "ok", "error")
    return invoke.latest_outcome(attempts)


@query(
    "cooldown_flags",
    f"""SELECT event_id, coalesce(epoch_us(ts) - epoch_us(last) < 900000000, false) AS in_cooldown
        FROM (SELECT *, max(CASE WHEN error_class = 'rate_limit' THEN ts END) OVER (PARTITION BY model ORDER BY ts
                RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last FROM ({_CLASSED}) c) d""",
)
def _(spark, sf):
    # 15 minutes instead of 15 seconds, so that the sparse test events do flag rows.
    rows = _classed(spark, sf).select("event_id", "model", "ts", "error_class")
    return timeline.with_cooldown(rows, cooldown_s=900, tie=["event_id"]).select("event_id", "in_cooldown")


@query(
    "admission_plan",
    """SELECT event_id, CAST(coalesce(sum(greatest(1000, tokens * 50)) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 50000 AS BIGINT) AS slot
       FROM {attempts} a""",
)
def _(spark, sf):
    rows = view(spark, sf, "attempts").select("event_id", "tokens")
    return timeline.plan_admission(rows, max_requests=50, max_tokens=1000, order=["event_id"]).select("event_id", "slot")


@query(
    "tokens_per_minute",
    """SELECT model, date_trunc('minute', ts) AS minute, CAST(count(*) AS BIGINT) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens,
       count(*) > 1 OR sum(tokens) > 100 AS over_budget FROM {attempts} a GROUP BY ALL""",
)
def _(spark, sf):
    return outcomes.tokens_per_minute(view(spark, sf, "attempts"), max_requests=1, max_tokens=100)


_PROGRESS = """SELECT model AS run, task_id, end_ts, ok, row_number() OVER (PARTITION BY model, task_id ORDER BY end_ts, attempt) AS n FROM {attempts} a WHERE ok OR attempt >= 3"""


@query(
    "running_progress",
    f"""SELECT run, task_id, CAST(completed AS BIGINT) AS completed, CAST(successful AS BIGINT) AS successful, CAST(completed - successful AS BIGINT) AS failed,
        elapsed_s, round(coalesce(completed / nullif(elapsed_s, 0), 0), 6) AS rate
        FROM (SELECT run, task_id, count(*) OVER w AS completed, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER w AS successful,
                {duck.seconds('min(end_ts) OVER w', 'end_ts')} AS elapsed_s FROM ({_PROGRESS}) p WHERE n = 1
              WINDOW w AS (PARTITION BY run ORDER BY end_ts, task_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) q""",
)
def _(spark, sf):
    attempts = view(spark, sf, "attempts").withColumnRenamed("model", "run")
    progress = timeline.running_progress(timeline.first_outcomes(outcomes.terminal_attempts(attempts, 3)))
    return progress.select("run", "task_id", "completed", "successful", "failed", "elapsed_s", F.round("rate", 6).alias("rate"))


_SPAN = duck.seconds("min(ts)", "max(ts)")


@query(
    "run_statistics",
    f"""SELECT tested_model, test_dataset, n AS test_size, s AS successful_count, {duck.percent('s', 'n')} AS accuracy, round(sec / n, 6) AS avg_processing_time,
        round({duck.ratio('n', 'sec')}, 6) AS batch_throughput, {duck.percent('s', 'n')} AS success_rate, {duck.percent('n - s', 'n')} AS error_rate,
        'ok: ' || s || ', failed: ' || (n - s) AS comments, 'translation' AS phase, 'Unknown' AS model_size
        FROM (SELECT model AS tested_model, 'd' || (event_id % 3) AS test_dataset, count(*)::BIGINT AS n, (count(*) FILTER (ok))::BIGINT AS s, {_SPAN} AS sec
              FROM {{attempts}} a GROUP BY ALL) x""",
)
def _(spark, sf):
    rows = view(spark, sf, "attempts").withColumnsRenamed({"model": "tested_model"})
    rows = rows.withColumn("test_dataset", F.concat(F.lit("d"), F.col("event_id") % 3))
    stats = outcomes.generation_stats(rows)
    rounded = {c: F.round(c, 6) for c in ("avg_processing_time", "batch_throughput")}
    return stats.withColumns(rounded).drop("throughput", "avg_translation_time_s")


@query(
    "batch_metrics",
    f"""SELECT model, total_requests, d AS completed_requests, s AS successful_requests, f AS failed_requests, {duck.percent('d', 'total_requests')} AS completion_percentage,
        {duck.percent('s', 'total_requests')} AS success_rate, sec AS elapsed_time, round({duck.ratio('sec', 'd')}, 6) AS avg_time_per_request,
        round({duck.ratio('d', 'sec')}, 9) AS requests_per_second, r::BIGINT AS rate_limit_errors, o::BIGINT AS other_errors
        FROM (SELECT model, count(*)::BIGINT AS total_requests, (count(*) FILTER (ok OR n >= 3))::BIGINT AS d, (count(*) FILTER (ok))::BIGINT AS s,
                (count(*) FILTER (NOT ok AND n >= 3))::BIGINT AS f, {duck.seconds('min(t0)', 'max(t1)')} AS sec, sum(r) AS r, sum(o) AS o
              FROM (SELECT model, task_id, bool_or(ok) AS ok, count(*) AS n, min(ts) AS t0, max(ts) AS t1, count(*) FILTER (error_class = 'rate_limit') AS r,
                      count(*) FILTER (error_class IN ('api', 'other')) AS o FROM ({_CLASSED}) c GROUP BY ALL) x GROUP BY model) y""",
)
def _(spark, sf):
    metrics = outcomes.batch_metrics(_classed(spark, sf))
    return metrics.withColumns(
        {"avg_time_per_request": F.round("avg_time_per_request", 6), "requests_per_second": F.round("requests_per_second", 9)}
    )


@query(
    "throughput",
    f"""SELECT model, n AS requests, sec AS elapsed_s, round(sec / n, 6) AS avg_s_per_request, round(n / sec, 9) AS requests_per_s
        FROM (SELECT model, count(DISTINCT task_id)::BIGINT AS n, {_SPAN} AS sec FROM {{attempts}} a GROUP BY model) x""",
)
def _(spark, sf):
    rates = outcomes.throughput(view(spark, sf, "attempts"))
    return rates.withColumns({"avg_s_per_request": F.round("avg_s_per_request", 6), "requests_per_s": F.round("requests_per_s", 9)})


# --- model calls -------------------------------------------------------------------------------


def stub_client():
    """Deterministic stand-in for a model: the length of the prompt decides what happens."""

    def call(request_json, attempt):
        request = json.loads(request_json)
        n = len(request["prompt"])
        if n % 7 == 0:
            raise invoke.CallError("bad request", 400)
        if n % 11 == 0 or (n % 5 == 0 and attempt < 3):
            raise invoke.CallError("server overloaded", 503)
        wanted = request.get("format", {}).get("required", [])
        if "resolve_yn" in wanted:
            return json.dumps({"response": json.dumps({"resolve_yn": "yes" if n % 2 else "no"})})
        if "sql_query" in wanted:
            return json.dumps({"response": json.dumps({"question": f"Q{n}", "sql_query": f"SELECT {n}"})})
        if not wanted:
            times = {"total_duration": 3_000_000 * n, "eval_duration": 2_000_000 * n, "prompt_eval_duration": 1000 * n}
            return json.dumps({"response": "done", "eval_count": len(request["model"]), **times})
        return json.dumps({"response": f"Here:\n```sql\nSELECT {n};\n```"})

    return call


_STUB = f"SELECT *, CASE WHEN n % 7 = 0 THEN 1 WHEN n % 11 = 0 THEN 4 WHEN n % 5 = 0 THEN 3 ELSE 1 END AS attempts, n % 7 <> 0 AND n % 11 <> 0 AS ok FROM (SELECT task_id, split, length({_fill('generate')}) AS n FROM {{qa}} q) x"
_OPTIONS = runs.RunOptions(max_attempts=4, backoff_s=0.0)


@query(
    "invoke_stub",
    f"SELECT task_id, CAST(attempts AS BIGINT) AS attempts, ok, CASE WHEN ok THEN 'SELECT ' || n || ';' END AS gen_sql FROM ({_STUB}) s",
)
def _(spark, sf):
    requests = prompts.build_requests(prompts.generation_prompts(_qa(spark, sf), "qwq"), "qwq")
    attempts = invoke.invoke(requests, stub_client, max_attempts=4, backoff_s=0.0)
    last = invoke.latest_outcome(attempts).withColumn("content", runs.response_content(F.col("response")))
    sql = runs.generated_sql(F.col("content"))["gen_sql"]
    return last.select("task_id", F.col("attempt").cast("bigint").alias("attempts"), "ok", sql.alias("gen_sql"))


@query(
    "warmup_excluded",
    f"SELECT CAST(count(*) AS BIGINT) AS requests, CAST(count(*) FILTER (ok) AS BIGINT) AS succeeded, CAST(1 AS BIGINT) AS warm_ups FROM ({_STUB}) s",
)
def _(spark, sf):
    requests = prompts.build_requests(prompts.generation_prompts(_qa(spark, sf), "qwq"), "qwq")
    warm = invoke.warm_up(spark, stub_client, "qwq", json.dumps({"model": "qwq", "prompt": "hello"}))
    attempts = warm.unionByName(invoke.invoke(requests, stub_client, max_attempts=4, backoff_s=0.0))
    status = outcomes.final_status(invoke.run_attempts(attempts), 4).agg(
        F.count("*").alias("requests"), F.count_if(F.col("status") == "success").alias("succeeded")
    )
    warm_ups = attempts.where("phase = 'warmup'").agg(F.count("*").alias("warm_ups"))
    return status.withColumn("k", F.lit(1)).join(warm_ups.withColumn("k", F.lit(1)), "k").drop("k")


@query(
    "generation_run",
    f"SELECT task_id, split, CASE WHEN ok THEN 'SELECT ' || n || ';' END AS gen_sql, CASE WHEN ok THEN 'ok' ELSE 'empty' END AS parse_status FROM ({_STUB}) s",
)
def _(spark, sf):
    result = runs.generate(_qa(spark, sf), "qwq", stub_client, options=_OPTIONS)
    return result.rows.select("task_id", "split", "gen_sql", "parse_status")


_JUDGED = f"SELECT task_id, n, n % 7 <> 0 AND n % 11 <> 0 AS ok FROM (SELECT task_id, length({_fill('verdict')}) AS n FROM {{qa}} q) x"


@query(
    "verification_run",
    f"""SELECT 'qwq' AS tested_model, 'judge' AS evaluator_model, 'd' AS test_dataset, CAST(count(*) AS BIGINT) AS test_size,
        CAST(count(*) FILTER (ok AND n % 2 = 1) AS BIGINT) AS successful_count,
        round(count(*) FILTER (ok AND n % 2 = 1) * 100.0::DOUBLE / count(*), 4) AS accuracy,
        'correct: ' || count(*) FILTER (ok AND n % 2 = 1) || '/' || count(*) AS comments, 'verification' AS phase FROM ({_JUDGED}) j""",
)
def _(spark, sf):
    results = _gen(_qa(spark, sf)).withColumn("model", F.lit("qwq"))
    result = runs.verify(results, "judge", stub_client, options=_OPTIONS, dataset_name="d")
    return result.stats.withColumn("accuracy", F.round("accuracy", 4))


@query(
    "verification_flow",
    f"""SELECT 'yes' AS kind, CAST(count(*) FILTER (ok AND n % 2 = 1) AS BIGINT) AS n FROM ({_JUDGED}) j
        UNION ALL SELECT 'no', CAST(count(*) FILTER (ok AND n % 2 = 0) AS BIGINT) FROM ({_JUDGED}) j
        UNION ALL SELECT 'size', CAST(count(*) AS BIGINT) FROM ({_JUDGED}) j
        UNION ALL SELECT 'correct', CAST(count(*) FILTER (ok AND n % 2 = 1) AS BIGINT) FROM ({_JUDGED}) j""",
)
def _(spark, sf):
    results = _gen(_qa(spark, sf)).withColumn("model", F.lit("qwq"))
    target = stage_path(spark, "verification")
    # The second run takes up what the first one left.
    flows.verification_flow(results.where("split = 'en'"), "judge", stub_client, target, options=_OPTIONS, dataset_name="first")
    flows.verification_flow(results, "judge", stub_client, target, options=_OPTIONS, dataset_name="all")
    cases = spark.read.parquet(f"{target}/cases").groupBy("kind").agg(F.count("*").alias("n"))
    logged = stats.read_stats(spark, f"{target}/stats").where("test_dataset = 'all'")
    sums = logged.select(F.explode(F.create_map(F.lit("size"), "test_size", F.lit("correct"), "successful_count")).alias("kind", "n"))
    return cases.unionByName(sums)


def _split_copies(spark, target, names):
    """How often a row of a split is in the published table, the JSON lines and the CSV."""
    schema = spark.read.parquet(f"{target}/rows").drop("split").schema
    out = spark.read.parquet(f"{target}/published").select("task_id", "split", "gen_sql")
    for name in names:
        lines = spark.read.schema("task_id bigint, gen_sql string").json(f"{target}/jsonl/split={name}")
        cells = spark.read.schema(schema).options(header="true", multiLine="true", quote='"', escape='"', nullValue="\\N").csv(f"{target}/csv/split={name}")
        for df in (lines, cells):
            out = out.unionByName(df.select("task_id", F.lit(name).alias("split"), "gen_sql"))
    return out.groupBy("task_id", "split", "gen_sql").agg(F.count("*").cast("int").alias("copies"))


@query(
    "split_flow",
    f"SELECT task_id, split, CASE WHEN ok THEN 'SELECT ' || n || ';' END AS gen_sql, 3 AS copies FROM ({_STUB}) s WHERE split <> 'fr'",
)
def _(spark, sf):
    qa, target = _qa(spark, sf), stage_path(spark, "splits")
    parts = {name: qa.where(F.col("split") == name) for name in ("de", "en", "es")}
    # A split whose rows cannot be read fails and is named, the others do not.
    broken = qa.where("split = 'fr'").withColumn("question", F.raise_error(F.lit("unreadable")).cast("string"))
    failed = flows.split_flow({**parts, "fr": broken}, "qwq", stub_client, target, options=_OPTIONS)
    if list(failed) != ["fr"] or "unreadable" not in failed["fr"]:
        raise ValueError(f"failed splits: {failed}")
    return _split_copies(spark, target, parts)


@query(
    "split_flow_head",
    f"""SELECT task_id, split, CASE WHEN ok THEN 'SELECT ' || n || ';' END AS gen_sql, 3 AS copies
        FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY task_id) AS r FROM ({_STUB}) s) t WHERE r <= 20""",
)
def _(spark, sf):
    qa, target = _qa(spark, sf), stage_path(spark, "splits")
    parts = {name: qa.where(F.col("split") == name) for name in ("de", "en", "es", "fr")}
    flows.split_flow(parts, "qwq", stub_client, target, 20, options=_OPTIONS)
    return _split_copies(spark, target, parts)


def breaking_client():
    """The stub, but some requests end the worker: the run breaks off half way."""
    call = stub_client()

    def broken(request_json, attempt):
        if zlib.crc32(request_json.encode()) % 50 == 0:
            raise SystemExit("the worker is lost")
        return call(request_json, attempt)

    return broken


@query(
    "broken_run_resumed",
    f"""SELECT task_id, CAST(attempts AS BIGINT) AS calls, CAST(1 AS BIGINT) AS ends,
        CASE WHEN ok THEN 'SELECT ' || n || ';' END AS gen_sql FROM ({_STUB}) s""",
)
def _(spark, sf):
    """A run that breaks off half way and is started again: every call is in the log once, every request has one end."""
    options = runs.RunOptions(max_attempts=4, backoff_s=0.0, partitions=64, concurrency=2, attempts_path=stage_path(spark, "calls"))
    try:
        runs.generate(_qa(spark, sf), "qwq", breaking_client, options=options)
    except Exception:
        pass
    rows = runs.generate(_qa(spark, sf), "qwq", stub_client, options=options)
    ends = rows.attempts.groupBy("task_id").agg(F.count("*").alias("calls"), F.count_if("last").alias("ends"))
    return ends.join(rows.rows.select("task_id", "gen_sql"), "task_id")


def unreadable_client():
    """Every third prompt length is answered with no JSON first, with no answer text then, and readably at last."""
    call = stub_client()

    def answer(request_json, attempt):
        if len(json.loads(request_json)["prompt"]) % 3 == 0 and attempt <= 2:
            return "Sorry, here it comes" if attempt == 1 else json.dumps({"response": None})
        return call(request_json, attempt)

    return answer


@query(
    "unreadable_answers",
    f"""SELECT task_id, CASE WHEN n % 3 <> 0 THEN attempts WHEN n % 7 = 0 THEN 3 WHEN n % 11 = 0 THEN 4 ELSE 3 END::BIGINT AS calls,
        CASE WHEN n % 3 = 0 THEN 2 ELSE 0 END::BIGINT AS unreadable, CASE WHEN ok THEN 'SELECT ' || n || ';' END AS gen_sql FROM ({_STUB}) s""",
)
def _(spark, sf):
    result = runs.generate(_qa(spark, sf), "qwq", unreadable_client, options=_OPTIONS)
    calls = result.attempts.groupBy("task_id").agg(
        F.count("*").alias("calls"), F.count_if(F.col("error") == "response could not be read").alias("unreadable")
    )
    return calls.join(result.rows.select("task_id", "gen_sql"), "task_id")


def refusing_judge():
    """The stub for verdicts, but out of order for every fifth prompt length."""
    call = stub_client()

    def judge(request_json, attempt):
        if len(json.loads(request_json)["prompt"]) % 5 == 0:
            raise invoke.CallError("out of order", 503)
        return call(request_json, attempt)

    return judge


@query(
    "failed_verdicts_repeated",
    f"""SELECT 'first' AS run, CAST(count(*) FILTER (ok AND n % 5 <> 0 AND n % 2 = 1) AS BIGINT) AS correct,
          CAST(count(*) FILTER (ok AND n % 5 <> 0) AS BIGINT) AS verdicts FROM ({_JUDGED}) j
        UNION ALL SELECT 'second', CAST(count(*) FILTER (ok AND n % 2 = 1) AS BIGINT), CAST(count(*) FILTER (ok) AS BIGINT) FROM ({_JUDGED}) j""",
)
def _(spark, sf):
    """Rows whose call failed are asked again by the next run; those with a verdict are not."""
    results = _gen(_qa(spark, sf)).withColumn("model", F.lit("qwq"))
    target, out = stage_path(spark, "verification"), None
    for name, client in (("first", refusing_judge), ("second", stub_client)):
        stats_of = flows.verification_flow(results, "judge", client, target, options=_OPTIONS, dataset_name="d")
        cases = spark.read.parquet(f"{target}/cases").agg(F.count("*").alias("verdicts"))
        row = stats_of.select(F.lit(name).alias("run"), F.col("successful_count").alias("correct"))
        # Written, since the next run adds to the cases.
        row = stage(row.join(F.broadcast(cases)), "verdict-counts")
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "warmed_run",
    f"""SELECT model, warm, CASE WHEN warm THEN 0 ELSE 1 END::INTEGER AS errors, (SELECT count(*) FROM ({_STUB}) s)::BIGINT AS requests
        FROM (VALUES ('gone', false), ('qwq', true)) v(model, warm)""",
)
def _(spark, sf):
    """Warm-up calls are reported apart; a model that does not warm up is a warning, and its run goes on."""

    def client():
        call = stub_client()

        def answer(request_json, attempt):
            if '"hello"' in request_json:
                if "gone" in request_json:
                    raise invoke.CallError("no such model", 404)
                return json.dumps({"response": "hi"})
            return call(request_json, attempt)

        return answer

    options = runs.RunOptions(max_attempts=4, backoff_s=0.0, warm_up="hello")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        result = runs.generate(_qa(spark, sf), ["qwq", "gone"], client, options=options)
    asked = result.attempts.where("last").groupBy("model").agg(F.count("*").alias("requests"))
    warm = result.warm_ups.select("model", F.col("ok").alias("warm"), F.col("error").isNotNull().cast("int").alias("errors"))
    return warm.join(asked, "model")


@query(
    "result_log_written",
    f"SELECT CAST(task_id AS VARCHAR) AS task_id, NOT ok AS failed, CAST(3 AS INTEGER) AS n_elements FROM ({_STUB}) s",
)
def _(spark, sf):
    requests = prompts.build_requests(prompts.generation_prompts(_qa(spark, sf), "qwq"), "qwq")
    attempts = invoke.invoke(requests, stub_client, max_attempts=4, backoff_s=0.0)
    path = stage_path(spark, "log")
    logs.write_result_log(requests, attempts, path)
    return logs.read_result_log(spark, path).where("bad_line IS NULL").select("task_id", "failed", "n_elements")


@query(
    "translation_run",
    f"""SELECT task_id, split, CASE WHEN ok THEN 'Q' || n END AS e_question, CASE WHEN ok THEN 'SELECT ' || n END AS e_answer, CASE WHEN ok THEN 'ok' ELSE 'rejected' END AS parse_status
        FROM (SELECT task_id, split, n, n % 7 <> 0 AND n % 11 <> 0 AS ok FROM (SELECT task_id, split, length({_fill('translate')}) AS n FROM {{qa}} q) x) y""",
)
def _(spark, sf):
    result = runs.generate(_qa(spark, sf), "qwq", stub_client, ColumnRoles(input="question"), _OPTIONS, mode="translate")
    return result.rows.select("task_id", "split", "e_question", "e_answer", "parse_status")


@query(
    "generation_resumed",
    f"SELECT task_id, CASE WHEN split = 'en' THEN 'earlier' WHEN ok THEN 'SELECT ' || n || ';' END AS gen_sql FROM ({_STUB}) s",
)
def _(spark, sf):
    qa = _qa(spark, sf)
    schema = StructType([StructField("task_id", LongType()), StructField("gen_sql", StringType())])
    path = artifacts.artifact_path(spark, stage_path(spark, "results"), "org/qa:a:test", "qwq:7b", "judge:27b")
    earlier = qa.where("split = 'en'").select("task_id", F.lit("earlier").alias("gen_sql"))
    artifacts.resume_stage(earlier, path, ["task_id"], lambda rows: rows, schema)
    ask = lambda rows: runs.generate(rows, "qwq", stub_client, options=_OPTIONS).rows
    return artifacts.resume_stage(qa, path, ["task_id"], ask, schema)


_PROBE = "102"


@query(
    "benchmark_run",
    f"""SELECT model, n AS test_no, {_PROBE}::INTEGER AS prompt_length, CASE WHEN n = 1 THEN 'cold' ELSE 'warm' END AS start_type,
        ({_PROBE} * 1000 // 1000) / 1e6 AS load_s, {_PROBE} * 1000 / 1e6 AS first_token_s, {_PROBE} * 3000 / 1e6 AS total_s,
        CAST(length(model) AS BIGINT) AS tokens, (length(model) * 100000000 // ({_PROBE} * 3000)) / 100.0::DOUBLE AS tokens_per_s
        FROM (SELECT DISTINCT source AS model FROM documents) d, (SELECT unnest([1, 2, 3])::INTEGER AS n) t""",
)
def _(spark, sf):
    models = table(spark, sf, "documents").select(F.col("source").alias("model")).distinct()
    options = runs.RunOptions(max_attempts=1, concurrency=4, backoff_s=0.0)
    return runs.benchmark(models, stub_client, 3, 102, options=options).drop("cpu_pct", "mem", "gpu_mem")


_MATRIX_RUN = f"""SELECT task_id, model, n, n % 7 <> 0 AND n % 11 <> 0 AS ok FROM (
    SELECT task_id, m AS model, CASE WHEN m LIKE 'sqlcoder%' THEN length({_fill('generate_tagged')}) ELSE length({_fill('generate')}) END AS n
    FROM {{qa}} q, (SELECT unnest(['qwq', 'sqlcoder:15b']) AS m) t) x"""
_MATRIX_SQL = "CASE WHEN ok THEN 'SELECT ' || n || ';' END"
_MATRIX_JUDGED = f"""SELECT model, judge, k, k % 7 <> 0 AND k % 11 <> 0 AND k % 2 = 1 AS correct FROM (
    SELECT r.model, judge, length({_fill('verdict', gen_sql='r.sql')}) AS k
    FROM (SELECT task_id, model, {_MATRIX_SQL} AS sql FROM ({_MATRIX_RUN}) y) r JOIN {{qa}} q USING (task_id),
         (SELECT unnest(['judge-a', 'judge-b']) AS judge) t) z"""


@query(
    "matrix_run",
    f"""SELECT model AS tested_model, judge AS evaluator_model, CAST(count(*) AS BIGINT) AS test_size, CAST(count(*) FILTER (correct) AS BIGINT) AS successful_count,
        round(count(*) FILTER (correct) * 100.0::DOUBLE / count(*), 4) AS accuracy FROM ({_MATRIX_JUDGED}) j GROUP BY model, judge""",
)
def _(spark, sf):
    """Two models and two evaluators in one plan each."""
    generated = runs.generate(_qa(spark, sf), ["qwq", "sqlcoder:15b"], stub_client, options=_OPTIONS)
    stats = runs.verify(generated.rows, ["judge-a", "judge-b"], stub_client, options=_OPTIONS).stats
    return stats.select(
        "tested_model", "evaluator_model", "test_size", "successful_count", F.round("accuracy", 4).alias("accuracy")
    )
