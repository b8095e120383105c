"""Generation, verification, batch and benchmark runs."""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalflow.functions.latency import with_response_latency
from evalflow.functions.responses import response_content, translation
from evalflow.functions.sql_text import generated_sql
from evalflow.functions.times import seconds_between
from evalflow.operators.ids import assign_task_ids
from evalflow.operators.invoke import ClientFactory, invoke, latest_outcome
from evalflow.operators.joins import benchmark_matrix, join_verdicts, tidy_verdicts
from evalflow.operators.outcomes import generation_stats, verification_stats, with_verdict
from evalflow.operators.prompts import (
    build_requests,
    generation_prompts,
    probe_prompts,
    translation_prompts,
    verdict_prompts,
)
from evalflow.operators.shape import pending_rows
from evalflow.operators.timeline import with_start_type
from evalflow.sources.datasets import ColumnRoles


@dataclass(frozen=True)
class RunOptions:
    """How the calls of a run are made.

    ``accept`` says by mode whether an answer can be read (`readable` where a mode is not named, None: every answer is taken);
    one that cannot is asked for again. With ``attempts_path`` calls are kept as they are made, below a folder per
    mode, and a run that was broken off goes on with what is left. ``warm_up`` is a prompt that every model is sent
    once before the run.
    """

    max_attempts: int = 10
    concurrency: int = 10
    backoff_s: float = 1.0
    partitions: int | None = None
    timeout_s: float | None = 300.0
    accept: Mapping[str, Callable[[str], bool] | None] = field(default_factory=dict)
    attempts_path: str | None = None
    buckets: int = 1
    warm_up: str | None = None


@dataclass(frozen=True)
class RunResult:
    """Rows of a run, the attempts behind them, the statistics, and the warm-up calls if there were any."""

    rows: DataFrame
    attempts: DataFrame
    stats: DataFrame
    warm_ups: DataFrame | None = None


def _answer(response: str) -> str | None:
    """The answer text of a response in either shape; None where there is none."""
    try:
        found = json.loads(response)
        if found.get("choices"):
            return found["choices"][0]["message"]["content"]
        return found["response"] if "response" in found else found["message"]["content"]
    except (ValueError, TypeError, AttributeError, KeyError, IndexError):
        return None


def readable(mode: str) -> Callable[[str], bool]:
    """Whether a response has an answer text, which for a translation has to be a JSON object."""

    def read(response: str) -> bool:
        answer = _answer(response)
        if not isinstance(answer, str) or (mode != "text" and not answer.strip()):
            return False
        if mode != "translate":
            return True
        try:
            return isinstance(json.loads(answer), dict)
        except ValueError:
            return False

    return read


def _warmed(spark: SparkSession, models: Sequence[str], mode: str, client_factory: ClientFactory, options: RunOptions) -> DataFrame | None:
    """The warm-up calls of a run's models, one after the other; a failure is a warning."""
    if options.warm_up is None:
        return None
    rows = spark.createDataFrame([(-1 - k, m, options.warm_up) for k, m in enumerate(models)], "task_id bigint, model string, prompt string")
    requests = build_requests(rows, F.col("model"), mode).select("task_id", "model", "request")
    calls = invoke(
        requests, client_factory, max_attempts=1, concurrency=1, partitions=1, phase="warmup", timeout_s=options.timeout_s
    )
    for failed in calls.where("not ok").select("model", "error").collect():
        warnings.warn(f"warm-up of {failed['model']} failed: {failed['error']}", stacklevel=3)
    return calls.select("model", "ok", "error", seconds_between(F.col("start_ts"), F.col("end_ts")).alias("seconds"))


def _call(
    prompted: DataFrame, mode: str, client_factory: ClientFactory, options: RunOptions, carry: Sequence[str] = ()
) -> DataFrame:
    """Attempts for rows with ``task_id``, ``model`` and ``prompt``."""
    requests = build_requests(prompted, F.col("model"), mode).select("task_id", "model", "request", *carry)
    return invoke(
        requests,
        client_factory,
        max_attempts=options.max_attempts,
        concurrency=options.concurrency,
        backoff_s=options.backoff_s,
        partitions=options.partitions,
        timeout_s=options.timeout_s,
        accept=options.accept.get(mode, readable(mode)),
        attempts_path=options.attempts_path and f"{options.attempts_path}/{mode}",
        buckets=options.buckets,
        carry=carry,
    )


def _outcomes(attempts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per request with its last answer text and the time span of all its attempts.

    The last attempt is marked, so answers are filtered, not sorted; only times are aggregated.
    """
    spans = attempts.groupBy(*keys).agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"))
    answers = attempts.where("last").select(*keys, response_content(F.col("response")).alias("content"))
    return answers.join(spans, list(keys))


def _named(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def _each(df: DataFrame, names: str | Sequence[str], column: str) -> DataFrame:
    """The rows once per name of a short list of models."""
    return df.withColumn(column, F.explode(F.array(*[F.lit(n) for n in _named(names)])))


def generate(
    dataset: DataFrame,
    models: str | Sequence[str],
    client_factory: ClientFactory,
    roles: ColumnRoles | None = None,
    options: RunOptions | None = None,
    mode: str = "generate",
    dataset_name: str = "",
    done: DataFrame | None = None,
    by: Sequence[str] = (),
) -> RunResult:
    """Ask one or more models for SQL (or a translation) of every row; the dataset needs a ``task_id``.

    The result holds every row once per model, told apart by the column ``model``. ``done`` holds the
    keys of earlier output (``task_id``, and ``model`` if it is there); those rows are not asked again.
    Splits are a column, so all models and splits run as one plan; ``by`` names columns without which a ``task_id`` is not
    unique.
    """
    roles, options = roles or ColumnRoles(), options or RunOptions()
    keys = ["task_id", "model", *by]
    warm = _warmed(dataset.sparkSession, _named(models), mode, client_factory, options)
    asked = _each(dataset, models, "model")
    if done is not None:
        asked = pending_rows(asked, done, [k for k in keys if k in done.columns])
    translate = mode == "translate"
    prompted = translation_prompts(asked, roles) if translate else generation_prompts(asked, F.col("model"), roles)
    attempts = _call(prompted, mode, client_factory, options, carry=by)
    answers = _outcomes(attempts, keys)
    if translate:
        parsed = answers.withColumn("_t", translation(F.col("content"))).select(
            *keys,
            "_t.*",
            F.when(F.col("_t.e_question").isNull(), "rejected").otherwise("ok").alias("parse_status"),
            "start_ts",
            "end_ts",
        )
    else:
        parsed = answers.withColumn("_sql", generated_sql(F.col("content"))).select(
            *keys,
            F.col("_sql.gen_sql").alias(roles.output),
            F.col("_sql.parse_status").alias("parse_status"),
            "start_ts",
            "end_ts",
        )
    rows = asked.drop(*[c for c in parsed.columns if c not in keys]).join(parsed, keys, "left")
    measured = rows.withColumns(
        {
            "tested_model": F.col("model"),
            "test_dataset": F.lit(dataset_name),
            "ok": F.col("parse_status").eqNullSafe("ok"),
        }
    )
    return RunResult(rows.drop("start_ts", "end_ts"), attempts, generation_stats(measured), warm)


def verify(
    results: DataFrame,
    evaluators: str | Sequence[str],
    client_factory: ClientFactory,
    roles: ColumnRoles | None = None,
    options: RunOptions | None = None,
    dataset_name: str = "",
    done: DataFrame | None = None,
) -> RunResult:
    """Ask one or more evaluators about every generated query and compute the accuracy.

    ``results`` are the rows of ``generate``. ``done`` holds the verdicts of earlier runs (``task_id, tested_model,
    evaluator_model``); those are not asked again and do not count in the result. The verdicts are joined back to their rows by task and
    model; the statistics have one row per model and evaluator.
    """
    roles, options = roles or ColumnRoles(), options or RunOptions()
    answers = results.withColumnRenamed("model", "tested_model")
    asked = _each(answers, evaluators, "model")
    if done is not None:
        earlier = done.select("task_id", "tested_model", F.col("evaluator_model").alias("model"))
        asked = pending_rows(asked, earlier, ["task_id", "tested_model", "model"])
    warm = _warmed(results.sparkSession, _named(evaluators), "verdict", client_factory, options)
    attempts = _call(verdict_prompts(asked, roles), "verdict", client_factory, options, carry=["tested_model"])
    read = with_verdict(_outcomes(attempts, ["task_id", "tested_model", "model"]))
    verdicts = tidy_verdicts(read.select("task_id", "tested_model", F.col("model").alias("evaluator_model"), "resolve_yn"))
    joined = join_verdicts(verdicts, answers, roles, keys=["tested_model"])
    names = ["tested_model", "evaluator_model", "test_dataset"]
    stats = verification_stats(
        asked.withColumnsRenamed({"model": "evaluator_model"}).withColumn("test_dataset", F.lit(dataset_name)),
        verdicts.withColumn("test_dataset", F.lit(dataset_name)),
        names,
    )
    return RunResult(joined, attempts, stats, warm)


def benchmark(
    models: DataFrame,
    client_factory: ClientFactory,
    repeats: int = 5,
    prompt_length: int = 100,
    force_cold: bool = False,
    options: RunOptions | None = None,
) -> DataFrame:
    """Latency rows of ``repeats`` tests per model; a failed test keeps only its measured time.

    Models are spread over the tasks; the tests of one model run one after the other, in order, unless ``options`` asks
    for several calls at a time.
    """
    options = options or RunOptions(max_attempts=1, concurrency=1)
    tests = assign_task_ids(benchmark_matrix(models, repeats), ["model", "test_no"])
    requests = build_requests(probe_prompts(tests, prompt_length), F.col("model"), "text")
    attempts = invoke(
        requests,
        client_factory,
        max_attempts=options.max_attempts,
        concurrency=options.concurrency,
        backoff_s=options.backoff_s,
        partitions=options.partitions,
        timeout_s=options.timeout_s,
        accept=options.accept.get("text"),
        attempts_path=options.attempts_path and f"{options.attempts_path}/benchmark",
        buckets=options.buckets,
        spread=["model"],
    )
    last = latest_outcome(attempts.drop("model", "phase"))
    timed = with_response_latency(last, F.col("response"), seconds_between(F.col("start_ts"), F.col("end_ts")))
    fields = ("load_s", "first_token_s", "total_s", "tokens", "tokens_per_s")
    missing = F.lit(None).cast("double")
    rows = with_start_type(tests, force_cold=force_cold).join(timed.select("task_id", *fields), "task_id", "left")
    return rows.select(
        "model",
        "test_no",
        F.lit(prompt_length).alias("prompt_length"),
        "start_type",
        "load_s",
        "first_token_s",
        "total_s",
        "tokens",
        "tokens_per_s",
        *[missing.alias(c) for c in ("cpu_pct", "mem", "gpu_mem")],
    )
