"""Statistics of runs, attempts and verdicts. All of them combine before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalflow.functions.errors import API, OTHER, RATE_LIMIT, error_class
from evalflow.functions.naming import model_size
from evalflow.functions.times import seconds_between
from evalflow.functions.verdict import lenient_verdict, strict_verdict


def with_verdict(df: DataFrame, content: str = "content", name: str = "resolve_yn") -> DataFrame:
    """Add the strict verdict of an answer."""
    return df.withColumn(name, strict_verdict(F.col(content)))


def with_lenient_verdict(df: DataFrame, content: str = "content", name: str = "resolve_yn") -> DataFrame:
    return df.withColumn(name, lenient_verdict(F.col(content)))


def percent(part: Column, whole: Column) -> Column:
    """Share in percent; 0 for an empty whole."""
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def wall_seconds(start: str = "start_ts", end: str = "end_ts") -> Column:
    """Aggregate: seconds from the first start to the last end."""
    return F.coalesce(seconds_between(F.min(start), F.max(end)), F.lit(0.0))


def _outcome_columns(total: Column, ok: Column, failed: Column, seconds: Column) -> dict[str, Column]:
    return {
        "accuracy": percent(ok, total),
        "avg_processing_time": ratio(seconds, total),
        "batch_throughput": ratio(total, seconds),
        "success_rate": percent(ok, total),
        "error_rate": percent(failed, total),
        "avg_translation_time_s": ratio(seconds, total),
        "throughput": ratio(total, seconds),
        "comments": F.format_string("ok: %d, failed: %d", ok, failed),
    }


def generation_stats(
    outcomes: DataFrame, keys: Sequence[str] = ("tested_model", "test_dataset"), ok: str = "ok"
) -> DataFrame:
    """Run statistics of the generation step: one outcome row per dataset row, with start and end times."""
    return generation_stats_of(generation_counts(outcomes, keys, ok), keys)


def generation_counts(
    outcomes: DataFrame, keys: Sequence[str] = ("tested_model", "test_dataset"), ok: str = "ok"
) -> DataFrame:
    """Counts and times of outcome rows that can be added up over parts of a run."""
    return outcomes.groupBy(*keys).agg(
        F.count("*").alias("test_size"),
        F.count_if(F.col(ok)).alias("successful_count"),
        F.count_if(~F.coalesce(F.col(ok), F.lit(False))).alias("failed_count"),
        F.min("start_ts").alias("start_ts"),
        F.max("end_ts").alias("end_ts"),
    )


def generation_stats_of(counts: DataFrame, keys: Sequence[str] = ("tested_model", "test_dataset")) -> DataFrame:
    """Run statistics from the counts of one or more parts of each run."""
    counted = counts.groupBy(*keys).agg(
        F.sum("test_size").alias("test_size"),
        F.sum("successful_count").alias("successful_count"),
        F.sum("failed_count").alias("_failed"),
        wall_seconds().alias("_seconds"),
    )
    columns = _outcome_columns(F.col("test_size"), F.col("successful_count"), F.col("_failed"), F.col("_seconds"))
    stats = counted.withColumns({**columns, "phase": F.lit("translation")})
    if "tested_model" in keys:
        stats = stats.withColumn("model_size", model_size(F.col("tested_model")))
    return stats.drop("_failed", "_seconds")


def verification_stats(dataset: DataFrame, verdicts: DataFrame, keys: Sequence[str] = ("tested_model",)) -> DataFrame:
    """Accuracy: verdicts ``yes`` per row of the dataset (not per verdict).

    Both sides are aggregated before they are joined.
    """
    sizes = dataset.groupBy(*keys).agg(F.count("*").alias("test_size"))
    correct = verdicts.groupBy(*keys).agg(F.count_if(F.col("resolve_yn") == "yes").alias("_correct"))
    found = F.coalesce("_correct", F.lit(0)).cast("bigint")
    return (
        sizes.join(correct, list(keys), "left")
        .withColumn("successful_count", found)
        .withColumn("accuracy", percent(F.col("successful_count"), F.col("test_size")))
        .withColumn("comments", F.format_string("correct: %d/%d", "successful_count", "test_size"))
        .withColumn("phase", F.lit("verification"))
        .drop("_correct")
    )


def verdict_distribution(verdicts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return verdicts.groupBy(*keys, "resolve_yn").agg(F.count("*").alias("n"))


def verdict_summary(verdicts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts of yes, no and everything else."""
    yes, no = F.col("resolve_yn").eqNullSafe("yes"), F.col("resolve_yn").eqNullSafe("no")
    return verdicts.groupBy(*keys).agg(
        F.count_if(yes).alias("yes"), F.count_if(no).alias("no"), F.count_if(~yes & ~no).alias("other")
    )


def parse_counts(parsed: DataFrame, keys: Sequence[str] = (), status: str = "parse_status") -> DataFrame:
    """Numbers of responses that could and could not be read."""
    ok = F.col(status).eqNullSafe("ok")
    return parsed.groupBy(*keys).agg(F.count_if(ok).alias("success_count"), F.count_if(~ok).alias("error_count"))


def transform_counts(parsed: DataFrame, flag: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Retained and skipped rows of a transform, in one pass."""
    keep = F.coalesce(flag, F.lit(False))
    return parsed.groupBy(*keys).agg(F.count_if(keep).alias("retained"), F.count_if(~keep).alias("skipped"))


def log_summary(log: DataFrame, total: int | Column | None = None) -> DataFrame:
    """Completion of a parsed result log; lines with a single element do not count.

    ``total`` is the number of requests; without it the log lines are counted.
    """
    counts = log.where(F.col("bad_line").isNull()).agg(
        F.count("*").alias("_lines"),
        F.count_if((F.col("n_elements") > 1) & ~F.col("failed")).alias("successful"),
        F.count_if((F.col("n_elements") > 1) & F.col("failed")).alias("failed"),
    )
    whole = F.col("_lines") if total is None else (F.lit(total) if isinstance(total, int) else total)
    done = F.col("successful") + F.col("failed")
    return counts.select(
        whole.cast("bigint").alias("total_requests"),
        done.alias("completed"),
        "successful",
        "failed",
        percent(done, whole).alias("completion_pct"),
        percent(F.col("successful"), whole).alias("success_pct"),
        percent(F.col("failed"), whole).alias("failure_pct"),
    )


def error_classes(attempts: DataFrame, error: str = "error", api_error: str | None = None) -> DataFrame:
    """Add ``error_class``."""
    api = F.col(api_error) if api_error else None
    return attempts.withColumn("error_class", error_class(F.col(error), api))


def is_final(attempts: DataFrame) -> Column:
    """Whether a failed attempt is one that is not repeated; attempts without the column ``final`` have none."""
    return F.coalesce(F.col("final"), F.lit(False)) if "final" in attempts.columns else F.lit(False)


def terminal_attempts(attempts: DataFrame, max_attempts: int = 3) -> DataFrame:
    """The attempts that end a request: a success, a final failure, or the last one that is allowed."""
    ok = F.coalesce(F.col("ok"), F.lit(False))
    return attempts.where(ok | is_final(attempts) | (F.col("attempt") >= max_attempts))


def final_status(attempts: DataFrame, max_attempts: int = 3, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """Status of each request after its attempts: success, retry, failed; never started is pending."""
    status = (
        F.when(F.col("_ok"), "success")
        .when(F.col("attempts") == 0, "pending")
        .when(~F.col("_final") & (F.col("attempts") < max_attempts), "retry")
        .otherwise("failed")
    )
    folded = attempts.groupBy(*keys).agg(
        F.count("attempt").alias("attempts"),
        F.coalesce(F.bool_or("ok"), F.lit(False)).alias("_ok"),
        F.bool_or(is_final(attempts)).alias("_final"),
    )
    return folded.withColumn("status", status).drop("_ok", "_final")


def status_counters(attempts: DataFrame, status: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Started, succeeded and failed requests and errors by class.

    ``attempts`` needs ``error_class``; ``status`` is the result of ``final_status``. Rate limits do
    not count as API errors.
    """
    tasks = status.groupBy(*keys).agg(
        F.count("*").alias("tasks_started"),
        F.count_if(F.col("status").isin("retry", "pending")).alias("tasks_in_progress"),
        F.count_if(F.col("status") == "success").alias("tasks_succeeded"),
        F.count_if(F.col("status") == "failed").alias("tasks_failed"),
    )
    errors = attempts.groupBy(*keys).agg(
        *[
            F.count_if(F.col("error_class") == kind).alias(f"{name}_errors")
            for kind, name in ((RATE_LIMIT, "rate_limit"), (API, "api"), (OTHER, "other"))
        ]
    )
    if keys:
        return tasks.join(errors, list(keys))
    return tasks.withColumn("_errors", errors.select(F.struct("*")).scalar()).select("*", "_errors.*").drop("_errors")


def batch_metrics(attempts: DataFrame, max_attempts: int = 3, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Summary of a batch from its attempts (``task_id, attempt, start_ts, end_ts, ok, error_class``)."""
    per_task = attempts.groupBy(*keys, "task_id").agg(
        F.coalesce(F.bool_or("ok"), F.lit(False)).alias("_ok"),
        F.count("*").alias("_attempts"),
        F.bool_or(is_final(attempts)).alias("_final"),
        F.min("start_ts").alias("start_ts"),
        F.max("end_ts").alias("end_ts"),
        F.count_if(F.col("error_class") == RATE_LIMIT).alias("_rate"),
        F.count_if(F.col("error_class").isNotNull() & (F.col("error_class") != RATE_LIMIT)).alias("_other"),
    )
    failed = ~F.col("_ok") & (F.col("_final") | (F.col("_attempts") >= max_attempts))
    folded = per_task.groupBy(*keys).agg(
        F.count("*").alias("total_requests"),
        F.count_if(F.col("_ok") | failed).alias("completed_requests"),
        F.count_if("_ok").alias("successful_requests"),
        F.count_if(failed).alias("failed_requests"),
        wall_seconds().alias("elapsed_time"),
        F.sum("_rate").alias("rate_limit_errors"),
        F.sum("_other").alias("other_errors"),
    )
    total, done = F.col("total_requests"), F.col("completed_requests")
    return folded.select(
        *keys,
        "total_requests",
        "completed_requests",
        "successful_requests",
        "failed_requests",
        percent(done, total).alias("completion_percentage"),
        percent(F.col("successful_requests"), total).alias("success_rate"),
        "elapsed_time",
        ratio(F.col("elapsed_time"), done).alias("avg_time_per_request"),
        ratio(done, F.col("elapsed_time")).alias("requests_per_second"),
        "rate_limit_errors",
        "other_errors",
    )


def throughput(attempts: DataFrame, keys: Sequence[str] = ("model",), task: str = "task_id") -> DataFrame:
    """Requests, wall seconds, seconds per request and requests per second; a request counts once, however often tried."""
    per_task = attempts.groupBy(*keys, task).agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"))
    folded = per_task.groupBy(*keys).agg(F.count("*").alias("requests"), wall_seconds().alias("elapsed_s"))
    return folded.withColumns(
        {
            "avg_s_per_request": ratio(F.col("elapsed_s"), F.col("requests")),
            "requests_per_s": ratio(F.col("requests"), F.col("elapsed_s")),
        }
    )


def tokens_per_minute(
    attempts: DataFrame,
    max_requests: int = 2500,
    max_tokens: int = 100_000,
    time: str = "start_ts",
    keys: Sequence[str] = ("model",),
) -> DataFrame:
    """Requests and tokens per minute, with a flag where a budget is exceeded."""
    folded = attempts.groupBy(*keys, F.window(time, "1 minute")["start"].alias("minute")).agg(
        F.count("*").alias("requests"), F.sum("tokens").cast("bigint").alias("tokens")
    )
    over = (F.col("requests") > max_requests) | (F.coalesce("tokens", F.lit(0)) > max_tokens)
    return folded.withColumn("over_budget", over)
