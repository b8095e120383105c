"""Orders over attempts: cold starts, admission slots, cool-down and progress."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalflow.functions.errors import RATE_LIMIT
from evalflow.functions.times import micros
from evalflow.operators.ids import running_values
from evalflow.operators.outcomes import ratio


def with_start_type(
    tests: DataFrame, model: str = "model", test_no: str = "test_no", force_cold: bool = False
) -> DataFrame:
    """Label a model's first test (or all, when forced) ``cold``, the others ``warm``.

    The first test is a minimum per model, combined before the shuffle and joined back; whether the
    minima are broadcast is left to their measured size.
    """
    if force_cold:
        return tests.withColumn("start_type", F.lit("cold"))
    first = tests.groupBy(F.col(model).alias("_model")).agg(F.min(test_no).alias("_first"))
    label = F.when(F.col(test_no) == F.col("_first"), "cold").otherwise("warm")
    joined = tests.join(first, F.col(model).eqNullSafe(F.col("_model")), "left")
    return joined.withColumn("start_type", label).drop("_model", "_first")


def plan_admission(
    requests: DataFrame,
    max_requests: int = 2500,
    max_tokens: int = 100_000,
    order: Sequence[str] = ("task_id",),
    tokens: str = "tokens",
) -> DataFrame:
    """Add ``slot``: the minute a request is sent in when both budgets bind.

    Each request uses up the larger of its two budget shares, 1/R and tokens/T. The slot is the
    whole part of the shares used before it, so a slot takes at most R requests and exceeds T by
    less than its last request. Shares are counted in units of 1/(R*T) to stay exact.
    """
    cost = F.greatest(
        F.lit(max_tokens).cast("decimal(38,0)"),
        F.coalesce(tokens, F.lit(0)).cast("decimal(20,0)") * F.lit(max_requests).cast("decimal(10,0)"),
    ).cast("decimal(28,0)")
    used = running_values(requests.withColumn("_cost", cost), order, {"_used": ("sum", F.col("_cost"))})
    before = F.col("_used") - F.col("_cost")
    # Whole-number division: a decimal quotient is rounded and can step into the next slot.
    used = used.withColumns({"_before": before, "_budget": F.lit(max_requests * max_tokens).cast("decimal(20,0)")})
    return used.withColumn("slot", F.expr("_before div _budget")).drop("_cost", "_used", "_before", "_budget")


def with_cooldown(
    attempts: DataFrame,
    cooldown_s: int = 15,
    time: str = "ts",
    keys: Sequence[str] = ("model",),
    tie: Sequence[str] = ("task_id",),
) -> DataFrame:
    """Add ``in_cooldown``: less than the cool-down time has passed since a rate limit of the model.

    The last rate limit is a running maximum; among equal times rate limits come first, so that
    their peers see them.
    """
    limited = F.coalesce(F.col("error_class") == RATE_LIMIT, F.lit(False))
    rows = attempts.withColumn("_free", F.when(limited, 0).otherwise(1))
    last = running_values(
        rows, [time, "_free", *tie], {"_last": ("max", F.when(limited, F.col(time)))}, group=list(keys)
    )
    passed = micros(F.col(time)) - micros(F.col("_last"))
    flag = F.coalesce(passed < F.lit(cooldown_s * 1_000_000), F.lit(False))
    return last.withColumn("in_cooldown", flag).drop("_free", "_last")


def first_outcomes(attempts: DataFrame, keys: Sequence[str] = ("run", "task_id"), time: str = "end_ts", tie: str = "attempt") -> DataFrame:
    """The first recorded outcome of each task; later ones do not count.

    Of ``outcomes.terminal_attempts`` this is the outcome a task ends with; of all attempts it is the literal first one,
    which counts a failure that was retried.
    """
    first = F.min_by(F.struct(time, "ok"), F.struct(time, tie))
    return attempts.groupBy(*keys).agg(first.alias("_first")).select(*keys, "_first.*")


def running_progress(outcomes: DataFrame, run: str = "run", time: str = "end_ts", task: str = "task_id") -> DataFrame:
    """Completed, successful and failed tasks so far, and the completion rate per second of the run."""
    ok = F.coalesce(F.col("ok"), F.lit(False))
    progress = running_values(
        outcomes.withColumn("_t", micros(F.col(time))),
        [time, task],
        {
            "completed": ("sum", F.lit(1).cast("bigint")),
            "successful": ("sum", F.when(ok, 1).otherwise(0).cast("bigint")),
            "_minus_start": ("max", -F.col("_t")),
        },
        group=[run],
    )
    elapsed = (F.col("_t") + F.col("_minus_start")) / F.lit(1e6)
    return progress.withColumns(
        {
            "failed": F.col("completed") - F.col("successful"),
            "elapsed_s": elapsed,
            "rate": ratio(F.col("completed"), elapsed),
        }
    ).drop("_t", "_minus_start")
