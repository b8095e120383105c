"""Joins of requests, responses, verdicts and datasets by task id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalflow.functions.responses import output_field, recovered_prompt
from evalflow.functions.verdict import normalized_verdict
from evalflow.sources.datasets import ColumnRoles

LOST = "request was not processed (lost)"


def tidy_verdicts(verdicts: DataFrame) -> DataFrame:
    """Normalise ``resolve_yn`` and recover the prompt texts, if there are any."""
    tidy = verdicts.withColumn("resolve_yn", normalized_verdict(F.col("resolve_yn")))
    return tidy.withColumn("prompt", recovered_prompt(F.col("prompt"))) if "prompt" in tidy.columns else tidy


def join_verdicts(
    verdicts: DataFrame, dataset: DataFrame, roles: ColumnRoles | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """Verdicts with the dataset columns they were given for; the column ``answer`` becomes ``gt_sql``.

    Rows are matched by task id and, when the dataset holds answers of several models, further ``keys``.
    Log ids are text and may be missing; they are read as the dataset's type of id, and those that cannot be belong to no row. The dataset side
    is cut to the needed columns. Its ids are unique, so a repeated verdict id never multiplies rows,
    and the adaptive skew join splits an id that repeats very often.
    """
    roles = roles or ColumnRoles()
    wanted = [c for c in (roles.question, roles.answer, roles.output, roles.context) if c in dataset.columns]
    right = dataset.select("task_id", *keys, *dict.fromkeys(wanted))
    left = verdicts.withColumn("task_id", F.col("task_id").try_cast(dataset.schema["task_id"].dataType))
    return left.join(right, ["task_id", *keys], "inner").withColumnRenamed("answer", "gt_sql")


def attach_results(
    dataset: DataFrame, outcomes: DataFrame, result: str = "result", name: str = "gen_sql", keys: Sequence[str] = ("task_id",)
) -> DataFrame:
    """Dataset rows with the output field of their response; failed rows get NULL.

    ``outcomes`` holds at most one row per task.
    """
    picked = outcomes.select(*keys, output_field(F.col(result), name).alias(name))
    return dataset.join(picked, list(keys), "left")


def lost_requests(requests: DataFrame, log: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """Requests that never show up in the log, as error rows."""
    missing = requests.select(*keys).join(log.select(*keys).distinct(), list(keys), "left_anti")
    return missing.withColumn("error", F.lit(LOST))


def complete_log(requests: DataFrame, log: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """The log plus one error row for every lost request."""
    return log.unionByName(lost_requests(requests, log, keys), allowMissingColumns=True)


def request_response_pairs(requests: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Rows ``request, response, index`` matched by id, so that a failure shifts nothing."""
    answers = outcomes.select("task_id", "response")
    return requests.join(answers, "task_id").select("request", "response", F.col("task_id").alias("index"))


def run_matrix(base: DataFrame, verifiers: DataFrame, column: str = "model", verifier: str = "model") -> DataFrame:
    """One row per base model and distinct verifying model.

    The verifying models, a configuration list, become one array that every base model unfolds; nothing is
    read to the driver.
    """
    listed = verifiers.select(F.collect_set(verifier)).scalar()
    return base.select(F.col(column).alias("base_model"), F.explode(listed).alias("verifying_model"))


def benchmark_matrix(models: DataFrame, repeats: int, column: str = "model") -> DataFrame:
    """One row per model and test number 1..repeats."""
    tests = F.explode(F.sequence(F.lit(1), F.lit(repeats)))
    return models.select(F.col(column).alias("model"), tests.alias("test_no"))
