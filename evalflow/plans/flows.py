"""Whole runs with everything they leave behind: resumed work, cases, statistics, result logs, published tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from evalflow.operators.ids import limit_per_group
from evalflow.operators.invoke import ClientFactory
from evalflow.operators.outcomes import verification_stats
from evalflow.operators.shape import QUESTION_METADATA, PromptHandler, tag_dialects, transform_prompts
from evalflow.plans.runs import RunOptions, generate, verify
from evalflow.sources.datasets import ColumnRoles, publish, write_csv, write_json_lines
from evalflow.sources.stats import append_stats

def _written(df: DataFrame, path: str) -> DataFrame | None:
    """What is at the path, or None where nothing is yet."""
    try:
        return df.sparkSession.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def verification_flow(
    results: DataFrame,
    evaluators: str | Sequence[str],
    client_factory: ClientFactory,
    target: str,
    roles: ColumnRoles | None = None,
    options: RunOptions | None = None,
    dataset_name: str = "",
) -> DataFrame:
    """Verify generated queries; write the cases by verdict and the statistics below ``target``.

    ``cases`` is the table of verdicts, one folder per kind (yes, no, other); a call adds its own rows to it. Rows with a
    verdict there are not asked again, those whose call failed are; the statistics cover the whole table. Returns
    the statistics. Each call appends one row per model and evaluator to the log of statistics.
    """
    cases, names = f"{target}/cases", [evaluators] if isinstance(evaluators, str) else list(evaluators)
    run = verify(results, names, client_factory, roles, options, dataset_name, _written(results, cases))
    kind = F.when(F.col("resolve_yn").isin("yes", "no"), F.col("resolve_yn")).otherwise("other")
    # A failed call has no verdict.
    found = run.rows.where(F.col("resolve_yn").isNotNull()).withColumn("kind", kind)
    found.sortWithinPartitions("task_id").write.mode("append").partitionBy("kind").parquet(cases)
    whole = _written(results, cases)
    if whole is None:  # not one call has succeeded so far
        whole = results.sparkSession.createDataFrame([], found.schema)
    sizes = results.withColumnRenamed("model", "tested_model").withColumn(
        "evaluator_model", F.explode(F.array(*[F.lit(n) for n in names]))
    )
    keys = ["tested_model", "evaluator_model", "test_dataset"]
    named = [df.withColumn("test_dataset", F.lit(dataset_name)) for df in (sizes, whole)]
    stats = verification_stats(*named, keys)
    append_stats(stats, f"{target}/stats")
    return stats


def _cause(error: Exception) -> str:
    return f"{type(error).__name__}: {str(error).strip().splitlines()[0] if str(error).strip() else ''}"


def _unreadable(splits: Mapping[str, DataFrame]) -> dict[str, str]:
    """The splits whose rows cannot be read, each with its cause; a pass over every split, made only after a failure."""
    found = {}
    for name, rows in splits.items():
        try:
            rows.write.format("noop").mode("overwrite").save()
        except Exception as error:  # whatever stops a split must not stop the others
            found[name] = _cause(error)
    return found


def split_flow(
    splits: Mapping[str, DataFrame],
    models: str | Sequence[str],
    client_factory: ClientFactory,
    target: str,
    per_split: int | None = None,
    roles: ColumnRoles | None = None,
    options: RunOptions | None = None,
) -> dict[str, str]:
    """Generate for all splits in one plan, write JSON lines, CSV and a published table, each with a folder per split.

    Returns the splits that failed with their causes: those whose rows cannot be read, and those none of whose requests
    was answered. They are left out; the others are not touched by them. Where rows cannot be read the plan is
    made again without their split, and calls that were made already are not repeated. ``per_split`` takes the first rows
    of each split by task id.
    """
    options = options or RunOptions()
    if options.attempts_path is None:
        options = replace(options, attempts_path=f"{target}/attempts")
    failed, left = {}, dict(splits)
    while left:
        try:
            parts = [rows.drop("split").withColumn("split", F.lit(name)) for name, rows in left.items()]
            whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
            asked = whole if per_split is None else limit_per_group(whole, per_split, ["task_id"], ["split"])
            run = generate(asked, models, client_factory, roles, options, by=["split"])
            run.rows.write.mode("overwrite").parquet(f"{target}/rows")
            break
        except Exception:
            broken = _unreadable(left)
            if not broken:  # the fault is not in the rows
                raise
            failed |= broken
            left = {name: rows for name, rows in left.items() if name not in broken}
    if not left:
        return failed
    verdicts = run.attempts.where("last").groupBy("split").agg(
        F.bool_or("ok").alias("answered"), F.max_by("error", "end_ts").alias("error")
    )
    for split in verdicts.where("not answered").collect():
        failed[split["split"]] = split["error"]
    written = whole.sparkSession.read.schema(run.rows.schema).parquet(f"{target}/rows").where(~F.col("split").isin(*failed))
    write_json_lines(written, f"{target}/jsonl", "overwrite")
    write_csv(written, f"{target}/csv", "overwrite")
    publish(written, f"{target}/published", "overwrite")
    return failed


def transform_flow(
    rows: DataFrame,
    target: str,
    handlers: Sequence[PromptHandler] = (QUESTION_METADATA,),
    keep: Sequence[str] = (),
    sql_column: str = "answer",
    candidates: str | None = None,
) -> dict[str, int]:
    """Parse prompts, tag the SQL and publish by split; returns the counts of the same pass.

    ``retained`` and ``skipped`` count prompts, ``tagged`` the published rows.
    """
    parsed, tagged = Observation("parsed"), Observation("tagged")
    done = tag_dialects(transform_prompts(rows, handlers, keep, parsed), sql_column, "dbms", candidates)
    publish(done.observe(tagged, F.count("*").alias("tagged")), target, "overwrite")
    return {**parsed.get, **tagged.get}
