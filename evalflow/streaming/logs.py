"""Append-only logs read as streams, with the same expressions as in batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from evalflow.operators.outcomes import generation_counts, generation_stats_of, is_final, terminal_attempts
from evalflow.sources.logs import parse_result_lines
from evalflow.sources.stats import stats_rows


def stream_result_log(spark: SparkSession, path: str, response_column: str = "response") -> DataFrame:
    """Parsed lines of a growing result log."""
    return parse_result_lines(spark.readStream.text(path), response_column)


def event_time(df: DataFrame, column: str, delay: str) -> DataFrame:
    """Watermark on a column; times without zone are taken in the session time zone."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def first_outcome_stream(
    outcomes: DataFrame, delay: str = "1 hour", time: str = "end_ts", keys: Sequence[str] = ("task_id",)
) -> DataFrame:
    """One outcome per task. State is kept for ``delay``; a repeat after it passes. `record_outcomes` keeps no state and
    lets none pass."""
    return event_time(outcomes, time, delay).dropDuplicatesWithinWatermark(list(keys))


def record_outcomes(
    attempts: DataFrame, path: str, checkpoint: str, max_attempts: int = 3, time: str = "end_ts", keys: Sequence[str] = ("task_id",)
) -> StreamingQuery:
    """Write the first outcome of every task to a ledger: once, however often and late it is reported, also across restarts.

    Only attempts that end a task count. A micro-batch is reduced to one row per task, the earliest; tasks of earlier
    batches are left out; the rest is written to a folder of the batch, which a repeated batch overwrites. The ledger is
    reduced to the tasks of the batch first, so that a small batch makes it a scan of keys without an exchange.
    """
    keys = list(keys)

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        ended = terminal_attempts(batch, max_attempts)
        others = [c for c in batch.columns if c not in (*keys, time)]
        first = ended.groupBy(*keys).agg(F.min(F.struct(time, *others)).alias("_first")).select(*keys, "_first.*")
        first = first.select(*batch.columns)
        try:
            earlier = spark.read.parquet(path).where(F.col("batch_id") < batch_id).select(*keys)
        except AnalysisException as missing:
            if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        else:
            known = earlier.join(first.select(*keys), keys, "left_semi").distinct()
            first = first.join(known, keys, "left_anti")
        first.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        attempts.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def recorded_outcomes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("batch_id")


def progress_per_minute(
    outcomes: DataFrame, delay: str | None = "10 minutes", time: str = "end_ts", keys: Sequence[str] = ("model",)
) -> DataFrame:
    """Completed, successful and failed tasks per minute; in append mode a minute appears once it is closed.

    ``outcomes`` holds one row per task. The watermark is set here; ``delay=None`` is for a stream that already has one.
    """
    watermarked = outcomes if delay is None else event_time(outcomes, time, delay)
    ok = F.coalesce(F.col("ok"), F.lit(False))
    return (
        watermarked.groupBy(F.window(time, "1 minute").alias("_w"), *keys)
        .agg(F.count("*").alias("completed"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"))
        .select(F.col("_w.start").cast("timestamp_ntz").alias("minute"), *keys, "completed", "successful", "failed")
    )


def status_stream(
    attempts: DataFrame,
    max_attempts: int = 3,
    delay: str = "10 minutes",
    lost_after: str = "1 hour",
    time: str = "end_ts",
    keys: Sequence[str] = ("task_id",),
) -> DataFrame:
    """Final status and number of attempts of each task (``success``, ``failed``, ``lost``), as a session aggregate.

    A session of attempts less than ``lost_after`` apart is closed once event time has passed its end; its row then appears
    and its state goes, in append mode. A task without an outcome by then is lost. Everything runs in built-in
    aggregates; for changes as they happen see `attempt_states`.
    """
    slim = attempts.select(*keys, time, F.coalesce("ok", F.lit(False)).alias("ok"), is_final(attempts).alias("final"))
    folded = event_time(slim, time, delay).groupBy(*keys, F.session_window(time, lost_after).alias("_s")).agg(
        F.count("*").alias("attempts"), F.bool_or("ok").alias("_ok"), F.bool_or("final").alias("_final")
    )
    failed = F.col("_final") | (F.col("attempts") >= max_attempts)
    status = F.when(F.col("_ok"), "success").when(failed, "failed").otherwise("lost")
    return folded.select(*keys, "attempts", status.alias("status"))


def append_stats_stream(
    outcomes: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = ("tested_model", "test_dataset")
) -> StreamingQuery:
    """Append the additive counts of every micro-batch: rows, successes, first start and last end.

    Each batch owns one folder and overwrites it, so a repeated batch leaves one copy. `streamed_stats` derives the run
    statistics from all of them.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        generation_counts(batch, keys).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        outcomes.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def streamed_stats(spark: SparkSession, path: str, keys: Sequence[str] = ("tested_model", "test_dataset")) -> DataFrame:
    """Run statistics from the counts of all micro-batches: one row per run, as if computed at once."""
    return stats_rows(generation_stats_of(spark.read.parquet(path), keys))


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process what is available in append mode into a Parquet table and read it back."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_updates_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> DataFrame:
    """Process what is available in update or complete mode; one folder per batch, with its ``batch_id``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    query = (
        stream.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("batch_id", LongType())])
    return stream.sparkSession.read.schema(schema).parquet(path)
