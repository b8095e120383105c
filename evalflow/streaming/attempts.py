"""State machine of a request over its attempts, kept as a table that every micro-batch folds forward."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evalflow.operators.outcomes import is_final
from evalflow.staging import remove

_OVER = ("success", "failed")


def _state(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/state/batch_id={batch_id}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def fold_attempts(
    state: DataFrame | None,
    attempts: DataFrame,
    oldest: int | None = None,
    max_attempts: int = 3,
    time: str = "end_ts",
    keys: Sequence[str] = ("task_id",),
) -> DataFrame:
    """`known` and new `status`, `attempts` and `last` of every task of the state or of the attempts.

    A failure marked ``final`` ends a task like a success does; what comes after the end does not count. Attempts not later
    than ``oldest`` (microseconds) belong to tasks that have been forgotten and are left out.
    """
    keys = list(keys)
    ok, final = F.coalesce(F.col("ok"), F.lit(False)), is_final(attempts)
    came = attempts.select(*keys, ok.alias("_ok"), final.alias("_final"), F.col(time).cast("timestamp").alias("_time"))
    if oldest is not None:
        came = came.where(F.unix_micros("_time") > oldest)
    fresh = came.groupBy(*keys).agg(
        F.count("*").alias("_tried"), F.bool_or("_ok").alias("_ok"), F.bool_or("_final").alias("_final"), F.max("_time").alias("_time")
    )
    if state is None:
        empty = (F.lit(None).cast(kind).alias(name) for name, kind in (("known", "string"), ("_before", "bigint"), ("_last", "timestamp")))
        both = fresh.select("*", *empty)
    else:
        both = state.withColumnsRenamed({"status": "known", "attempts": "_before", "last": "_last"}).join(fresh, keys, "full")
    both = both.withColumn("known", F.coalesce("known", F.lit("pending")))
    over = F.col("known").isin(*_OVER)
    counted = F.coalesce("_before", F.lit(0)) + F.when(over, 0).otherwise(F.coalesce("_tried", F.lit(0)))
    status = (
        F.when(over | F.col("_tried").isNull(), F.col("known"))
        .when(F.col("_ok"), "success")
        .when(F.col("_final") | (counted >= max_attempts), "failed")
        .otherwise("retry")
    )
    return both.select(*keys, "known", status.alias("status"), counted.cast("bigint").alias("attempts"), F.greatest("_last", "_time").alias("last"))


def _newest(state: DataFrame | None) -> int | None:
    """The latest attempt, in microseconds. Its task is the last to be forgotten, so the state tells how far time has come."""
    return None if state is None else state.agg(F.unix_micros(F.max("last"))).first()[0]


def track_attempts(
    attempts: DataFrame,
    path: str,
    checkpoint: str,
    max_attempts: int = 3,
    delay_s: int = 600,
    lost_after_s: int = 3600,
    time: str = "end_ts",
    keys: Sequence[str] = ("task_id",),
) -> StreamingQuery:
    """Write the status changes of each task (``retry``, ``success``, ``failed``, ``lost``) below ``path``.

    Every micro-batch joins its attempts with the state that the one before left, writes the changes and the new state in
    folders of its own, and removes the state before the last; all of it runs in built-in operators. A batch that is
    repeated reads the same state and overwrites its own folders. Expired tasks leave the state, so it holds the tasks
    of the last ``delay_s + lost_after_s`` only; those that still wait for a retry then are lost. Ids keep their type.
    """
    keys, late = list(keys), (delay_s + lost_after_s) * 1_000_000

    def step(batch: DataFrame, batch_id: int) -> None:
        spark, before = batch.sparkSession, _state(batch.sparkSession, path, batch_id - 1)
        newest = _newest(before)
        folded = fold_attempts(before, batch, newest and newest - late, max_attempts, time, keys)
        folder = f"{path}/folded/batch_id={batch_id}"
        folded.write.mode("overwrite").parquet(folder)
        folded = spark.read.schema(folded.schema).parquet(folder)
        newest = _newest(folded)
        expired = F.unix_micros("last") <= (newest or 0) - late
        lost = folded.where(expired & (F.col("status") == "retry")).withColumn("status", F.lit("lost"))
        changes = folded.where("status <> known").unionByName(lost).select(*keys, "status", "attempts")
        changes.write.mode("overwrite").parquet(f"{path}/changes/batch_id={batch_id}")
        kept = folded.where(~expired).select(*keys, "status", "attempts", "last")
        kept.write.mode("overwrite").parquet(f"{path}/state/batch_id={batch_id}")
        remove(spark, folder)
        remove(spark, f"{path}/state/batch_id={batch_id - 2}")

    return (
        attempts.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def state_changes(spark: SparkSession, path: str) -> DataFrame:
    """The written changes: the keys, `status`, `attempts` and `batch_id`."""
    return spark.read.parquet(f"{path}/changes")
