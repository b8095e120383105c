"""The append-only log of run statistics and small configuration lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalflow.sources.datasets import NULL_MARK

VERIFICATION_FIELDS = [
    "timestamp", "tested_model", "evaluator_model", "test_dataset",
    "test_size", "successful_count", "accuracy", "comments", "phase",
]
GENERATION_FIELDS = [
    "timestamp", "tested_model", "test_dataset", "test_size", "successful_count", "accuracy",
    "avg_processing_time", "batch_throughput", "model_size", "comments", "phase",
    "throughput", "success_rate", "error_rate", "avg_translation_time_s", "avg_verification_time_s",
]

STATS_SCHEMA = (
    "timestamp timestamp_ntz, tested_model string, evaluator_model string, test_dataset string, "
    "test_size bigint, successful_count bigint, accuracy double, avg_processing_time double, "
    "batch_throughput double, model_size string, comments string, throughput double, "
    "success_rate double, error_rate double, avg_translation_time_s double, "
    "avg_verification_time_s double, phase string"
)
_TYPES = dict(field.split(" ") for field in STATS_SCHEMA.split(", "))


def stats_rows(runs: DataFrame, timestamp: str | None = None) -> DataFrame:
    """Bring run rows to the statistics layout.

    Adds the time of logging when there is none, turns ``*_ms`` times into seconds, drops every
    column the log does not know and fills the missing ones with NULL.
    """
    for name in ("avg_translation_time", "avg_verification_time"):
        if f"{name}_ms" in runs.columns:
            runs = runs.withColumn(f"{name}_s", F.col(f"{name}_ms") / F.lit(1000.0))
    if "timestamp" not in runs.columns:
        stamp = F.lit(timestamp) if timestamp else F.date_trunc("second", F.localtimestamp())
        runs = runs.withColumn("timestamp", stamp.cast("timestamp_ntz"))
    return runs.select(
        *[
            (F.col(name) if name in runs.columns else F.lit(None)).cast(kind).alias(name)
            for name, kind in _TYPES.items()
        ]
    )


def append_stats(runs: DataFrame, path: str) -> None:
    """Append run rows to the log, one folder per phase."""
    stats_rows(runs).write.mode("append").partitionBy("phase").parquet(path)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """The log of both phases as one table."""
    return spark.read.schema(STATS_SCHEMA).parquet(path)


def read_stats_csv(spark: SparkSession, verification: str | None = None, generation: str | None = None) -> DataFrame:
    """Union of exported statistics files; each file has its own fixed header."""
    parts = []
    for path, fields in ((verification, VERIFICATION_FIELDS), (generation, GENERATION_FIELDS)):
        if path is None:
            continue
        schema = ", ".join(f"{name} {_TYPES[name]}" for name in fields)
        reader = spark.read.schema(schema).options(
            header="true", multiLine="true", quote='"', escape='"', nullValue=NULL_MARK, timestampNTZFormat="yyyy-MM-dd HH:mm:ss"
        )
        parts.append(reader.csv(path))
    if not parts:
        raise ValueError("name at least one statistics file")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def read_model_list(spark: SparkSession, path: str) -> DataFrame:
    """Column ``model``: the lines that are neither blank nor comments, as they stand."""
    return model_lines(spark.read.text(path))


def model_lines(lines: DataFrame) -> DataFrame:
    keep = ~F.col("value").rlike(r"^\s*#") & (F.translate("value", " ", "") != "")
    return lines.where(keep).select(F.col("value").alias("model"))


LATENCY_SCHEMA = (
    "model string, test_no int, prompt_length int, start_type string, load_s double, first_token_s double, "
    "total_s double, tokens bigint, tokens_per_s double, cpu_pct double, mem double, gpu_mem double"
)


def read_latency_csv(spark: SparkSession, path: str) -> DataFrame:
    """Latency benchmark rows; the text N/A is NULL."""
    return spark.read.schema(LATENCY_SCHEMA).options(header="true", nullValue="N/A").csv(path)
