"""Materialise an intermediate result as a table in the shared staging folder.

Used where a result must be read twice and both reads have to see the same rows: model
calls (never repeat a paid call) and range-partitioned tables whose bounds are sampled.
A written table survives the loss of executors and keeps column pruning on re-read.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def stage_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; on local masters a temporary one if unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="evalflow-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def stage_path(spark: SparkSession, label: str) -> str:
    """A new, unused folder below the staging folder."""
    return f"{stage_dir(spark)}/evalflow/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this package wrote; nothing happens where there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class _Owners(threading.local):
    """The lists of paths of the enclosing `owned` blocks of a thread. What is sent to a worker with a function has none."""

    def __init__(self):
        self.blocks: list[list[str]] = []

    def __reduce__(self):
        return _Owners, ()


_OWNERS = _Owners()


@contextmanager
def owned(spark: SparkSession) -> Iterator[list[str]]:
    """Tables staged inside are deleted at the end, but for those that are taken out of the yielded list of paths.

    For runs whose result is written before the end; a result that still reads a staged table must outlive it.
    """
    paths: list[str] = []
    _OWNERS.blocks.append(paths)
    try:
        yield paths
    finally:
        _OWNERS.blocks.pop()
        for path in paths:
            spark.sql(f"DROP TABLE IF EXISTS {_table_name(path)}")
            remove(spark, path)


def hand_on(paths: list[str]) -> None:
    """Leave the table staged last to the enclosing block, if there is one."""
    path = paths.pop()
    if len(_OWNERS.blocks) > 1:
        _OWNERS.blocks[-2].append(path)


def _new_path(spark: SparkSession, label: str) -> str:
    path = stage_path(spark, label)
    if _OWNERS.blocks:
        _OWNERS.blocks[-1].append(path)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads the written table."""
    spark = df.sparkSession
    path = _new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _table_name(path: str) -> str:
    return "evalflow_" + path.rsplit("/", 1)[-1].replace("-", "_")


def stage_dealt(df: DataFrame, label: str, by: str, buckets: int) -> DataFrame:
    """Like ``stage``, with the rows dealt to files by a column: what is grouped by it afterwards needs no exchange.

    Best where the rows of a value are in one task when they are written, which then makes one file of them.
    """
    spark = df.sparkSession
    path = _new_path(spark, label)
    name = _table_name(path)
    df.write.format("parquet").bucketBy(buckets, by).option("path", path).saveAsTable(name)
    return spark.table(name)
