"""Stage outputs: one folder per dataset, model and evaluator, resumed row by row."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evalflow.functions.naming import safe_name
from evalflow.operators.shape import pending_rows


def artifact_path(spark: SparkSession, root: str, dataset: str, model: str, evaluator: str | None = None) -> str:
    """Folder of a stage output, named like the artifact keys in tables."""
    names = [f"{dataset}.{model}"] + ([evaluator] if evaluator else [])
    row = spark.range(1).select(*[safe_name(F.lit(n)).alias(f"n{i}") for i, n in enumerate(names)]).first()
    return "/".join([root, *row])


def finished_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows an earlier run has written; none when there was no run."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _table_name(path: str) -> str:
    return f"evalflow_{hashlib.sha256(path.encode()).hexdigest()[:24]}"


def bucketed_table(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], buckets: int) -> DataFrame:
    """The folder as a table bucketed by the keys: joins and distinct keys on them need no exchange of its rows.

    The table is named after the folder in the session's catalog, whenever the folder was written.
    """
    name = _table_name(path)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        by = ", ".join(f"`{k}`" for k in keys)
        place = path.replace("'", "\\'")
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) INTO {buckets} BUCKETS LOCATION '{place}'")
    spark.catalog.refreshTable(name)
    return spark.table(name)


def append_bucketed(rows: DataFrame, path: str, keys: Sequence[str], buckets: int) -> None:
    """Add rows to a bucketed folder, one file per bucket and call."""
    spark = rows.sparkSession
    bucketed_table(spark, path, rows.schema, keys, buckets)
    dealt = rows.repartition(buckets, *keys)
    dealt.write.format("parquet").mode("append").bucketBy(buckets, *keys).option("path", path).saveAsTable(_table_name(path))


def resume_stage(
    todo: DataFrame,
    path: str,
    keys: Sequence[str],
    process: Callable[[DataFrame], DataFrame],
    schema: StructType,
    buckets: int | None = None,
    finished: Column | None = None,
) -> DataFrame:
    """Process the rows that have no output yet, append them, and return the whole output.

    With ``buckets`` the output is kept bucketed by the keys, so that a resumed run exchanges the rows still to do only,
    however much is finished. ``finished`` tells rows that are done from those to be tried again, such as failed calls;
    those are not written.
    """
    spark = todo.sparkSession
    known = finished_rows(spark, path, schema) if buckets is None else bucketed_table(spark, path, schema, keys, buckets)
    done = process(pending_rows(todo, known, keys)).select(*schema.names)
    if finished is not None:
        done = done.where(finished)
    if buckets is None:
        done.write.mode("append").parquet(path)
        return spark.read.schema(schema).parquet(path)
    append_bucketed(done, path, keys, buckets)
    return bucketed_table(spark, path, schema, keys, buckets)
