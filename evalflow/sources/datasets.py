"""Evaluation datasets: address, column roles, readers and table writers."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class DatasetSpec:
    """Address ``path:config:split``; config and split may be left out."""

    path: str
    config: str | None = None
    split: str | None = None

    @classmethod
    def parse(cls, address: str, default_split: str | None = "test", need_config: bool = False) -> DatasetSpec:
        parts = address.split(":")
        if need_config and len(parts) < 2:
            raise ValueError(f"dataset address needs the form path:config:split, got {address!r}")
        config = parts[1] if len(parts) > 1 and parts[1] else None
        return cls(parts[0], config, parts[2] if len(parts) > 2 else default_split)

    @property
    def folder(self) -> str:
        return f"{self.path}/{self.config}" if self.config else self.path


@dataclass(frozen=True)
class ColumnRoles:
    """Which columns hold context, question, answer, input and output."""

    context: str = "context"
    question: str = "question"
    answer: str = "answer"
    input: str = "input"
    output: str = "gen_sql"

    @classmethod
    def for_dataset(cls, path: str, compat: bool = False, **overrides: str | None) -> ColumnRoles:
        """Roles of a dataset family, with overrides.

        ``compat=True`` keeps a known slip: outside the ``synthetic_text_to_sql`` family the
        answer column is also taken as the context.
        """
        given = {k: v for k, v in overrides.items() if v}
        path = path.split(":")[0]
        if path.endswith("/synthetic_text_to_sql"):
            fixed = {k: v for k, v in given.items() if k in ("input", "output")}
            return cls(context="sql_context", question="sql_prompt", answer="sql", **fixed)
        roles = replace(cls(), **given)
        return replace(roles, context=roles.answer) if compat else roles


def output_column(mode: str, given: str | None = None, runner: str = "parser") -> str:
    """Name of the result column of a mode; the batch runner and the parser differ for translations."""
    if given:
        return given
    if mode == "generate":
        return "gen_sql"
    if mode == "translate" and runner == "parser":
        return "translation"
    return "response"


def apply_roles(df: DataFrame, roles: ColumnRoles, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rename the role columns a dataset has to context, question, answer, input; keep others on demand."""
    present = {
        role: getattr(roles, role)
        for role in ("context", "question", "answer", "input")
        if getattr(roles, role) in df.columns
    }
    return df.select(*keep, *[F.col(column).alias(role) for role, column in present.items()])


#: What stands for NULL in CSV files, so that an empty text stays an empty text.
NULL_MARK = "\\N"

_READERS = {
    "parquet": {},
    "json": {},
    "csv": {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "nullValue": NULL_MARK},
}


def _reader(spark: SparkSession, fmt: str, schema: StructType | str | None):
    if fmt not in _READERS:
        raise ValueError(f"unknown dataset format {fmt!r}")
    reader = spark.read.options(**_READERS[fmt])
    return reader.schema(schema) if schema is not None else reader


def read_splits(
    spark: SparkSession, spec: DatasetSpec, fmt: str = "parquet", schema: StructType | str | None = None
) -> DataFrame:
    """All rows of a dataset folder partitioned by ``split``, pruned to the split that applies.

    With a config the address' split applies, if there is one; without a config all splits are read.
    """
    df = _reader(spark, fmt, schema).load(spec.folder, format=fmt)
    if "split" not in df.columns:
        raise ValueError(f"{spec.folder} has no split=... folders")
    return df.where(F.col("split") == spec.split) if spec.config and spec.split else df


def read_dataset(
    spark: SparkSession,
    address: str | DatasetSpec,
    fmt: str = "parquet",
    schema: StructType | str | None = None,
    fallback: str | DatasetSpec | None = None,
) -> DataFrame:
    """Rows of one split. A folder that does not exist is an error unless ``fallback`` is named; a table without splits
    is one if a split is asked for.
    """
    spec = DatasetSpec.parse(address) if isinstance(address, str) else address
    try:
        df = _reader(spark, fmt, schema).load(spec.folder, format=fmt)
    except AnalysisException as missing:
        if fallback is None or missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return read_dataset(spark, fallback, fmt, schema)
    if not spec.split:
        return df
    if "split" not in df.columns:
        raise ValueError(f"{spec.folder} has no split=... folders")
    return df.where(F.col("split") == spec.split)


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV whose texts may hold line breaks and doubled quotes. Such a file cannot be cut, so a large table has to come as
    many files (or as JSON lines); each file is one task.
    """
    return _reader(spark, "csv", schema).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with doubled quotes, one folder per split when there is a ``split`` column; NULL is written as a mark of its
    own, so empty texts and NULL both come back.

    A file whose texts hold line breaks is read back by one task, so write as many files as there are tasks to read them.
    """
    writer = df.write.mode(mode).options(header="true", quote='"', escape='"', nullValue=NULL_MARK)
    (writer.partitionBy("split") if "split" in df.columns else writer).csv(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines, one folder per split when there is a ``split`` column."""
    writer = df.write.mode(mode)
    (writer.partitionBy("split") if "split" in df.columns else writer).json(path)


def publish(df: DataFrame, target: str, mode: str = "errorifexists") -> None:
    """Write a dataset as a table with one folder per split.

    Adaptive execution deals the rows by split and cuts or joins the pieces to its advisory size, so a large split
    does not end in one task and a small one not in many files.
    """
    df.hint("rebalance", F.col("split")).write.mode(mode).partitionBy("split").parquet(target)


def publish_splits(splits: dict[str, DataFrame | None], target: str, mode: str = "errorifexists") -> None:
    """Publish processed splits together; a split whose processing failed (None) is left out."""
    parts = [df.withColumn("split", F.lit(name)) for name, df in splits.items() if df is not None]
    if not parts:
        raise ValueError("no split to publish")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    publish(whole, target, mode)


def publish_results_file(
    spark: SparkSession, path: str, schema: StructType | str, target: str, mode: str = "errorifexists"
) -> None:
    """Publish a finished ``.jsonl`` or ``.csv`` result as split ``test``.

    There is one split, so the tasks that read the file write it; Spark packs small files into a task. Dealing the rows
    first would move the whole table once more.
    """
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "jsonl":
        df = read_json_lines(spark, path, schema)
    elif suffix == "csv":
        df = read_csv(spark, path, schema)
    else:
        raise ValueError(f"results must be .jsonl or .csv, got {path!r}")
    df.withColumn("split", F.lit("test")).write.mode(mode).partitionBy("split").parquet(target)
