"""Report tables over run statistics and latency rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalflow.operators.ids import positions
from evalflow.staging import stage

METRICS = [
    "success_rate", "accuracy", "avg_processing_time", "throughput", "avg_translation_time_s",
    "avg_verification_time_s",
]

LATENCY_METRICS = ["load_s", "first_token_s", "total_s", "tokens", "tokens_per_s"]
_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def _known(df: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys are all known; unknown keys form no group."""
    return df.dropna("any", subset=list(keys))


def model_summary(runs: DataFrame) -> DataFrame:
    """Mean accuracy, time and throughput and the total size per model."""
    return (
        _known(runs, "tested_model")
        .groupBy("tested_model")
        .agg(
            F.avg("accuracy").alias("accuracy"),
            F.avg("avg_processing_time").alias("avg_processing_time"),
            F.avg("batch_throughput").alias("batch_throughput"),
            F.sum("test_size").alias("test_size"),
        )
    )


def dataset_summary(runs: DataFrame) -> DataFrame:
    keys = ["tested_model", "test_dataset"]
    return (
        _known(runs, *keys)
        .groupBy(*keys)
        .agg(F.avg("accuracy").alias("accuracy"), F.avg("avg_processing_time").alias("avg_processing_time"))
    )


def evaluator_summary(runs: DataFrame) -> DataFrame:
    keys = ["tested_model", "evaluator_model"]
    return _known(runs, *keys).groupBy(*keys).agg(F.avg("accuracy").alias("accuracy"))


def _fixed(value: Column, pattern: str) -> Column:
    """Decimal text by a pattern; rounds half to even on the exact binary value, as Python does."""
    return F.call_function("format_number", value, F.lit(pattern))


def display(df: DataFrame, digits: int = 3) -> DataFrame:
    """Fractional columns as text with a fixed number of decimals."""
    pattern = "0." + "0" * digits
    return df.select(
        *[
            _fixed(F.col(c), pattern).alias(c) if t in ("float", "double") else F.col(c)
            for c, t in df.dtypes
        ]
    )


def summary_rows(runs: DataFrame) -> DataFrame:
    """The rows of all summary tables from one pass over the runs: grouping sets, told apart by `level`."""
    keys = ["tested_model", "test_dataset", "evaluator_model"]
    sets = [["tested_model"], ["tested_model", "test_dataset"], ["tested_model", "evaluator_model"]]
    grouped = _known(runs, "tested_model").groupingSets(sets, *keys).agg(
        F.grouping_id().alias("level"),
        F.avg("accuracy").alias("accuracy"),
        F.avg("avg_processing_time").alias("avg_processing_time"),
        F.avg("batch_throughput").alias("batch_throughput"),
        F.sum("test_size").alias("test_size"),
    )
    # A bit of the level is set for a key that is not grouped by; unknown keys form no group.
    unknown = [F.col(k).isNull() & (F.col("level").bitwiseAND(F.lit(4 >> i)) == 0) for i, k in enumerate(keys)]
    return grouped.where(~(unknown[1] | unknown[2]))


def summary_report(runs: DataFrame) -> dict[str, DataFrame]:
    """The three summary tables by name, computed together and written once."""
    rows = stage(summary_rows(runs), "summary")
    tables = {
        "model_summary": (3, ["tested_model", "accuracy", "avg_processing_time", "batch_throughput", "test_size"]),
        "dataset_summary": (1, ["tested_model", "test_dataset", "accuracy", "avg_processing_time"]),
        "evaluator_summary": (2, ["tested_model", "evaluator_model", "accuracy"]),
    }
    return {name: rows.where(F.col("level") == level).select(*columns) for name, (level, columns) in tables.items()}


def metric_spread(runs: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Long table ``metric, tested_model, mean, std, n`` of the metrics a table has.

    Mean, sample deviation and count of all metrics come from one aggregation; the wide row per
    model is unpivoted afterwards, so no data row is multiplied.
    """
    present = [m for m in metrics if m in runs.columns]
    if not present:
        raise ValueError("the table has none of the metrics")
    aggregates = [
        F.struct(
            F.lit(m).alias("metric"),
            F.avg(m).alias("mean"),
            F.stddev_samp(m).alias("std"),
            F.count(m).alias("n"),
        )
        for m in present
    ]
    wide = _known(runs, "tested_model").groupBy("tested_model").agg(F.array(*aggregates).alias("_rows"))
    return wide.select("tested_model", F.explode("_rows").alias("_row")).select("_row.metric", "tested_model", "_row.mean", "_row.std", "_row.n")


def ranking(runs: DataFrame, by: str = "accuracy", k: int | None = None) -> DataFrame:
    """Models by falling mean; equal means are ordered by name. With ``k`` only the best ones."""
    means = (
        _known(runs, "tested_model")
        .groupBy("tested_model")
        .agg(*[F.avg(c).alias(c) for c in ("accuracy", "avg_processing_time", "batch_throughput")])
        .orderBy(F.desc_nulls_last(by), "tested_model")
    )
    return means.limit(k) if k else means


def accuracy_matrix(runs: DataFrame, datasets: Sequence[str]) -> DataFrame:
    """Mean accuracy with one column per dataset; the list keeps the schema stable."""
    keyed = _known(runs, "tested_model", "test_dataset")
    return keyed.groupBy("tested_model").pivot("test_dataset", list(datasets)).agg(F.avg("accuracy"))


def recent_runs(runs: DataFrame, n: int = 5, tie: Sequence[str] = ()) -> DataFrame:
    """The last rows of the log."""
    return runs.orderBy(F.desc("timestamp"), *[F.desc(c) for c in tie]).limit(n)


def latency_means(tests: DataFrame, compat: bool = False) -> DataFrame:
    """Mean latency fields per model and start type.

    Missing values are ignored; ``compat=True`` counts them as 0.
    """

    def value(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0)) if compat else F.col(c)

    return tests.groupBy("model", "start_type").agg(*[F.avg(value(c)).alias(c) for c in LATENCY_METRICS])


def numeric_means(tests: DataFrame, keys: Sequence[str] = ("model", "start_type")) -> DataFrame:
    """Means of all numeric columns."""
    columns = [c for c, t in tests.dtypes if c not in keys and t.split("(")[0] in _NUMERIC]
    return tests.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])


def latency_report(models: DataFrame, tests: DataFrame, compat: bool = False) -> DataFrame:
    """A cold and a warm row for every listed model; NULL where a model has no such test."""
    pairs = models.select("model", F.explode(F.array(F.lit("cold"), F.lit("warm"))).alias("start_type"))
    return pairs.join(latency_means(tests, compat), ["model", "start_type"], "left")


def first_value_per_model(tests: DataFrame, value: str, key: str = "model") -> DataFrame:
    """The smallest value of each model."""
    return tests.where(F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias(value))


def _cell(df: DataFrame, name: str, missing: str) -> Column:
    kind = dict(df.dtypes)[name]
    text = _fixed(F.col(name), "0.00") if kind in ("float", "double") else F.col(name).cast("string")
    return F.coalesce(text, F.lit(missing))


def wiki_lines(df: DataFrame, order: Sequence[str], title: str = "Run statistics") -> DataFrame:
    """Wiki-table lines ``line_no, line``: title, header, rows in the given (total) order."""
    cells = [_cell(df, c, "nan") for c in df.columns]
    header = "|_. " + " |_. ".join(df.columns) + " |"
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    return _lines(df, order, row, [f"h1. {title}", "", header])


def markdown_lines(df: DataFrame, order: Sequence[str], title: str = "Run statistics") -> DataFrame:
    """Pipe-table lines ``line_no, line``; cells are not padded."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    header = ["# " + title, "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return _lines(df, order, row, header)


def _lines(df: DataFrame, order: Sequence[str], row: Column, header: Sequence[str]) -> DataFrame:
    numbered = positions(df.withColumn("line", row).select(*dict.fromkeys(order), "line"), order)
    body = numbered.select((F.col("position") + len(header) + 1).alias("line_no"), "line")
    top = df.sparkSession.createDataFrame(list(enumerate(header, 1)), "line_no bigint, line string")
    return top.unionByName(body)


def run_metrics_long(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sections, metrics and display values of each run, as ``keys, section, position, metric, value``."""

    def text(name: str) -> Column:
        if name not in runs.columns:
            return F.lit("N/A")
        return F.coalesce(F.col(name).cast("string"), F.lit("N/A"))

    def number(name: str, form: str, unit: str) -> Column:
        value = F.coalesce(F.col(name), F.lit(0.0)) if name in runs.columns else F.lit(0.0)
        return F.concat(_fixed(value.cast("double"), form), F.lit(unit))

    rows = [
        ("Basic Information", "Execution Time", text("timestamp")),
        ("Basic Information", "Model", text("tested_model")),
    ]
    if "evaluator_model" in runs.columns:
        rows.append(("Basic Information", "Evaluator Model", F.col("evaluator_model").cast("string")))
    rows += [
        ("Basic Information", "Test Dataset", text("test_dataset")),
        ("Basic Information", "Test Size", text("test_size")),
    ]
    if "successful_count" in runs.columns:
        share = F.coalesce(F.try_divide(F.col("successful_count") * F.lit(100.0), F.col("test_size")), F.lit(0.0))
        count = F.concat(
            F.col("successful_count").cast("string"), F.lit("/"), F.col("test_size").cast("string"),
            F.lit(" ("), _fixed(share, "0.0"), F.lit("%)"),
        )
        rows.append(("Performance Metrics", "Success Count", count))
    rows += [
        ("Performance Metrics", "Accuracy", number("accuracy", "0.00", "%")),
        ("Time Metrics", "Avg Processing Time", number("avg_processing_time", "0.000", " sec/query")),
        ("Time Metrics", "Batch Throughput", number("batch_throughput", "0.00", " queries/sec")),
    ]
    for name, label in (
        ("avg_translation_time_s", "Avg Translation Time"),
        ("avg_verification_time_s", "Avg Verification Time"),
    ):
        if name in runs.columns:
            shown = number(name, "0.000", " sec")
            rows.append(("Time Metrics", label, F.when(F.col(name).isNotNull(), shown)))
    cells = F.array(
        *[
            F.struct(F.lit(s).alias("section"), F.lit(i).alias("position"), F.lit(m).alias("metric"), v.alias("value"))
            for i, (s, m, v) in enumerate(rows, 1)
        ]
    )
    return runs.select(*keys, F.explode(cells).alias("_row")).where(F.col("_row.value").isNotNull()).select(*keys, "_row.*")
