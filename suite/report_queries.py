"""Summaries, rankings, latency comparisons and table lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalflow.functions.responses import listed_models
from evalflow.operators import reports, timeline
from evalflow.plans.reports import write_report
from evalflow.sources.stats import model_lines
from evalflow.staging import stage_path
from suite.registry import query
from suite.views import table, view


def _runs(spark, sf):
    return view(spark, sf, "runs")


def _rounded(df, *columns, digits=4):
    return df.withColumns({c: F.round(c, digits) for c in columns})


_KNOWN = "SELECT * FROM {runs} r WHERE tested_model IS NOT NULL"


@query(
    "model_summary",
    f"""SELECT tested_model, round(avg(accuracy), 4) AS accuracy, round(avg(avg_processing_time), 4) AS avg_processing_time,
        round(avg(batch_throughput), 4) AS batch_throughput, CAST(sum(test_size) AS BIGINT) AS test_size FROM ({_KNOWN}) k GROUP BY tested_model""",
)
def _(spark, sf):
    return _rounded(reports.model_summary(_runs(spark, sf)), "accuracy", "avg_processing_time", "batch_throughput")


@query(
    "dataset_summary",
    f"""SELECT tested_model, test_dataset, round(avg(accuracy), 4) AS accuracy, round(avg(avg_processing_time), 4) AS avg_processing_time
        FROM ({_KNOWN}) k GROUP BY tested_model, test_dataset""",
)
def _(spark, sf):
    return _rounded(reports.dataset_summary(_runs(spark, sf)), "accuracy", "avg_processing_time")


@query(
    "evaluator_summary",
    f"SELECT tested_model, evaluator_model, round(avg(accuracy), 4) AS accuracy FROM ({_KNOWN}) k GROUP BY tested_model, evaluator_model",
)
def _(spark, sf):
    return _rounded(reports.evaluator_summary(_runs(spark, sf)), "accuracy")


@query(
    "report_long",
    f"""SELECT 'model_summary' AS report, tested_model, '' AS part, round(avg(accuracy), 3) AS accuracy FROM ({_KNOWN}) k GROUP BY tested_model
        UNION ALL SELECT 'dataset_summary', tested_model, test_dataset, round(avg(accuracy), 3) FROM ({_KNOWN}) k GROUP BY tested_model, test_dataset
        UNION ALL SELECT 'evaluator_summary', tested_model, evaluator_model, round(avg(accuracy), 3) FROM ({_KNOWN}) k GROUP BY tested_model, evaluator_model""",
)
def _(spark, sf):
    report = reports.summary_report(_runs(spark, sf))
    parts = {"model_summary": F.lit(""), "dataset_summary": F.col("test_dataset"), "evaluator_summary": F.col("evaluator_model")}
    out = None
    for name, part in parts.items():
        shown = reports.display(report[name]).select(
            F.lit(name).alias("report"), "tested_model", part.alias("part"), F.col("accuracy").cast("double").alias("accuracy")
        )
        out = shown if out is None else out.unionByName(shown)
    return out


@query(
    "metric_spread",
    " UNION ALL ".join(
        f"SELECT '{m}' AS metric, tested_model, round(avg({m}), 4) AS mean, round(stddev_samp({m}), 4) AS std, CAST(count({m}) AS BIGINT) AS n FROM ({_KNOWN}) k GROUP BY tested_model"
        for m in ("accuracy", "avg_processing_time")
    ),
)
def _(spark, sf):
    return _rounded(reports.metric_spread(_runs(spark, sf)), "mean", "std")


@query(
    "model_ranking",
    f"""SELECT tested_model, round(avg(accuracy), 4) AS accuracy, round(avg(avg_processing_time), 4) AS avg_processing_time, round(avg(batch_throughput), 4) AS batch_throughput
        FROM ({_KNOWN}) k GROUP BY tested_model ORDER BY avg(accuracy) DESC NULLS LAST, tested_model LIMIT 3""",
)
def _(spark, sf):
    return _rounded(reports.ranking(_runs(spark, sf), k=3), "accuracy", "avg_processing_time", "batch_throughput")


@query(
    "accuracy_matrix",
    f"""SELECT tested_model, round(avg(accuracy) FILTER (test_dataset = 'F'), 4) AS "F", round(avg(accuracy) FILTER (test_dataset = 'O'), 4) AS "O",
        round(avg(accuracy) FILTER (test_dataset = 'P'), 4) AS "P" FROM ({_KNOWN}) k GROUP BY tested_model""",
)
def _(spark, sf):
    return _rounded(reports.accuracy_matrix(_runs(spark, sf), ["F", "O", "P"]), "F", "O", "P")


@query("recent_runs", "SELECT run_id, timestamp, tested_model FROM {runs} r ORDER BY timestamp DESC, run_id DESC LIMIT 5")
def _(spark, sf):
    return reports.recent_runs(_runs(spark, sf), tie=["run_id"]).select("run_id", "timestamp", "tested_model")


def _tests(spark, sf):
    return timeline.with_start_type(view(spark, sf, "tests"))


_LABELLED = "SELECT *, CASE WHEN test_no = min(test_no) OVER (PARTITION BY model) THEN 'cold' ELSE 'warm' END AS start_type FROM {tests} t"
_FIELDS = ("load_s", "first_token_s", "total_s", "tokens", "tokens_per_s")


@query("start_types", f"SELECT model, test_no, start_type, 'cold' AS forced FROM ({_LABELLED}) l")
def _(spark, sf):
    rows = _tests(spark, sf).select("model", "test_no", "start_type")
    forced = timeline.with_start_type(rows.withColumnRenamed("start_type", "kept"), force_cold=True)
    return forced.select("model", "test_no", F.col("kept").alias("start_type"), F.col("start_type").alias("forced"))


@query(
    "cold_warm_means",
    "SELECT model, start_type, " + ", ".join(f"round(avg({c}), 8) AS {c}" for c in _FIELDS) + f" FROM ({_LABELLED}) l GROUP BY model, start_type",
)
def _(spark, sf):
    return _rounded(reports.latency_means(_tests(spark, sf)), *_FIELDS, digits=8)


@query(
    "cold_warm_means_compat",
    "SELECT model, start_type, " + ", ".join(f"round(avg(coalesce({c}, 0)), 8) AS {c}" for c in _FIELDS) + f" FROM ({_LABELLED}) l GROUP BY model, start_type",
)
def _(spark, sf):
    return _rounded(reports.latency_means(_tests(spark, sf), compat=True), *_FIELDS, digits=8)


_NUMBERS = ("test_no", *_FIELDS)


@query(
    "numeric_means",
    "SELECT model, start_type, " + ", ".join(f"round(avg({c}), 8) AS {c}" for c in _NUMBERS) + f" FROM ({_LABELLED}) l GROUP BY model, start_type",
)
def _(spark, sf):
    return _rounded(reports.numeric_means(_tests(spark, sf)), *_NUMBERS, digits=8)


@query(
    "latency_report",
    "SELECT m.model, s.start_type, "
    + ", ".join(f"round(avg({c}), 8) AS {c}" for c in _FIELDS)
    + f""" FROM (SELECT DISTINCT 'model-' || (user_id * 2) AS model FROM events) m
        CROSS JOIN (SELECT unnest(['cold', 'warm']) AS start_type) s LEFT JOIN ({_LABELLED}) l ON l.model = m.model AND l.start_type = s.start_type
        GROUP BY m.model, s.start_type""",
)
def _(spark, sf):
    listed = table(spark, sf, "events").select(F.concat(F.lit("model-"), F.col("user_id") * 2).alias("model")).distinct()
    return _rounded(reports.latency_report(listed, _tests(spark, sf)), *_FIELDS, digits=8)


@query("first_value_per_model", "SELECT model, min(load_s) AS load_s FROM {tests} t WHERE load_s IS NOT NULL GROUP BY model")
def _(spark, sf):
    return reports.first_value_per_model(view(spark, sf, "tests"), "load_s")


def _line_rows(spark, sf):
    runs = _runs(spark, sf)
    return runs.select("run_id", "tested_model", "test_dataset", (F.col("run_id") % 1000 / 8).alias("score"))


_WIKI = """SELECT CAST(n + 3 AS BIGINT) AS line_no, '| ' || run_id || ' | ' || coalesce(tested_model, 'nan') || ' | ' || test_dataset || ' | ' ||
    printf('%.2f', score) || ' |' AS line FROM (SELECT *, (run_id % 1000) / 8 AS score, row_number() OVER (ORDER BY run_id) AS n FROM {runs} r) x"""


@query(
    "wiki_lines",
    f"""{_WIKI} UNION ALL SELECT 1, 'h1. Run statistics' UNION ALL SELECT 2, '' UNION ALL
        SELECT 3, '|_. run_id |_. tested_model |_. test_dataset |_. score |'""",
)
def _(spark, sf):
    return reports.wiki_lines(_line_rows(spark, sf), ["run_id"])


@query(
    "markdown_lines",
    """SELECT CAST(n + 4 AS BIGINT) AS line_no, '| ' || run_id || ' | ' || coalesce(tested_model, '') || ' | ' || test_dataset || ' |' AS line
       FROM (SELECT *, row_number() OVER (ORDER BY run_id) AS n FROM {runs} r) x
       UNION ALL SELECT 1, '# Run statistics' UNION ALL SELECT 2, '' UNION ALL SELECT 3, '| run_id | tested_model | test_dataset |'
       UNION ALL SELECT 4, '|---|---|---|'""",
)
def _(spark, sf):
    return reports.markdown_lines(_line_rows(spark, sf).drop("score"), ["run_id"])


@query(
    "run_metrics_long",
    """SELECT run_id, unnest(['Basic Information', 'Basic Information', 'Basic Information', 'Basic Information', 'Basic Information',
         'Performance Metrics', 'Performance Metrics', 'Time Metrics', 'Time Metrics']) AS section,
       unnest([1, 2, 3, 4, 5, 6, 7, 8, 9])::INTEGER AS position,
       unnest(['Execution Time', 'Model', 'Evaluator Model', 'Test Dataset', 'Test Size', 'Success Count', 'Accuracy',
         'Avg Processing Time', 'Batch Throughput']) AS metric,
       unnest([strftime(timestamp, '%Y-%m-%d %H:%M:%S'), coalesce(tested_model, 'N/A'), evaluator_model, test_dataset, '50',
         hits || '/50 (' || (hits * 2) || '.0%)', hits || '.00%', avg_processing_time::INTEGER || '.000 sec/query',
         batch_throughput::INTEGER || '.00 queries/sec']) AS value
       FROM (SELECT *, run_id % 50 AS hits FROM {runs} r) x""",
)
def _(spark, sf):
    hits = F.col("run_id") % 50
    rows = _runs(spark, sf).withColumns(
        {"test_size": F.lit(50).cast("bigint"), "successful_count": hits, "accuracy": hits.cast("double")}
    )
    return reports.run_metrics_long(rows, ["run_id"])


@query("model_list", "SELECT source AS model FROM documents WHERE lang NOT IN ('en', 'fr')")
def _(spark, sf):
    line = (
        F.when(F.col("lang") == "en", F.concat(F.lit("  # "), F.col("source")))
        .when(F.col("lang") == "fr", F.lit("   "))
        .otherwise(F.col("source"))
    )
    return model_lines(table(spark, sf, "documents").select(line.alias("value")))


@query("text_catalogue", "SELECT page_id, 'm' || page_id || ':7b' AS model FROM pages")
def _(spark, sf):
    listing = F.concat(F.lit("NAME  ID  SIZE\nm"), F.col("page_id"), F.lit(":7b  abc  4 GB\n"))
    pages = table(spark, sf, "pages").select("page_id", listed_models(listing).alias("models"))
    return pages.select("page_id", F.explode("models").alias("model"))


@query(
    "written_report",
    f"""SELECT 'metrics' AS part, metric || ' ' || tested_model AS name, CAST(n AS BIGINT) AS n FROM (
          SELECT 'accuracy' AS metric, tested_model, count(accuracy) AS n FROM ({_KNOWN}) k GROUP BY tested_model
          UNION ALL SELECT 'avg_processing_time', tested_model, count(avg_processing_time) FROM ({_KNOWN}) k GROUP BY tested_model) m
        UNION ALL SELECT 'model_summary', tested_model, CAST(sum(test_size) AS BIGINT) FROM ({_KNOWN}) k GROUP BY tested_model
        UNION ALL SELECT 'md', '', count(*) + 4 FROM orders UNION ALL SELECT 'wiki', '', count(*) + 3 FROM orders""",
)
def _(spark, sf):
    path = stage_path(spark, "report")
    write_report(_runs(spark, sf), path, ["run_id"])
    metrics = spark.read.parquet(f"{path}/metrics").select(
        F.lit("metrics").alias("part"), F.concat_ws(" ", "metric", "tested_model").alias("name"), "n"
    )
    summary = spark.read.parquet(f"{path}/model_summary").select(
        F.lit("model_summary").alias("part"), F.col("tested_model").alias("name"), F.col("test_size").alias("n")
    )
    out = metrics.unionByName(summary)
    for kind in ("md", "wiki"):
        lines = spark.read.text(f"{path}/lines_{kind}").agg(F.count("*").alias("n"))
        out = out.unionByName(lines.select(F.lit(kind).alias("part"), F.lit("").alias("name"), "n"))
    return out
