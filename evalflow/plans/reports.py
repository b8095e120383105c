"""Written reports over the statistics log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from evalflow.operators.reports import markdown_lines, metric_spread, summary_report, wiki_lines


def write_report(
    runs: DataFrame, path: str, order: Sequence[str], formats: Sequence[str] = ("md", "wiki"), mode: str = "overwrite"
) -> None:
    """Write the summary tables, the metric sections (one folder per metric) and the table lines.

    ``order`` is a total order of the runs for the lines.
    """
    writers = {"md": markdown_lines, "wiki": wiki_lines, "redmine": wiki_lines}
    unknown = [f for f in formats if f.lower() not in writers]
    if unknown:
        raise ValueError(f"unknown report formats {unknown}")
    for name, table in summary_report(runs).items():
        table.write.mode(mode).parquet(f"{path}/{name}")
    metric_spread(runs).write.mode(mode).partitionBy("metric").parquet(f"{path}/metrics")
    for name in dict.fromkeys(f.lower() for f in formats):
        lines = writers[name](runs, order)
        # Sorted files in order of their names hold the lines in order.
        lines.orderBy("line_no").select("line").write.mode(mode).text(f"{path}/lines_{name}")
