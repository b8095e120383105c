"""The streaming operators over the derived rows, run to the end of the available files."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalflow.operators.outcomes import terminal_attempts
from evalflow.staging import stage_path
from evalflow.streaming import attempts as attempt_stream
from evalflow.streaming import logs
from suite import duck
from suite.io_queries import _LOG, _write_log
from suite.registry import query
from suite.views import derive, table, view


def _attempt_stream(spark, sf):
    events = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return derive(spark, "attempts", {"events": events})


@query("stream_result_log", f"SELECT task_id, resolve_yn, failed FROM ({_LOG}) l")
def _(spark, sf):
    out = stage_path(spark, "stream")
    parsed = logs.stream_result_log(spark, _write_log(spark, sf), "resolve_yn").where("bad_line IS NULL")
    return logs.run_to_table(parsed.select("task_id", "resolve_yn", "failed"), f"{out}/rows", f"{out}/state")


_CLOSED = "minute + INTERVAL 1 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"


@query(
    "stream_progress",
    f"""SELECT * FROM (SELECT date_trunc('minute', ts) AS minute, model, CAST(count(*) AS BIGINT) AS completed, CAST(count(*) FILTER (ok) AS BIGINT) AS successful,
        CAST(count(*) FILTER (NOT ok) AS BIGINT) AS failed FROM {{attempts}} a WHERE ok OR attempt >= 3 GROUP BY ALL) x WHERE {_CLOSED}""",
)
def _(spark, sf):
    out = stage_path(spark, "stream")
    ended = terminal_attempts(_attempt_stream(spark, sf), 3)
    return logs.run_to_table(logs.progress_per_minute(ended), f"{out}/rows", f"{out}/state")


def _in_slices(spark, sf, run, repeats: bool = False):
    """What ``run`` makes of the calls as a stream of four micro-batches in the order of time, with refused requests among them.

    The calls are cut once, by the tasks that derive them. Each slice is appended as they left it; the stream then goes on
    from its checkpoint and takes the new files as one micro-batch. With ``repeats`` a fifth one reports the ends of the
    first again, days later and with the opposite outcome.
    """
    path, cut = stage_path(spark, "calls"), stage_path(spark, "slices")
    calls = view(spark, sf, "calls")
    calls.write.partitionBy("slice").parquet(cut)
    calls = spark.read.schema(calls.schema).parquet(cut)
    parts = [calls.where(F.col("slice") == part).drop("slice") for part in range(4)]
    if repeats:
        again = terminal_attempts(parts[0], 3)
        parts.append(again.withColumns({"ok": ~F.col("ok"), "end_ts": F.col("end_ts") + F.expr("INTERVAL 40 DAYS")}))
    for part in parts:
        part.write.mode("append").parquet(path)
        result = run(spark.readStream.schema(part.schema).parquet(path))
    return result


@query("stream_first_outcomes", "SELECT task_id, ok, end_ts FROM {calls} a WHERE ok OR final OR attempt >= 3")
def _(spark, sf):
    out = stage_path(spark, "stream")

    def run(calls):
        logs.record_outcomes(calls, f"{out}/ledger", f"{out}/state").awaitTermination()

    _in_slices(spark, sf, run, repeats=True)
    return logs.recorded_outcomes(spark, f"{out}/ledger").select("task_id", "ok", "end_ts")


@query("stream_outcomes_in_delay", "SELECT task_id, ok, end_ts FROM {calls} a WHERE ok OR final OR attempt >= 3")
def _(spark, sf):
    out = stage_path(spark, "stream")

    def run(calls):
        ended = terminal_attempts(calls, 3).select("task_id", "ok", "end_ts")
        return logs.run_to_table(logs.first_outcome_stream(ended, "1 day"), f"{out}/rows", f"{out}/state")

    rows = _in_slices(spark, sf, run)
    return rows.withColumn("end_ts", F.col("end_ts").cast("timestamp_ntz"))


# A task's state after each slice: counts and flags of all its calls so far.
_AFTER = """SELECT task_id, slice, ts, sum(n) OVER w AS attempts, bool_or(ok) OVER w AS ok, bool_or(final) OVER w AS final
    FROM (SELECT task_id, slice, max(ts) AS ts, count(*) AS n, bool_or(ok) AS ok, bool_or(final) AS final FROM {calls} a GROUP BY task_id, slice) b
    WINDOW w AS (PARTITION BY task_id ORDER BY slice)"""
_STATUS = f"""SELECT task_id, slice, ts, CAST(attempts AS BIGINT) AS attempts,
    CASE WHEN ok THEN 'success' WHEN final OR attempts >= 3 THEN 'failed' ELSE 'retry' END AS status FROM ({_AFTER}) c"""
_LAST = f"SELECT task_id, max(ts) AS ts, max(attempts) AS attempts, arg_max(status, slice) AS status FROM ({_STATUS}) s GROUP BY task_id"
_PASSED = "INTERVAL 1 HOUR <= (SELECT max(ts) FROM {calls} x) - INTERVAL 10 MINUTE"


@query(
    "stream_status",
    f"""SELECT task_id, attempts, CASE WHEN status = 'retry' THEN 'lost' ELSE status END AS status
        FROM ({_LAST}) s WHERE ts + INTERVAL 1 DAY <= (SELECT max(ts) FROM {{calls}} x) - INTERVAL 10 MINUTE""",
)
def _(spark, sf):
    out = stage_path(spark, "stream")

    def run(calls):
        return logs.run_to_table(logs.status_stream(calls, lost_after="1 day"), f"{out}/rows", f"{out}/state")

    return _in_slices(spark, sf, run)


@query(
    "stream_attempt_states",
    f"""SELECT task_id, attempts, status FROM (SELECT *, lag(status) OVER (PARTITION BY task_id ORDER BY slice) AS before FROM ({_STATUS}) s) t
        WHERE before IS NULL OR before <> status
        UNION ALL SELECT task_id, attempts, 'lost' FROM ({_LAST}) s WHERE status = 'retry' AND ts + {_PASSED}""",
)
def _(spark, sf):
    out = stage_path(spark, "stream")

    def run(calls):
        attempt_stream.track_attempts(calls, f"{out}/states", f"{out}/checkpoint").awaitTermination()

    _in_slices(spark, sf, run)
    return attempt_stream.state_changes(spark, f"{out}/states").drop("batch_id")


@query(
    "stream_stats",
    f"""SELECT tested_model, test_dataset, n AS test_size, s AS successful_count, {duck.percent('s', 'n')} AS accuracy, 'translation' AS phase
        FROM (SELECT model AS tested_model, 'events' AS test_dataset, count(*)::BIGINT AS n, (count(*) FILTER (ok))::BIGINT AS s FROM {{attempts}} a GROUP BY model) x""",
)
def _(spark, sf):
    out = stage_path(spark, "stream")
    rows = _attempt_stream(spark, sf).withColumnsRenamed({"model": "tested_model"}).withColumn("test_dataset", F.lit("events"))
    logs.append_stats_stream(rows, f"{out}/rows", f"{out}/state").awaitTermination()
    stats = logs.streamed_stats(spark, f"{out}/rows")
    return stats.select("tested_model", "test_dataset", "test_size", "successful_count", "accuracy", "phase")
