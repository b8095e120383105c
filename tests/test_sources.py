"""Readers, writers and streams on files."""

import json

import pytest
from pyspark.sql import functions as F

from evalflow.sources import datasets, logs, stats
from evalflow.streaming import attempts as attempt_stream
from evalflow.streaming import logs as stream_logs


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'SELECT "a",\n b'), (2, ""), (3, None), (4, "x\\y, 'z' \"\"")]
    df = spark.createDataFrame(rows, "id int, sql string")
    datasets.write_csv(df, str(tmp_path / "c"))
    back = datasets.read_csv(spark, str(tmp_path / "c"), "id int, sql string")
    assert sorted(tuple(r) for r in back.collect()) == rows


def test_missing_dataset_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        datasets.read_dataset(spark, f"{tmp_path}/none:x")


def test_results_file_suffix(spark):
    with pytest.raises(ValueError):
        datasets.publish_results_file(spark, "/x/file.xlsx", "a int", "/x/out")


@pytest.mark.parametrize("kind", ["jsonl", "csv"])
def test_a_results_file_is_published_by_the_tasks_that_read_it(spark, tmp_path, kind):
    """No exchange: the rows of every task stay together, in a file of their own."""
    rows = [(k, f"text {k}") for k in range(400)]
    write = datasets.write_json_lines if kind == "jsonl" else datasets.write_csv
    path, target, key = str(tmp_path / f"r.{kind}"), str(tmp_path / "table"), "spark.sql.files.maxPartitionBytes"
    write(spark.createDataFrame(rows, "id int, text string").repartition(4), path)
    before = spark.conf.get(key)
    spark.conf.set(key, "4096")
    try:
        tasks = spark.read.text(path).rdd.getNumPartitions() if kind == "jsonl" else 4
        datasets.publish_results_file(spark, path, "id int, text string", target)
    finally:
        spark.conf.set(key, before)
    back = spark.read.parquet(target)
    assert 4 <= len(back.inputFiles()) <= tasks
    assert sorted(tuple(r) for r in back.collect()) == [(*r, "test") for r in rows]


def test_jobs_with_bad_lines(spark, tmp_path):
    lines = ['{"task_id": 1, "index": 3, "request": {"model": "m", "messages": [{"role": "user", "content": "a"}]}}', "{bad", '{"task_id": "b", "request": {"prompt": "p"}, "metadata": {"k": 1}}']
    (tmp_path / "jobs.jsonl").write_text("\n".join(lines) + "\n")
    got = logs.read_jobs(spark, str(tmp_path)).collect()
    good = {r["task_id"]: (json.loads(r["request"]), r["metadata"]) for r in got if r["bad_line"] is None}
    assert good == {
        "1": ({"model": "m", "messages": [{"role": "user", "content": "a"}]}, None),
        "b": ({"prompt": "p"}, '{"k":1}'),
    }
    assert [r["bad_line"] for r in got if r["bad_line"]] == ["{bad"]


def test_line_numbers_over_many_blocks(spark, tmp_path):
    names = ["a.txt", "b.txt"]
    for name in names:
        (tmp_path / name).write_text("".join(f"{name} {i:06d}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        numbered = logs.numbered_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        wrong = numbered.where(F.col("line_no") != F.split("value", " ")[1].cast("bigint")).count()
        assert numbered.count() == 10000 and wrong == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


LOG = [
    [{"messages": [{"role": "user", "content": "p1"}]}, {"choices": [{"message": {"content": "Yes"}}]}, {"task_id": 1}],
    [{"prompt": "p2"}, {"resolve_yn": " NO "}, {"k": 1}, {"task_id": 2}],
    [{"x": 1}, {"error": ["e"], "task_id": 3}, None, {"task_id": 3}],
    [{"prompt": "p4"}, {"response": "I know"}, {"task_id": 4}],
    ["text", "text", {"task_id": 5}],
]


def test_result_log(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text("\n".join([json.dumps(x) for x in LOG] + ["[broken"]) + "\n")
    got = logs.read_result_log(spark, str(tmp_path), "resolve_yn").collect()
    rows = {r["task_id"]: (r["prompt"], r["resolve_yn"], bool(r["failed"])) for r in got if not r["bad_line"]}
    assert rows == {
        "1": ("p1", "yes", False),
        "2": ("p2", "no", False),
        "3": ('{"x":1}', "unknown", True),
        "4": ("p4", "no", False),
        "5": ("", "", False),
    }
    assert [r["bad_line"] for r in got if r["bad_line"]] == ["[broken"]
    compat = logs.read_result_log(spark, str(tmp_path), "resolve_yn", compat=True).where("bad_line IS NULL")
    assert sorted(r["task_id"] for r in compat.collect()) == ["", "", "1", "4", "5"]


def test_stats_log(spark, tmp_path):
    path = str(tmp_path / "stats")
    one = spark.createDataFrame([("m", 50.0, "verification", 9)], "tested_model string, accuracy double, phase string, memory_usage int")
    two = spark.createDataFrame([("m", 1500.0, "translation")], "tested_model string, avg_translation_time_ms double, phase string")
    stats.append_stats(one, path)
    stats.append_stats(two, path)
    rows = {r["phase"]: r for r in stats.read_stats(spark, path).collect()}
    assert rows["verification"]["accuracy"] == 50.0 and rows["verification"]["timestamp"] is not None
    assert rows["translation"]["avg_translation_time_s"] == 1.5


def test_model_list(spark, tmp_path):
    (tmp_path / "m.config").write_text("a:7b\n\n  # note\n   \n b:8b \n#x\n")
    got = [r["model"] for r in stats.read_model_list(spark, str(tmp_path / "m.config")).collect()]
    assert got == ["a:7b", " b:8b "]


def test_latency_csv(spark, tmp_path):
    (tmp_path / "l.csv").write_text("h1,h2,h3,h4,h5,h6,h7,h8,h9,h10,h11,h12\nm,1,100,cold,N/A,0.5,2,10,5.0,0.0,1.0,N/A\n")
    row = stats.read_latency_csv(spark, str(tmp_path / "l.csv")).first()
    assert row["load_s"] is None and row["tokens"] == 10 and row["gpu_mem"] is None


@pytest.fixture
def attempt_files(spark, tmp_path):
    rows = [
        (1, 1, "2024-01-01 00:00:10", False),
        (1, 2, "2024-01-01 00:00:40", True),
        (2, 1, "2024-01-01 00:01:10", False),
        (3, 1, "2024-01-01 00:02:10", False),
        (3, 2, "2024-01-01 00:02:20", False),
        (3, 3, "2024-01-01 00:02:30", False),
        (4, 1, "2024-01-01 09:00:00", True),
    ]
    df = spark.createDataFrame(rows, "task_id bigint, attempt int, end_ts string, ok boolean")
    df = df.withColumn("end_ts", F.col("end_ts").cast("timestamp_ntz")).withColumn("model", F.lit("m"))
    path = str(tmp_path / "attempts")
    df.coalesce(1).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path), tmp_path


def _tracked(spark, stream, tmp, **options):
    attempt_stream.track_attempts(stream, str(tmp / "states"), str(tmp / "checkpoint"), **options).awaitTermination()
    return sorted((r["batch_id"], r["task_id"], r["status"], r["attempts"]) for r in attempt_stream.state_changes(spark, str(tmp / "states")).collect())


def test_stream_states(spark, attempt_files):
    stream, tmp = attempt_files
    assert [r[1:] for r in _tracked(spark, stream, tmp)] == [
        (1, "success", 2),
        (2, "lost", 1),
        (2, "retry", 1),
        (3, "failed", 3),
        (4, "success", 1),
    ]
    # Tasks that are over or lost are forgotten: what is left is bounded by time.
    assert [r["task_id"] for r in spark.read.parquet(str(tmp / "states" / "state")).collect()] == [4]


def _attempt_batches(spark, path, batches):
    kind = "task_id string, ok boolean, final boolean, end_ts timestamp_ntz"
    for rows in batches:
        df = spark.createDataFrame([(*r[:3], "2024-01-01 " + r[3]) for r in rows], "task_id string, ok boolean, final boolean, end_ts string")
        df.withColumn("end_ts", F.col("end_ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(path)


_BATCHES = [
    [("a", False, False, "00:00:10"), ("b", False, True, "00:00:20"), ("c", False, None, "00:00:30"), ("é", None, False, "00:00:40")],
    [("a", True, False, "00:01:00"), ("b", True, False, "00:01:10"), ("c", False, False, "00:01:20"), (None, False, False, "00:01:30")],
    [("c", False, True, "00:02:00"), ("d", True, False, "05:00:00")],
    [("a", False, False, "00:00:10"), ("d", False, False, "05:00:10"), ("e", False, False, "05:01:00")],
]


def test_stream_states_over_micro_batches(spark, tmp_path):
    """Text ids, final failures, tasks that wait over several batches, late repeats, and a NULL id."""
    stream = _attempt_batches(spark, str(tmp_path / "in"), _BATCHES)
    attempt_stream.track_attempts(stream, str(tmp_path / "states"), str(tmp_path / "checkpoint")).awaitTermination()
    got = {tuple(r[c] for c in ("batch_id", "task_id", "status", "attempts")) for r in attempt_stream.state_changes(spark, str(tmp_path / "states")).collect()}
    assert got == {
        (0, "a", "retry", 1), (0, "b", "failed", 1), (0, "c", "retry", 1), (0, "é", "retry", 1),
        (1, "a", "success", 2), (1, None, "retry", 1),
        (2, "c", "failed", 3), (2, "d", "success", 1), (2, "é", "lost", 1), (2, None, "lost", 1),
        (3, "e", "retry", 1),
    }
    state = spark.read.parquet(str(tmp_path / "states" / "state"))
    assert {r["task_id"] for r in state.where("batch_id = 3").collect()} == {"d", "e"}
    assert {r["batch_id"] for r in state.select("batch_id").distinct().collect()} == {2, 3}


def test_a_repeated_batch_of_states_changes_nothing(spark, tmp_path):
    stream = _attempt_batches(spark, str(tmp_path / "in"), _BATCHES[:1])
    first = _tracked(spark, stream, tmp_path / "x")
    for checkpoint in ("one", "two"):
        attempt_stream.track_attempts(stream, str(tmp_path / "x" / "states"), str(tmp_path / checkpoint)).awaitTermination()
    again = attempt_stream.state_changes(spark, str(tmp_path / "x" / "states"))
    assert sorted((r["batch_id"], r["task_id"], r["status"], r["attempts"]) for r in again.collect()) == first


def test_closed_status_of_every_task(spark, tmp_path):
    stream = _attempt_batches(spark, str(tmp_path / "in"), [*_BATCHES[:3], [("z", True, False, "09:00:00")]])
    status = stream_logs.status_stream(stream)
    got = stream_logs.run_to_table(status, str(tmp_path / "out"), str(tmp_path / "checkpoint")).collect()
    assert {(r["task_id"], r["status"], r["attempts"]) for r in got} == {
        ("a", "success", 2), ("b", "success", 2), ("c", "failed", 3), ("é", "lost", 1), (None, "lost", 1), ("d", "success", 1),
    }


def test_outcomes_are_recorded_once(spark, tmp_path):
    """The first end of a task counts, however late it is repeated and whatever the repeat says."""
    stream = _attempt_batches(spark, str(tmp_path / "in"), [*_BATCHES, [("a", False, True, "23:00:00"), ("b", True, False, "23:00:00")]])
    stream = stream.withColumn("attempt", F.lit(1))
    for _ in range(2):  # the second start finds nothing new
        stream_logs.record_outcomes(stream, str(tmp_path / "ledger"), str(tmp_path / "checkpoint")).awaitTermination()
    got = {r["task_id"]: (r["ok"], str(r["end_ts"])) for r in stream_logs.recorded_outcomes(spark, str(tmp_path / "ledger")).collect()}
    assert got == {
        "a": (True, "2024-01-01 00:01:00"), "b": (False, "2024-01-01 00:00:20"), "c": (False, "2024-01-01 00:02:00"), "d": (True, "2024-01-01 05:00:00"),
    }
    assert stream_logs.recorded_outcomes(spark, str(tmp_path / "ledger")).count() == 4


def test_stream_states_of_a_hot_task(spark, tmp_path):
    """A task with very many rows is counted whole, combined before the exchange."""
    rows = spark.range(25_000).select(
        F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(1).alias("task_id"),
        (F.col("id") == 7).alias("ok"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("end_ts"),
    )
    path = str(tmp_path / "attempts")
    rows.coalesce(1).write.parquet(path)
    got = _tracked(spark, spark.readStream.schema(rows.schema).parquet(path), tmp_path)
    assert [r[2:] for r in got if r[1] == 1] == [("success", 22_500)]
    assert len(got) == 2501


def test_stream_progress_has_closed_minutes_only(attempt_files):
    stream, tmp = attempt_files
    got = stream_logs.run_to_table(stream_logs.progress_per_minute(stream), str(tmp / "out"), str(tmp / "state")).collect()
    assert sorted((r["minute"].minute, r["completed"], r["successful"], r["failed"]) for r in got) == [(0, 2, 1, 1), (1, 1, 0, 1), (2, 3, 0, 3)]


def test_repeated_batch_leaves_one_copy(spark, attempt_files):
    stream, tmp = attempt_files
    rows = stream.select(F.lit("m").alias("tested_model"), F.lit("d").alias("test_dataset"), F.col("end_ts").alias("start_ts"), "end_ts", "ok")
    for checkpoint in ("s1", "s2"):
        stream_logs.append_stats_stream(rows, str(tmp / "stats"), str(tmp / checkpoint)).awaitTermination()
    got = spark.read.parquet(str(tmp / "stats")).collect()
    assert [(r["test_size"], r["successful_count"]) for r in got] == [(7, 2)]
