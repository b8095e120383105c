"""Properties of operators on small fixtures."""

import math
import random
import time

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from evalflow.functions.tokens import python_tokens
from evalflow.plans import flows, runs
from evalflow.sources import artifacts
from evalflow.operators import ids, invoke, joins, outcomes, prompts, reports, shape, timeline
from evalflow.sources.datasets import ColumnRoles, DatasetSpec, apply_roles, output_column
from evalflow.staging import owned, stage, stage_dir


@pytest.fixture(scope="module")
def hot_rows(spark):
    """Rows of which one group holds a third and one time holds many."""
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        group = "hot" if i % 3 == 0 else rng.choice(["a", "b", None, "c"])
        rows.append((i, group, rng.choice([5, 5, 5, rng.randint(0, 50)]), rng.randint(0, 9)))
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "id bigint, grp string, t int, n bigint").repartition(7)


@pytest.mark.parametrize("partitions", [1, 3, 17])
def test_positions_do_not_depend_on_partitions(hot_rows, partitions):
    rows, df = hot_rows
    got = {r["id"]: r["position"] for r in ids.positions(df, ["t", "id"], partitions=partitions).collect()}
    want = {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])))}
    assert got == want


@pytest.mark.parametrize("partitions", [1, 5, 17])
def test_positions_per_group(hot_rows, partitions):
    rows, df = hot_rows
    got = {r["id"]: r["position"] for r in ids.positions(df, ["t", "id"], ["grp"], partitions=partitions).collect()}
    want = {}
    for g in {r[1] for r in rows}:
        want.update({r[0]: i for i, r in enumerate(sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0])))})
    assert got == want


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_running_values(hot_rows, partitions):
    rows, df = hot_rows
    values = {"s": ("sum", F.col("n")), "m": ("max", F.when(F.col("n") > 7, F.col("id")))}
    got = {r["id"]: (r["s"], r["m"]) for r in ids.running_values(df, ["t", "id"], values, ["grp"], partitions).collect()}
    want = {}
    for g in {r[1] for r in rows}:
        total, top = 0, None
        for r in sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0])):
            total += r[3]
            if r[3] > 7:
                top = r[0] if top is None else max(top, r[0])
            want[r[0]] = (total, top)
    assert got == want


def test_running_values_exchange_the_rows_once(hot_rows, spark):
    """Range-partitioned rows are read back as they were dealt: the plan only exchanges ends of partitions."""
    _, df = hot_rows
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = ids.running_values(df, ["t", "id"], {"s": ("sum", F.col("n"))}, ["grp"], 12)
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    lines = [line.strip(" :+-") for line in plan.splitlines()]
    exchanges = [k for k, line in enumerate(lines) if "Exchange" in line]
    assert len(exchanges) == 2 and "BroadcastExchange" in lines[exchanges[0]]
    # Below the other one only the first and last groups of every partition are left.
    assert any("_first" in line and "_end" in line and "Filter" in line for line in lines[exchanges[1] :])
    assert sum("Bucketed: true" in line for line in lines) == 2


def test_a_hot_group_is_split(hot_rows, spark):
    """The tasks of the ranged table are even although one group holds a third of the rows."""
    rows, df = hot_rows
    sizes = [r["count"] for r in ids._ranged(df, ["grp"], ["t", "id"], 12).groupBy("_part").count().collect()]
    assert len(sizes) == 12 and max(sizes) < 3 * len(rows) / 12


@pytest.mark.parametrize("n", [1, 7, 2000])
def test_limit_per_group(hot_rows, spark, n):
    rows, df = hot_rows
    got = sorted(r["id"] for r in ids.limit_per_group(df, n, ["id"], ["grp"]).collect())
    want = []
    for g in {r[1] for r in rows}:
        want += sorted(r[0] for r in rows if r[1] == g)[:n]
    assert got == sorted(want)


def test_task_ids_are_dense(hot_rows):
    rows, df = hot_rows
    got = sorted(r["task_id"] for r in ids.assign_task_ids(df, ["grp", "id"]).select("task_id").collect())
    assert got == list(range(len(rows)))


@pytest.mark.parametrize("size, total, want", [(1, None, 5), (20, None, 20), (1000, None, 100), (50, 8, 8)])
def test_batch_size_is_clamped(spark, size, total, want):
    df = ids.batch_numbers(spark.range(300).withColumnRenamed("id", "task_id"), size, total)
    assert df.where("batch_no = 0").count() == want


def test_admission_respects_both_budgets(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([0, 1, 40, 900])) for i in range(800)]
    df = spark.createDataFrame(rows, "task_id bigint, tokens bigint")
    plan = timeline.plan_admission(df, max_requests=10, max_tokens=500).orderBy("task_id").collect()
    slots = [r["slot"] for r in plan]
    assert slots == sorted(slots) and slots[0] == 0
    for slot in set(slots):
        tokens = [r["tokens"] for r in plan if r["slot"] == slot]
        assert len(tokens) <= 10 and sum(tokens[:-1]) < 500


def test_cooldown(spark):
    rows = [
        (1, "m", "2024-01-01 00:00:00", None),
        (2, "m", "2024-01-01 00:00:10", "rate_limit"),
        (3, "m", "2024-01-01 00:00:10", None),
        (4, "m", "2024-01-01 00:00:24.999999", None),
        (5, "m", "2024-01-01 00:00:25", None),
        (6, "x", "2024-01-01 00:00:11", None),
        (7, "m", "2024-01-01 00:01:00", "other"),
    ]
    df = spark.createDataFrame(rows, "task_id int, model string, ts string, error_class string")
    df = df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {r["task_id"]: r["in_cooldown"] for r in timeline.with_cooldown(df).collect()}
    assert got == {1: False, 2: True, 3: True, 4: True, 5: False, 6: False, 7: False}


def test_durations_ignore_the_session_zone(spark):
    """A night with a clock change in New York still has eight hours."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("SELECT 1 AS task_id, 'm' AS model, timestamp_ntz'2024-03-10 00:00:00' AS start_ts, timestamp_ntz'2024-03-10 08:00:00' AS end_ts")
        assert outcomes.throughput(df).first()["elapsed_s"] == 8 * 3600
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_first_outcome_counts_once(spark):
    rows = [("r", 1, 1, "2024-01-01 00:00:01", False), ("r", 1, 2, "2024-01-01 00:00:05", True), ("r", 2, 1, "2024-01-01 00:00:03", True)]
    df = spark.createDataFrame(rows, "run string, task_id int, attempt int, end_ts string, ok boolean")
    df = df.withColumn("end_ts", F.col("end_ts").cast("timestamp_ntz"))
    got = timeline.running_progress(timeline.first_outcomes(df)).orderBy("completed").collect()
    assert [(r["task_id"], r["completed"], r["successful"], r["failed"], r["elapsed_s"]) for r in got] == [
        (1, 1, 0, 1, 0.0),
        (2, 2, 1, 1, 2.0),
    ]
    # A failure that is tried again is no outcome.
    ended = timeline.running_progress(timeline.first_outcomes(outcomes.terminal_attempts(df, 3))).orderBy("completed").collect()
    assert [(r["task_id"], r["successful"], r["failed"]) for r in ended] == [(2, 1, 0), (1, 2, 0)]


# --- prompts and requests ----------------------------------------------------------------------


def test_values_are_not_searched_for_slots(spark):
    df = spark.createDataFrame([("{schema} {{x}}", None)], "question string, context string")
    got = prompts.render_prompts(df, "{{q}}: {question}|{schema}|{missing}").first()["prompt"]
    assert got == "{q}: {schema} {{x}}||"


def test_prompt_parsing(spark):
    rows = [
        ("question: q1 metadata: ```\nDDL\n``` ", " A "),
        ("metadata: m", "A"),
        ("metadata: m question: q", "A"),
        ("question: a metadata: ```sql\nx``` y ``` z", None),
        ("question: a metadata: ```open", "A"),
        ("question:metadata:", ""),
        (None, "A"),
    ]
    df = spark.createDataFrame(rows, "prompt string, completion string").coalesce(1)
    got = [tuple(r) for r in shape.transform_prompts(df).collect()]
    assert got == [
        ("DDL", "q1", "A"),
        ("m question: q", "", "A"),
        ("sql\nx``` y", "a", ""),
        ("open", "a", "A"),
        ("", "", ""),
    ]


def test_transform_counts_come_with_the_pass(spark):
    df = spark.createDataFrame([("question: a metadata: b", "c"), ("x", "y")], "prompt string, completion string")
    seen = Observation()
    shape.transform_prompts(df, observation=seen).collect()
    assert seen.get == {"retained": 1, "skipped": 1}


def test_tagging_without_sql_column(spark):
    df = spark.range(2)
    assert shape.tag_dialects(df, "sql").columns == ["id"]


def test_request_cost(spark):
    rows = [("generate", '{"prompt": "a b c d e f g h i j"}'), ("completions", '{"prompt": ["a b", "c"], "n": 2, "max_tokens": 5}'), ("embeddings", '{"input": "a b"}')]
    df = spark.createDataFrame(rows, "e string, request string")
    got = [r["tokens"] for r in prompts.with_token_cost(df, F.col("e")).collect()]
    assert got == [25, 3 + 2 * 10, 2]
    split = python_tokens(str.split)
    assert [r["tokens"] for r in prompts.with_token_cost(df, F.col("e"), counter=split).collect()] == got
    with pytest.raises(Exception, match="no token estimate"):
        prompts.with_token_cost(df, F.lit("images")).collect()


def test_probe_prompt_length(spark):
    df = prompts.probe_prompts(spark.range(1), 257)
    assert len(df.first()["prompt"]) == 257


# --- roles and addresses -----------------------------------------------------------------------


def test_addresses():
    assert DatasetSpec.parse("p") == DatasetSpec("p", None, "test")
    assert DatasetSpec.parse("p:c") == DatasetSpec("p", "c", "test")
    assert DatasetSpec.parse("p:c:s") == DatasetSpec("p", "c", "s")
    assert DatasetSpec.parse("p:c", default_split=None).split is None
    with pytest.raises(ValueError):
        DatasetSpec.parse("p", need_config=True)


def test_roles(spark):
    assert ColumnRoles.for_dataset("x/synthetic_text_to_sql:a", question="other").question == "sql_prompt"
    assert ColumnRoles.for_dataset("x/y", answer="a").context == "context"
    assert ColumnRoles.for_dataset("x/y", answer="a", compat=True).context == "a"
    df = spark.createDataFrame([("c", "q")], "context string, q string")
    assert apply_roles(df, ColumnRoles(question="q")).columns == ["context", "question"]
    assert (output_column("translate"), output_column("translate", runner="batch")) == ("translation", "response")


# --- model calls -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def flaky_client():
    from pyspark import cloudpickle

    import evalflow

    # Workers may not see the test modules or the package; send the code along.
    cloudpickle.register_pickle_by_value(evalflow)

    def factory():
        def call(request, attempt):
            if "final" in request:
                raise invoke.CallError("not found", 404)
            if "never" in request or ("later" in request and attempt < 3):
                raise ConnectionError("reset")
            return request.upper()

        return call

    return factory


def test_invoke_retries(spark, flaky_client):
    rows = [(1, "m", "now"), (2, "m", "later"), (3, "m", "never"), (4, "m", "final")]
    df = spark.createDataFrame(rows, "task_id bigint, model string, request string")
    attempts = invoke.invoke(df, flaky_client, max_attempts=4, backoff_s=0.0, partitions=2)
    counts = {r["task_id"]: (r["count"]) for r in attempts.groupBy("task_id").count().collect()}
    assert counts == {1: 1, 2: 3, 3: 4, 4: 1}
    last = {r["task_id"]: (r["ok"], r["response"]) for r in invoke.latest_outcome(attempts).collect()}
    assert last == {1: (True, "NOW"), 2: (True, "LATER"), 3: (False, None), 4: (False, None)}
    status = {r["task_id"]: r["status"] for r in outcomes.final_status(attempts, 4).collect()}
    assert status == {1: "success", 2: "success", 3: "failed", 4: "failed"}
    ended = {r["task_id"]: (r["attempt"], r["final"]) for r in attempts.where("last").collect()}
    assert ended == {1: (1, False), 2: (3, False), 3: (4, False), 4: (1, True)}


def test_hanging_calls_time_out(spark):
    def factory():
        def call(request, attempt):
            if attempt == 1:
                time.sleep(30)
            return "done"

        return call

    df = spark.createDataFrame([("a" * 64, "m", "x")], "task_id string, model string, request string")
    attempts = invoke.invoke(df, factory, max_attempts=2, backoff_s=0.0, timeout_s=0.5, partitions=1).orderBy("attempt").collect()
    assert [(r["task_id"], r["ok"], r["last"]) for r in attempts] == [("a" * 64, False, False), ("a" * 64, True, True)]
    assert attempts[0]["error"].startswith("TimeoutError")


def test_a_broken_run_is_resumed_without_repeated_calls(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()
    broken = tmp_path / "broken"

    def factory():
        def call(request, attempt):
            if request == "r7" and not broken.exists():
                broken.touch()
                raise SystemExit("the worker is lost")
            (log / f"{request}-{time.time_ns()}").touch()
            return request

        return call

    rows = [(i, "m", f"r{i}") for i in range(20)]
    df = spark.createDataFrame(rows, "task_id bigint, model string, request string")
    path = str(tmp_path / "attempts")
    with pytest.raises(Exception, match="(?i)worker|exit|task"):
        invoke.invoke(df, factory, backoff_s=0.0, timeout_s=None, partitions=1, concurrency=1, attempts_path=path, buckets=20)
    before = len(list(log.iterdir()))
    attempts = invoke.invoke(df, factory, backoff_s=0.0, timeout_s=None, partitions=1, attempts_path=path, buckets=4)
    assert sorted(r["response"] for r in attempts.where("last").collect()) == sorted(r[2] for r in rows)
    calls = [f.name.split("-")[0] for f in log.iterdir()]
    # Only requests that shared the broken bucket were called again.
    assert before > 0 and set(calls) == {r[2] for r in rows} and len(calls) <= 20 + 3


def test_finished_tasks_of_a_broken_job_are_kept(spark, tmp_path):
    """Without any buckets: a task's calls are in place when it ends, not when the job does."""
    log = tmp_path / "calls"
    log.mkdir()
    broken = tmp_path / "broken"

    def factory():
        def call(request, attempt):
            if request == "r150" and not broken.exists():
                while len(list(log.iterdir())) < 150:
                    time.sleep(0.05)
                time.sleep(2)
                broken.touch()
                raise SystemExit("the worker is lost")
            (log / f"{request}-{time.time_ns()}").touch()
            return request

        return call

    df = spark.createDataFrame([(i, "m", f"r{i}") for i in range(200)], "task_id bigint, model string, request string")
    path = str(tmp_path / "attempts")
    options = dict(backoff_s=0.0, concurrency=1, partitions=200, attempts_path=path)
    with pytest.raises(Exception, match="(?i)worker|exit|task"):
        invoke.invoke(df, factory, **options)
    attempts = invoke.invoke(df, factory, **options)
    assert attempts.count() == attempts.where("last").select("task_id").distinct().count() == 200
    # Only what was under way when the job ended is called again: a task at most for each core.
    assert 200 <= len(list(log.iterdir())) <= 208


def test_carried_columns_belong_to_the_key_of_a_request(spark, tmp_path):
    rows = [(1, "m", "x", "a"), (1, "m", "y", "b")]
    df = spark.createDataFrame(rows, "task_id bigint, model string, request string, tested string")
    client = lambda: lambda request, attempt: request
    for part in (df.where("tested = 'a'"), df):
        attempts = invoke.invoke(part, client, carry=["tested"], attempts_path=str(tmp_path / "calls"))
    assert sorted((r["tested"], r["response"]) for r in attempts.collect()) == [("a", "x"), ("b", "y")]


def test_readable_answers():
    yes, no = runs.readable("generate"), runs.readable("translate")
    assert yes('{"response": "x"}') and yes('{"choices": [{"message": {"content": "x"}}]}') and yes('{"message": {"content": "x"}}')
    assert not any(yes(x) for x in ("", "no json", "[]", "null", '{"response": null}', '{"response": " "}', '{"choices": [{}]}', '{"other": 1}'))
    assert no('{"response": "{\\"question\\": \\"q\\"}"}') and not no('{"response": "plain"}') and not no('{"response": "[1]"}')


def test_warm_up_failures_are_warnings(spark):
    def factory():
        def call(request, attempt):
            raise invoke.CallError("no such model", 404)

        return call

    rows = spark.createDataFrame([(1, "c", "q", "a")], "task_id bigint, context string, question string, answer string")
    with pytest.warns(UserWarning, match="warm-up of m2 failed: .*no such model"):
        result = runs.generate(rows, ["m1", "m2"], factory, options=runs.RunOptions(max_attempts=1, warm_up="hello"))
    assert result.warm_ups.count() == 2 and result.attempts.where("phase <> 'run'").count() == 0
    assert runs.generate(rows, "m1", factory, options=runs.RunOptions(max_attempts=1)).warm_ups is None


def test_resume_exchanges_the_rows_to_do_only(spark, tmp_path):
    path = str(tmp_path / "it's finished")
    todo = spark.range(1000).select(F.col("id").cast("string").alias("task_id"), (F.col("id") % 3).alias("part"))
    schema = todo.withColumn("n", F.lit(1)).schema
    keys, before = ["task_id", "part"], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")

    def run(rows, n, **options):
        return artifacts.resume_stage(rows, path, keys, lambda r: r.withColumn("n", F.lit(n)), schema, 16, **options)

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        run(todo.where("task_id < 300"), 1)
        run(todo, 2, finished=F.col("task_id") != "7000")
        got = run(todo, 3)
        assert {(r["n"], r["count"]) for r in got.groupBy("n").count().collect()} == {(1, 300), (2, 700)}
        known = artifacts.bucketed_table(spark, path, schema, keys, 16)
        plan = shape.pending_rows(todo, known, keys)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    scan = plan.index("FileScan")
    assert plan[:scan].count("Exchange") == 1 and plan.index("Exchange") < plan.index("Range") < scan
    # Failed rows are tried again.
    run(todo.withColumn("task_id", F.concat(F.lit("x"), "task_id")), 4, finished=F.col("part") > 0)
    assert run(todo.withColumn("task_id", F.concat(F.lit("x"), "task_id")), 5).where("n = 5").count() == 334


def test_unreadable_answers_are_retried(spark, flaky_client):
    df = spark.createDataFrame([(1, "m", "x")], "task_id bigint, model string, request string")
    attempts = invoke.invoke(df, flaky_client, max_attempts=3, backoff_s=0.0, accept=lambda r: False)
    assert [r["error"] for r in attempts.orderBy("attempt").collect()] == ["response could not be read"] * 3


def test_split_flow_names_failed_splits_and_their_causes(spark, tmp_path):
    def factory():
        import json

        def call(request, attempt):
            if "hopeless" in request:
                raise invoke.CallError("quota used up", 403)
            return json.dumps({"response": "```sql\nSELECT 1;\n```"})

        return call

    def rows(n, question="q"):
        return spark.range(n).select(F.col("id").alias("task_id"), F.lit("c").alias("context"), F.lit(question).alias("question"), F.lit("a").alias("answer"))

    bad = rows(3).withColumn("question", F.raise_error(F.lit("broken page")).cast("string"))
    splits = {"good": rows(5), "bad": bad, "refused": rows(2, "hopeless"), "more": rows(4).withColumn("extra", F.lit(1))}
    failed = flows.split_flow(splits, "m", factory, str(tmp_path / "out"), options=runs.RunOptions(max_attempts=2, backoff_s=0.0))
    assert set(failed) == {"bad", "refused"} and "broken page" in failed["bad"] and "quota used up" in failed["refused"]
    published = spark.read.parquet(str(tmp_path / "out" / "published"))
    assert {(r["split"], r["count"]) for r in published.groupBy("split").count().collect()} == {("good", 5), ("more", 4)}
    assert published.where("gen_sql is null").count() == 0
    # The same ids in several splits are different requests; none was made twice.
    calls = spark.read.parquet(str(tmp_path / "out" / "attempts" / "generate"))
    assert calls.count() == calls.select("split", "task_id").distinct().count() == 11
    assert flows.split_flow({"bad": bad}, "m", factory, str(tmp_path / "none")).keys() == {"bad"}


def test_calls_are_not_repeated(spark):
    """A client that answers differently each time still gives one answer per request."""

    def factory():
        import uuid

        return lambda request, attempt: uuid.uuid4().hex

    df = spark.createDataFrame([(i, "m", "x") for i in range(20)], "task_id bigint, model string, request string")
    attempts = invoke.invoke(df, factory)
    assert attempts.orderBy("task_id").collect() == attempts.orderBy("task_id").collect()


def test_every_request_has_one_end(spark):
    requests = spark.range(100).withColumnRenamed("id", "task_id")
    log = requests.where("task_id % 3 > 0").withColumn("error", F.when(F.col("task_id") % 3 == 1, "x"))
    whole = joins.complete_log(requests, log)
    assert whole.count() == 100 and whole.select("task_id").distinct().count() == 100
    assert whole.where(F.col("error") == joins.LOST).count() == 34


def test_accuracy_is_per_dataset_row(spark):
    dataset = spark.range(10).withColumn("tested_model", F.lit("m"))
    verdicts = spark.createDataFrame([("m", "yes")] * 6 + [("m", "no")] * 2, "tested_model string, resolve_yn string")
    assert outcomes.verification_stats(dataset, verdicts).first()["accuracy"] == 60.0


def test_verdicts_without_id_join_nothing(spark):
    verdicts = spark.createDataFrame([("1", "yes"), ("", "no"), (None, "no"), ("x", "no"), ("1", "yes")], "task_id string, resolve_yn string")
    dataset = spark.createDataFrame([(1, "c", "q", "a", "g")], "task_id int, context string, question string, answer string, gen_sql string")
    got = joins.join_verdicts(verdicts, dataset).collect()
    assert len(got) == 2 and got[0]["gt_sql"] == "a"


def test_run_matrix_of_long_lists(spark):
    names = spark.range(2000).select(F.col("id").cast("string").alias("model"))
    assert joins.run_matrix(names.where("id < 3"), names).count() == 6000


def test_admission_slots_are_exact(spark):
    df = spark.createDataFrame([(0, 999333), (1, 0), (2, 0), (3, 1)], "task_id bigint, tokens bigint")
    plan = timeline.plan_admission(df, max_requests=3000, max_tokens=1_000_000).orderBy("task_id").collect()
    assert [r["slot"] for r in plan] == [0, 0, 0, 0]


def test_final_status_of_unstarted_requests(spark):
    df = spark.createDataFrame([(1, None, None)], "task_id int, attempt int, ok boolean")
    assert outcomes.final_status(df).first()["status"] == "pending"


# --- reports -----------------------------------------------------------------------------------


def test_latency_means_of_missing_values(spark):
    df = spark.createDataFrame([("m", "cold", 1.0), ("m", "cold", None)], "model string, start_type string, load_s double")
    for c in ("first_token_s", "total_s", "tokens", "tokens_per_s"):
        df = df.withColumn(c, F.lit(1.0))
    assert reports.latency_means(df).first()["load_s"] == 1.0
    assert reports.latency_means(df, compat=True).first()["load_s"] == 0.5


def test_spread_of_one_run(spark):
    df = spark.createDataFrame([("m", 1.0)], "tested_model string, accuracy double")
    row = reports.metric_spread(df).first()
    assert (row["mean"], row["std"], row["n"]) == (1.0, None, 1)
    with pytest.raises(ValueError):
        reports.metric_spread(df.select("tested_model"))


def test_numbers_in_wiki_lines_round_like_python(spark):
    values = [0.125, 2.675, 1.005, 12345.678, -0.5]
    df = spark.createDataFrame(list(enumerate(values)), "i int, x double")
    lines = [r["line"] for r in reports.wiki_lines(df, ["i"]).orderBy("line_no").collect()]
    assert lines[0] == "h1. Run statistics" and lines[2] == "|_. i |_. x |"
    assert lines[3:] == [f"| {i} | {v:.2f} |" for i, v in enumerate(values)]


def test_missing_metrics_in_long_form(spark):
    df = spark.createDataFrame([(1, "m")], "id int, tested_model string")
    got = {r["metric"]: r["value"] for r in reports.run_metrics_long(df, ["id"]).collect()}
    assert got["Model"] == "m" and got["Test Size"] == "N/A" and got["Accuracy"] == "0.00%"
    assert "Evaluator Model" not in got and "Success Count" not in got


def test_percent_of_nothing(spark):
    row = spark.range(1).select(outcomes.percent(F.lit(0), F.lit(0)), outcomes.ratio(F.lit(1), F.lit(0))).first()
    assert tuple(row) == (0.0, 0.0) and not math.isnan(row[0])


# --- staging -----------------------------------------------------------------------------------


def test_stage_uses_the_folder_of_the_session(spark):
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or stage_dir(spark)
    df = stage(spark.range(5), "x")
    assert df.count() == 5 and folder.removeprefix("file:") in df.inputFiles()[0]


def test_owned_tables_are_deleted_at_the_end(spark):
    with owned(spark) as tables:
        kept = stage(spark.range(5), "kept")
        path = tables.pop()
        stage(spark.range(7), "gone")
        gone = tables[0]
        assert spark.read.parquet(gone).count() == 7
    assert kept.count() == 5 and spark.read.parquet(path).count() == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(gone)


def test_summaries_come_from_one_pass(spark):
    rows = [
        ("m1", "d1", "e1", 90.0, 1.0, 2.0, 10), ("m1", "d1", None, 70.0, None, 4.0, 20), ("m1", None, "e2", 50.0, 3.0, None, 30),
        ("m2", "d2", "e1", None, 2.0, 1.0, 5), (None, "d1", "e1", 1.0, 1.0, 1.0, 1),
    ]
    kind = "tested_model string, test_dataset string, evaluator_model string, accuracy double, avg_processing_time double, batch_throughput double, test_size bigint"
    runs = spark.createDataFrame(rows, kind)
    report = reports.summary_report(runs)
    alone = {"model_summary": reports.model_summary(runs), "dataset_summary": reports.dataset_summary(runs), "evaluator_summary": reports.evaluator_summary(runs)}
    for name, table in alone.items():
        assert report[name].columns == table.columns
        assert sorted(map(repr, report[name].collect())) == sorted(map(repr, table.collect()))
    plan = reports.summary_rows(runs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1
