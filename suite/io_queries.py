"""Readers and writers: the derived rows are written to the staging folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalflow.operators import outcomes, shape
from evalflow.sources import artifacts, datasets, logs, stats
from evalflow.staging import stage_path
from suite import duck
from suite.registry import query
from suite.views import table, view


def _documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", "source", F.col("lang").alias("split"))


@query("spec_read", "SELECT task_id, question, split FROM {qa} q WHERE split = 'en'")
def _(spark, sf):
    root = stage_path(spark, "dataset")
    datasets.publish(view(spark, sf, "qa").select("task_id", "question", "split"), f"{root}/origin")
    return datasets.read_dataset(spark, f"{root}:origin:en").select("task_id", "question", "split")


@query(
    "spec_splits",
    "SELECT task_id, split, 'all' AS read FROM {qa} q UNION ALL SELECT task_id, split, 'one' FROM {qa} q WHERE split = 'de' UNION ALL SELECT task_id, split, 'fallback' FROM {qa} q WHERE split = 'fr'",
)
def _(spark, sf):
    root = stage_path(spark, "splits")
    rows = view(spark, sf, "qa").select("task_id", "split")
    datasets.publish(rows, root)
    datasets.publish(rows, f"{root}-configs/origin")
    # Without a config all splits are read, whatever split the address names.
    everything = datasets.read_splits(spark, datasets.DatasetSpec(root, None, "de"))
    one = datasets.read_splits(spark, datasets.DatasetSpec.parse(f"{root}-configs:origin:de"))
    fallback = datasets.read_dataset(spark, f"{root}-missing:x:y", fallback=datasets.DatasetSpec(root, None, "fr"))
    out = None
    for name, df in (("all", everything), ("one", one), ("fallback", fallback)):
        part = df.select("task_id", "split", F.lit(name).alias("read"))
        out = part if out is None else out.unionByName(part)
    return out


@query("publish_splits", "SELECT doc_id, text, lang AS split FROM documents WHERE lang <> 'fr'")
def _(spark, sf):
    target = stage_path(spark, "published")
    rows = _documents(spark, sf).drop("source")
    parts = {lang: rows.where(F.col("split") == lang).drop("split") for lang in ("de", "en", "es")}
    datasets.publish_splits({**parts, "fr": None}, target)
    return spark.read.parquet(target).select("doc_id", "text", "split")


@query("results_files", "SELECT doc_id, text, source, 'test' AS split, kind FROM documents CROSS JOIN (SELECT unnest(['csv', 'jsonl']) AS kind) k")
def _(spark, sf):
    rows = _documents(spark, sf).select("doc_id", "text", "source")
    out = None
    for kind, write in (("jsonl", datasets.write_json_lines), ("csv", datasets.write_csv)):
        path = f"{stage_path(spark, 'results')}.{kind}"
        write(rows, path)
        datasets.publish_results_file(spark, path, "doc_id bigint, text string, source string", f"{path}-table")
        part = spark.read.parquet(f"{path}-table").select("doc_id", "text", "source", "split", F.lit(kind).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out


@query("json_split_files", "SELECT doc_id, text, source, lang AS split FROM documents")
def _(spark, sf):
    path = stage_path(spark, "json")
    datasets.write_json_lines(_documents(spark, sf), path)
    return datasets.read_json_lines(spark, path, "doc_id bigint, text string, source string, split string")


@query(
    "job_log_roundtrip",
    """SELECT CAST(task_id AS VARCHAR) AS task_id, question AS prompt, NULL AS metadata, CAST(false AS BOOLEAN) AS bad FROM {qa} q
       UNION ALL SELECT NULL, NULL, NULL, true FROM {qa} q WHERE split = 'de'""",
)
def _(spark, sf):
    path = stage_path(spark, "jobs")
    qa = view(spark, sf, "qa")
    jobs = qa.select("task_id", F.struct(F.lit("m").alias("model"), F.col("question").alias("prompt")).alias("request"))
    logs.write_jobs(jobs, path)
    bad = qa.where("split = 'de'").select(F.concat(F.lit('{"task_id": '), F.col("task_id"), F.lit(', "request')).alias("value"))
    bad.write.mode("append").text(path)
    return logs.read_jobs(spark, path).select(
        "task_id",
        F.get_json_object("request", "$.prompt").alias("prompt"),
        "metadata",
        F.col("bad_line").isNotNull().alias("bad"),
    )


@query(
    "job_line_numbers",
    """SELECT task_id, CASE WHEN split = 'en' THEN '{"run":7}' ELSE 'line number' END AS metadata FROM {qa} q""",
)
def _(spark, sf):
    path = stage_path(spark, "jobs")
    own = F.when(F.col("split") == "en", F.struct(F.lit(7).alias("run")))
    # Each task writes one file, so the row number inside the task is the line number in the file.
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    request = F.struct(F.col("question").alias("prompt"), row.alias("row"))
    job = F.to_json(F.struct("task_id", request.alias("request"), own.alias("metadata")))
    view(spark, sf, "qa").select(job.alias("value")).write.text(path)
    jobs = logs.read_jobs_with_line_numbers(spark, path)
    expected = F.concat(F.lit('{"original_index":'), F.get_json_object("request", "$.row"), F.lit("}"))
    metadata = F.when(F.col("metadata") == expected, "line number").otherwise(F.col("metadata"))
    return jobs.select(F.col("task_id").cast("bigint").alias("task_id"), metadata.alias("metadata"))


def _result_lines(spark, sf):
    """The verdict answers as a result log: both request and response shapes, failures and bad lines."""
    content, k = F.col("content"), F.col("task_id") % 8
    prompt = F.concat(F.lit("Q"), F.col("task_id"))
    messages = F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"))).alias("messages")))
    plain = F.to_json(F.struct(prompt.alias("prompt")))
    other = F.to_json(F.struct(F.col("task_id").alias("id")))
    request = F.when(k < 3, messages).when(k < 6, plain).otherwise(other)
    chat = F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices")))
    text = F.to_json(F.struct(content.alias("response")))
    direct = F.to_json(F.struct(F.upper("truth").alias("resolve_yn")))
    failed = F.to_json(F.struct(F.lit("timed out").alias("error"), F.col("task_id")))
    response = F.when(k % 4 == 0, chat).when(k % 4 == 1, text).when(k % 4 == 2, direct).otherwise(failed)
    metadata = F.when(k % 4 == 3, F.lit("null"))
    line = logs.result_line(request, response, F.col("task_id"), metadata)
    broken = F.concat(F.lit("[{bad "), F.col("task_id"))
    return view(spark, sf, "verdicts").select("task_id", F.when(F.col("model") == "src7", broken).otherwise(line).alias("value"))


def _write_log(spark, sf):
    path = stage_path(spark, "log")
    _result_lines(spark, sf).select("value").write.text(path)
    return path


_KIND = "task_id % 8 % 4"
_LOG = f"""SELECT CAST(task_id AS VARCHAR) AS task_id, CASE WHEN task_id % 8 < 6 THEN 'Q' || task_id ELSE '{{"id":' || task_id || '}}' END AS prompt,
    CASE {_KIND} WHEN 0 THEN {duck.lenient_verdict('content')} WHEN 1 THEN {duck.lenient_verdict('content')} WHEN 2 THEN truth ELSE 'unknown' END AS resolve_yn,
    {_KIND} = 3 AS failed FROM {{verdicts}} v WHERE model <> 'src7'"""


@query("result_log", _LOG)
def _(spark, sf):
    log = logs.read_result_log(spark, _write_log(spark, sf), "resolve_yn").where("bad_line IS NULL")
    return log.select("task_id", "prompt", "resolve_yn", F.coalesce("failed", F.lit(False)).alias("failed"))


@query(
    "result_log_compat",
    f"""SELECT CASE WHEN {_KIND} = 3 THEN '' ELSE CAST(task_id AS VARCHAR) END AS task_id,
        CASE {_KIND} WHEN 2 THEN '{{"resolve_yn":"' || upper(truth) || '"}}' WHEN 3 THEN '{{"error":"timed out","task_id":' || task_id || '}}' ELSE content END AS response
        FROM {{verdicts}} v WHERE model <> 'src7'""",
)
def _(spark, sf):
    log = logs.read_result_log(spark, _write_log(spark, sf), compat=True).where("bad_line IS NULL")
    return log.select("task_id", "response")


@query("result_log_rejects", "SELECT '[{bad ' || task_id AS bad_line FROM {verdicts} v WHERE model = 'src7'")
def _(spark, sf):
    return logs.read_result_log(spark, _write_log(spark, sf)).where("bad_line IS NOT NULL").select("bad_line")


@query(
    "result_log_summary",
    f"""SELECT n AS total_requests, s + f AS completed, s AS successful, f AS failed, {duck.percent('s + f', 'n')} AS completion_pct,
        {duck.percent('s', 'n')} AS success_pct, {duck.percent('f', 'n')} AS failure_pct
        FROM (SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER ({_KIND} < 3) AS BIGINT) AS s,
              CAST(count(*) FILTER ({_KIND} = 3) AS BIGINT) AS f FROM {{verdicts}} v WHERE model <> 'src7') x""",
)
def _(spark, sf):
    return outcomes.log_summary(logs.read_result_log(spark, _write_log(spark, sf)))


@query(
    "stats_append",
    """SELECT verified, timestamp, tested_model, CASE WHEN verified THEN evaluator_model END AS evaluator_model, accuracy,
       CASE WHEN NOT verified THEN run_id / 1000 END AS avg_translation_time_s, CASE WHEN verified THEN 'verification' ELSE 'translation' END AS phase
       FROM (SELECT *, test_dataset = 'F' AS verified FROM {runs} r) x""",
)
def _(spark, sf):
    path = stage_path(spark, "stats")
    runs = view(spark, sf, "runs")
    verified = runs.where("test_dataset = 'F'").withColumn("phase", F.lit("verification"))
    translated = runs.where("test_dataset <> 'F'").drop("evaluator_model").withColumns(
        {"phase": F.lit("translation"), "avg_translation_time_ms": F.col("run_id"), "memory_usage": F.lit(1)}
    )
    stats.append_stats(verified, path)
    stats.append_stats(translated, path)
    rows = stats.read_stats(spark, path)
    return rows.select(
        (F.col("phase") == "verification").alias("verified"),
        "timestamp", "tested_model", "evaluator_model", "accuracy", "avg_translation_time_s", "phase",
    )


@query(
    "stats_csv_union",
    """SELECT timestamp, tested_model, evaluator_model, successful_count, comments FROM (
         SELECT timestamp, tested_model, evaluator_model, successful_count, 'say "' || run_id || '",' || chr(10) || 'next' AS comments FROM {runs} r WHERE test_dataset = 'F'
         UNION ALL SELECT timestamp, tested_model, NULL, successful_count, 'plain' FROM {runs} r WHERE test_dataset <> 'F') x""",
)
def _(spark, sf):
    path = stage_path(spark, "stats")
    note = F.concat(F.lit('say "'), F.col("run_id"), F.lit('",\nnext'))
    runs = view(spark, sf, "runs").withColumn("comments", F.when(F.col("test_dataset") == "F", note).otherwise("plain"))
    stamped = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")
    for name, fields, part in (
        ("verification", stats.VERIFICATION_FIELDS, "test_dataset = 'F'"),
        ("translation", stats.GENERATION_FIELDS, "test_dataset <> 'F'"),
    ):
        rows = stats.stats_rows(runs.where(part).withColumn("phase", F.lit(name)))
        datasets.write_csv(rows.withColumn("timestamp", stamped).select(fields), f"{path}/{name}")
    union = stats.read_stats_csv(spark, f"{path}/verification", f"{path}/translation")
    return union.select("timestamp", "tested_model", "evaluator_model", "successful_count", "comments")


@query(
    "latency_csv",
    "SELECT model, test_no, load_s, total_s, tokens FROM (SELECT model, CAST(test_no AS INTEGER) AS test_no, load_s, total_s, CASE WHEN test_no % 3 > 0 THEN tokens END AS tokens FROM {tests} t) x",
)
def _(spark, sf):
    path = stage_path(spark, "latency")
    names = [f.split(" ")[0] for f in stats.LATENCY_SCHEMA.split(", ")]
    rows = view(spark, sf, "tests").withColumn("tokens", F.when(F.col("test_no") % 3 > 0, F.col("tokens")))
    cells = [
        F.coalesce(F.col(n).cast("string"), F.lit("N/A")).alias(n) if n in rows.columns else F.lit("N/A").alias(n)
        for n in names
    ]
    datasets.write_csv(rows.select(cells), path)
    return stats.read_latency_csv(spark, path).select("model", "test_no", "load_s", "total_s", "tokens")


@query(
    "resume_stage",
    "SELECT doc_id, text, source, lang AS split, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'first' ELSE 'second' END AS run FROM documents",
)
def _(spark, sf):
    path = stage_path(spark, "resume")
    rows = _documents(spark, sf)
    labels = table(spark, sf, "labels").select("doc_id")
    schema = rows.withColumn("run", F.lit("")).schema

    def stage_of(run, todo, finished=None):
        return artifacts.resume_stage(todo, path, ["doc_id"], lambda r: r.withColumn("run", F.lit(run)), schema, 16, finished)

    stage_of("first", rows.join(labels, "doc_id", "left_semi"))
    # Rows that fail are tried again by the next run; running the rest twice adds nothing the second time.
    stage_of("second", rows, F.col("doc_id") % 2 == 0)
    stage_of("second", rows)
    return stage_of("third", rows)
