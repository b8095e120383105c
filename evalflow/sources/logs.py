"""Request-job logs and result logs (one JSON value per line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalflow.functions.responses import variant_content
from evalflow.functions.text import strip
from evalflow.functions.verdict import lenient_verdict

JOB_SCHEMA = "task_id string, request variant, metadata variant, index variant, _corrupt string"


def write_jobs(jobs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write ``task_id, request`` as JSON lines; ``request`` is a struct or JSON text."""
    if dict(jobs.dtypes)["request"] == "string":
        jobs = jobs.withColumn("request", F.parse_json("request"))
    jobs.select("task_id", "request").write.mode(mode).json(path)


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Columns ``task_id, request, metadata`` (JSON text) and ``bad_line`` for unreadable lines.

    An ``index`` key is dropped. Keep the good rows with ``where bad_line is null``; counting the
    others is one aggregate over the same scan.
    """
    raw = spark.read.schema(JOB_SCHEMA).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return raw.select(
        "task_id",
        F.to_json("request").alias("request"),
        F.to_json("metadata").alias("metadata"),
        F.col("_corrupt").alias("bad_line"),
    )


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their file and zero-based line number.

    A file is read in blocks by many tasks. Lines are numbered inside their block (a window no
    larger than a block) and shifted by the line counts of the blocks before it.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
    )
    in_block = W.partitionBy("file", "block").orderBy("seq")
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        lines.groupBy("file", "block")
        .agg(F.count("*").alias("n"))
        .select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    return (
        lines.withColumn("pos", F.row_number().over(in_block) - 1)
        .join(offsets, ["file", "block"])
        .select("file", (F.col("start") + F.col("pos")).cast("bigint").alias("line_no"), "value")
    )


def read_jobs_with_line_numbers(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_jobs`` without bad lines; a job without metadata gets its line number as metadata."""
    job = F.try_parse_json("value")
    numbered = numbered_lines(spark, path).select("line_no", job.alias("job")).where(F.col("job").isNotNull())
    own = F.to_json(F.try_variant_get("job", "$.metadata", "variant"))
    return numbered.select(
        F.try_variant_get("job", "$.task_id", "string").alias("task_id"),
        F.to_json(F.try_variant_get("job", "$.request", "variant")).alias("request"),
        F.coalesce(own, F.to_json(F.struct(F.col("line_no").alias("original_index")))).alias("metadata"),
    )


def parse_result_lines(lines: DataFrame, response_column: str = "response", compat: bool = False) -> DataFrame:
    """Read result-log lines ``[request, response, metadata?, {task_id}]`` in column ``value``.

    Columns: ``task_id, prompt, <response_column>, failed, n_elements, bad_line``. The default takes the
    id from the last element, so failure lines keep it; ``compat=True`` reads the third element
    only and leaves the id empty when it is no object. With ``response_column="resolve_yn"`` the
    response is reduced to a verdict. A line that is no JSON array is returned in ``bad_line``.
    """
    # Each line is parsed once: a filter on a column derived from an exploded value stays above it.
    items = F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>")
    log = lines.select("value", F.explode(F.array(items)).alias("items"))
    log = log.withColumns({"request": F.get("items", 0), "response": F.get("items", 1)})
    log = log.withColumn("content", variant_content(F.col("response")))

    is_object = F.schema_of_variant("response").startswith("OBJECT")
    request_is_object = F.schema_of_variant("request").startswith("OBJECT")
    prompt = F.when(
        request_is_object,
        F.coalesce(
            F.try_variant_get("request", "$.messages[0].content", "string"),
            F.try_variant_get("request", "$.prompt", "string"),
            F.to_json("request"),
        ),
    ).otherwise("")
    if response_column == "resolve_yn":
        direct = strip(F.lower(F.try_variant_get("response", "$.resolve_yn", "string")))
        answer = F.coalesce(direct, lenient_verdict(F.col("content")), F.lit("unknown"))
    else:
        answer = F.coalesce(F.col("content"), F.to_json("response"))
    good = F.col("items").isNotNull()
    last = F.get("items", F.size("items") - 1)
    id_item = F.get("items", 2) if compat else last
    task_id: Column = F.try_variant_get(id_item, "$.task_id", "string")
    return log.select(
        F.when(good, F.coalesce(task_id, F.lit("")) if compat else task_id).alias("task_id"),
        F.when(good, prompt).alias("prompt"),
        F.when(good, F.when(is_object, answer).otherwise("")).alias(response_column),
        F.try_variant_get("response", "$.error", "variant").isNotNull().alias("failed"),
        F.size("items").alias("n_elements"),
        F.when(~good, F.col("value")).alias("bad_line"),
    )


def read_result_log(
    spark: SparkSession, path: str, response_column: str = "response", compat: bool = False
) -> DataFrame:
    return parse_result_lines(spark.read.text(path), response_column, compat)


def write_result_log(requests: DataFrame, attempts: DataFrame, path: str, mode: str = "append") -> None:
    """Write a line ``[request, response or error, {task_id}]`` for every request that has ended.

    ``requests`` has ``task_id, model, request`` (JSON text or a struct), ``attempts`` are those of ``invoke``.
    """
    asked = requests.select("task_id", "model", "request")
    if dict(asked.dtypes)["request"] != "string":
        asked = asked.withColumn("request", F.to_json("request"))
    last = attempts.where("last").select("task_id", "model", "response", "error")
    answered = F.col("error").isNull() & F.try_parse_json("response").isNotNull()
    problem = F.to_json(F.struct(F.coalesce("error", F.lit("response is no JSON")).alias("error")))
    response = F.when(answered, F.col("response")).otherwise(problem)
    rows = asked.join(last, ["task_id", "model"])
    rows.select(result_line(F.col("request"), response, F.col("task_id")).alias("value")).write.mode(mode).text(path)


def result_line(request: Column, response: Column, task_id: Column, metadata: Column | None = None) -> Column:
    """One result-log line from JSON texts; ``response`` may be an error object."""
    parts = [request, response] + ([metadata] if metadata is not None else [])
    ident = F.to_json(F.struct(task_id.alias("task_id")))
    return F.concat(F.lit("["), F.concat_ws(",", *parts, ident), F.lit("]"))
