"""Batch inference as one Spark stage.

The model client is supplied by the caller as a factory, built once per partition. A client is a
callable ``client(request_json, attempt) -> response_json``; it signals failure by raising.
"""

from __future__ import annotations

import queue
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalflow.staging import stage

Client = Callable[[str, int], str]
ClientFactory = Callable[[], Client]

#: Besides the outcome: ``final`` marks a failure that is not repeated, ``last`` the attempt a request ended with.
ATTEMPT_SCHEMA = (
    "task_id bigint, model string, phase string, attempt int, start_ts timestamp_ntz, end_ts timestamp_ntz, "
    "ok boolean, final boolean, last boolean, response string, error string"
)
#: Requests of a task, about: what is lost with an executor, and the smallest share that can be dealt anew.
TASK_REQUESTS = 1000
#: Attempts that leave a task at a time, about.
_ROWS = 500
_COLUMNS = [field.strip().split(" ")[0] for field in ATTEMPT_SCHEMA.split(",")]


class CallError(Exception):
    """A failed model call. Client errors (status 400..499 but 429) are final, all others retriable."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status

    @property
    def final(self) -> bool:
        return self.status is not None and 400 <= self.status < 500 and self.status != 429


def _is_final(error: Exception) -> bool:
    """Connection errors, time-outs, server errors and call limits may pass; anything else would only repeat itself."""
    if isinstance(error, CallError):
        return error.final
    return not isinstance(error, (ConnectionError, TimeoutError))


class _Caller:
    """Makes calls in a thread of its own, so that a call can be left behind when its time is over.

    The thread is kept from call to call; only one that did not answer is replaced.
    """

    def __init__(self, client: Client):
        self.client = client
        self._start()

    def _start(self) -> None:
        self.asked, self.answers = queue.SimpleQueue(), queue.SimpleQueue()
        threading.Thread(target=self._serve, args=(self.asked, self.answers), daemon=True).start()

    def _serve(self, asked: queue.SimpleQueue, answers: queue.SimpleQueue) -> None:
        while (call := asked.get()) is not None:
            try:
                answers.put((self.client(*call), None))
            except BaseException as e:  # the worker's own exit has to reach the worker
                answers.put((None, e))

    def __call__(self, request: str, attempt: int, timeout_s: float) -> str:
        self.asked.put((request, attempt))
        try:
            response, error = self.answers.get(timeout=timeout_s)
        except queue.Empty:
            self.asked.put(None)  # for when the call comes back after all
            self._start()
            raise TimeoutError(f"no answer within {timeout_s:g} s") from None
        if error is not None:
            raise error
        return response

    def close(self) -> None:
        self.asked.put(None)


def _call_with_retries(client, accept, max_attempts, backoff_s, row: tuple) -> list[tuple]:
    """All attempts of one request, the last one being a success or the final failure."""
    task_id, model, phase, request, *carried = row
    attempts = []
    for attempt in range(1, max_attempts + 1):
        start = pd.Timestamp.now("UTC").tz_localize(None)
        response, error, final = None, None, False
        try:
            response = client(request, attempt)
            if accept is not None and not accept(response):
                error = "response could not be read"
        except Exception as e:
            error, final = f"{type(e).__name__}: {e}", _is_final(e)
        end = pd.Timestamp.now("UTC").tz_localize(None)
        last = error is None or final or attempt == max_attempts
        attempts.append((task_id, model, phase, attempt, start, end, error is None, final, last, response, error, *carried))
        if last:
            break
        if backoff_s and attempt < max_attempts:
            time.sleep(min(backoff_s * 2 ** (attempt - 1), 60.0))
    return attempts


def invoke(
    requests: DataFrame,
    client_factory: ClientFactory,
    *,
    max_attempts: int = 10,
    concurrency: int = 10,
    backoff_s: float = 1.0,
    accept: Callable[[str], bool] | None = None,
    timeout_s: float | None = 300.0,
    partitions: int | None = None,
    phase: str = "run",
    carry: Sequence[str] = (),
    spread: Sequence[str] = ("task_id", "model"),
    attempts_path: str | None = None,
    buckets: int = 1,
) -> DataFrame:
    """Call the model for each row ``task_id, model, request`` and return one row per attempt.

    A request is tried until it succeeds, fails for good, or used ``max_attempts``. A call without answer after
    ``timeout_s`` and an answer that ``accept`` turns down are failures that may be repeated. Columns in ``carry``
    are repeated on every attempt and belong to the key of a request; ids keep their type. Requests are spread by ``spread``
    over tasks of about TASK_REQUESTS requests, or ``partitions`` tasks, with ``concurrency`` calls at once in each, and
    called in the order of their ids inside a task.

    The attempts are written and read back, so no later action repeats a call. With ``attempts_path`` they are written
    there, every task's as soon as it is done (a repeated task replaces its own file), and requests that have ended in an
    earlier run are not called again: a run that is broken off repeats the calls of the tasks that were running at
    most. ``buckets`` cuts a run into that many jobs, one after the other.
    """
    spark = requests.sparkSession
    source = requests.select("task_id", "model", F.lit(phase).alias("phase"), "request", *carry)
    types = dict(source.dtypes)
    if types["request"] != "string":
        source = source.withColumn("request", F.to_json("request"))
    columns = [*_COLUMNS, *carry]
    schema = ", ".join([ATTEMPT_SCHEMA.replace("task_id bigint", f"task_id {types['task_id']}"), *[f"{c} {types[c]}" for c in carry]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = client_factory()
        callers, idle = [], queue.SimpleQueue()

        def ask(request: str, attempt: int) -> str:
            if not timeout_s or timeout_s <= 0:
                return client(request, attempt)
            caller = idle.get()
            try:
                return caller(request, attempt, timeout_s)
            finally:
                idle.put(caller)

        try:
            if timeout_s and timeout_s > 0:
                callers = [_Caller(client) for _ in range(concurrency)]
                for caller in callers:
                    idle.put(caller)
            with ThreadPoolExecutor(concurrency) as pool:
                # The pool is kept filled across batches; results leave in the order of the requests.
                waiting, held = deque(), []
                for batch in batches:
                    for row in batch.itertuples(index=False, name=None):
                        waiting.append(pool.submit(_call_with_retries, ask, accept, max_attempts, backoff_s, row))
                        if len(waiting) > 4 * concurrency:
                            held += waiting.popleft().result()
                        if len(held) >= _ROWS:
                            yield pd.DataFrame(held, columns=columns)
                            held = []
                while waiting:
                    held += waiting.popleft().result()
                if held:
                    yield pd.DataFrame(held, columns=columns)
        finally:
            for caller in callers:
                caller.close()
            getattr(client, "close", lambda: None)()

    def called(part: DataFrame) -> DataFrame:
        # A fixed number of tasks: adaptive execution would merge small requests into a few slow tasks.
        tasks = partitions or max(spark.sparkContext.defaultParallelism, -(-part.count() // TASK_REQUESTS))
        return part.repartition(tasks, *spread).sortWithinPartitions("task_id").mapInPandas(run, schema)

    if attempts_path is None:
        return stage(called(source), "attempts")
    keys = ["task_id", "model", "phase", *carry]
    try:
        ended = spark.read.schema(schema).parquet(attempts_path).where("last").select(*keys)
        source = source.join(ended, keys, "left_anti").select(*source.columns)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    source = stage(source, "requests")
    for bucket in range(buckets):
        part = source.where(F.pmod(F.xxhash64("task_id", "model"), F.lit(buckets)) == bucket) if buckets > 1 else source
        # Version 2 of the committer puts a task's file in place when the task ends, not when the job does.
        called(part).write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(attempts_path)
    return spark.read.schema(schema).parquet(attempts_path)


def warm_up(
    spark: SparkSession, client_factory: ClientFactory, model: str, request: str, timeout_s: float | None = 300.0
) -> DataFrame:
    """Attempt rows of one call that loads the model; phase ``warmup`` keeps them out of statistics."""
    one = spark.createDataFrame([(-1, model, request)], "task_id bigint, model string, request string")
    return invoke(one, client_factory, max_attempts=1, concurrency=1, partitions=1, phase="warmup", timeout_s=timeout_s)


def run_attempts(attempts: DataFrame) -> DataFrame:
    return attempts.where(F.col("phase") == "run")


def latest_outcome(attempts: DataFrame, keys: tuple[str, ...] = ("task_id",), order: tuple[str, ...] = ("attempt",)) -> DataFrame:
    """One row per request: its last attempt.

    Attempts of ``invoke`` mark it, which makes this a filter. Otherwise ``max_by`` is combined before the shuffle, so a
    request logged very often costs one row per task.
    """
    if "last" in attempts.columns:
        return attempts.where("last")
    others = [c for c in attempts.columns if c not in keys]
    last = F.max_by(F.struct(*others), F.struct(*order))
    return attempts.groupBy(*keys).agg(last.alias("_last")).select(*keys, "_last.*")
