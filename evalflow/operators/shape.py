"""Shaping of datasets: prompt parsing, handler chains, cases, training rows, dialect tags."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from evalflow.functions.dialect import combined_dialects, dialect_class, pattern_dialects
from evalflow.functions.text import FENCE, let, strip

_QUESTION, _METADATA = "question:", "metadata:"


@dataclass(frozen=True)
class PromptHandler:
    """A prompt form: when it applies, and the ``struct<context, question, answer>`` it yields."""

    applies: Callable[[Column], Column]
    parse: Callable[[Column, Column], Column]


def _question_metadata(prompt: Column, completion: Column) -> Column:
    q, m = F.instr(prompt, _QUESTION), F.instr(prompt, _METADATA)
    q_end = q + len(_QUESTION)
    question = strip(F.substr(prompt, q_end, F.greatest(m - q_end, F.lit(0))))
    rest = strip(F.substr(prompt, m + len(_METADATA)))
    opened = F.substr(rest, F.lit(len(FENCE) + 1))
    tail = F.substring_index(opened, FENCE, -1)
    closed = F.left(opened, F.length(opened) - F.length(tail) - len(FENCE))
    body = F.when(opened.contains(FENCE), closed).otherwise(opened)
    context = strip(F.when(rest.startswith(FENCE), body).otherwise(rest))
    return F.struct(context.alias("context"), question.alias("question"), strip(completion).alias("answer"))


QUESTION_METADATA = PromptHandler(
    applies=lambda prompt: prompt.contains(_QUESTION) & prompt.contains(_METADATA),
    parse=_question_metadata,
)


def keep_present(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a computed column and keep the rows where it is not NULL.

    A filter on a computed column is pushed below it and computes it a second time; an explode of the
    values that are present computes it once.
    """
    others = [c for c in df.columns if c != name]
    return df.select(*others, F.explode(F.array_compact(F.array(value))).alias(name))


def _parsed(handlers: Sequence[PromptHandler], prompt: str = "prompt", completion: str = "completion") -> Column:
    text, answer = F.coalesce(F.col(prompt), F.lit("")), F.coalesce(F.col(completion), F.lit(""))
    chain = None
    for handler in handlers:
        chain = (F if chain is None else chain).when(handler.applies(text), handler.parse(text, answer))
    return chain


def parse_prompts(
    df: DataFrame,
    handlers: Sequence[PromptHandler] = (QUESTION_METADATA,),
    prompt: str = "prompt",
    completion: str = "completion",
) -> DataFrame:
    """Add the struct ``parsed``; NULL where no handler applies or the applying one fails.

    The first handler that applies decides, also when its parse yields NULL.
    """
    return df.withColumn("parsed", _parsed(handlers, prompt, completion))


def transform_prompts(
    df: DataFrame,
    handlers: Sequence[PromptHandler] = (QUESTION_METADATA,),
    keep: Sequence[str] = (),
    observation: Observation | None = None,
) -> DataFrame:
    """Rows ``context, question, answer`` of all prompts that can be parsed.

    With an ``Observation`` the numbers of retained and skipped rows are collected during the pass.
    """
    if observation is None:
        kept = keep_present(df.select(*keep, "prompt", "completion"), "parsed", _parsed(handlers))
    else:
        whole = parse_prompts(df, handlers).observe(
            observation,
            F.count_if(F.col("parsed").isNotNull()).alias("retained"),
            F.count_if(F.col("parsed").isNull()).alias("skipped"),
        )
        kept = whole.where(F.col("parsed").isNotNull())
    return kept.select(*keep, "parsed.*")


def skipped_prompts(df: DataFrame, handlers: Sequence[PromptHandler] = (QUESTION_METADATA,)) -> DataFrame:
    """The rows ``transform_prompts`` leaves out."""
    return parse_prompts(df, handlers).where(F.col("parsed").isNull()).drop("parsed")


def _dialects(sql_column: str, candidates: str | None) -> Column:
    found = F.array().cast("array<string>") if candidates is None else F.col(candidates)
    return combined_dialects(pattern_dialects(F.col(sql_column)), found)


def with_dialects(
    df: DataFrame, sql_column: str = "sql", dbms_column: str = "dbms", candidates: str | None = None
) -> DataFrame:
    """Add the sorted dialect list; ``candidates`` names an array column of an external checker."""
    return df.withColumn(dbms_column, _dialects(sql_column, candidates))


def tag_dialects(
    df: DataFrame, sql_column: str = "sql", dbms_column: str = "dbms", candidates: str | None = None
) -> DataFrame:
    """Rows with at least one dialect. A table without the SQL column comes back unchanged."""
    if sql_column not in df.columns:
        return df
    found = let(_dialects(sql_column, candidates), lambda d: F.when(F.size(d) > 0, d))
    return keep_present(df, dbms_column, found)


def untagged_rows(df: DataFrame, sql_column: str = "sql", candidates: str | None = None) -> DataFrame:
    """The rows ``tag_dialects`` drops."""
    return with_dialects(df, sql_column, "_dbms", candidates).where(F.size("_dbms") == 0).drop("_dbms")


def with_dialect_class(df: DataFrame, dbms_column: str = "dbms", name: str = "dbms_class") -> DataFrame:
    return df.withColumn(name, dialect_class(F.col(dbms_column)))


def transform_and_tag(
    df: DataFrame,
    handlers: Sequence[PromptHandler] = (QUESTION_METADATA,),
    keep: Sequence[str] = (),
    sql_column: str = "answer",
    candidates: str | None = None,
) -> DataFrame:
    """Parse prompts and tag the SQL in one pass."""
    return tag_dialects(transform_prompts(df, handlers, keep), sql_column, "dbms", candidates)


def training_rows(df: DataFrame, key: Sequence[str], excluded_db: int = 1, seed: int = 42, db_column: str = "db_id") -> DataFrame:
    """Complete rows of all databases but one, in a repeatable shuffled order."""
    clean = df.dropna("any").where(F.col(db_column) != excluded_db)
    return clean.orderBy(F.xxhash64(F.lit(seed), *key), *key)


def cases(joined: DataFrame, verdict: str) -> DataFrame:
    """Rows of one verdict in task order.

    After the filter the verdict is a constant, so an expensive reading runs once, in the filter.
    """
    found = joined.where(F.col("resolve_yn") == verdict).withColumn("resolve_yn", F.lit(verdict))
    # The row number behind the id lets the sort spread an id that repeats very often.
    numbered = found.select(*joined.columns, F.monotonically_increasing_id().alias("_row"))
    return numbered.orderBy("task_id", "_row").drop("_row")


def pending_rows(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key has no finished output yet (resume).

    Keys may repeat in ``done``: they are reduced to distinct ones before the shuffle, which the join
    needs anyway. A hot key on the left is split by the adaptive skew join.
    """
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti")
