"""Token estimates of requests."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_MAX_TOKENS = 15
TokenCounter = Callable[[Column], Column]


def word_tokens(texts: Column) -> Column:
    """Tokens of an array of strings counted as words and punctuation marks, in the JVM."""
    pattern = F.lit(r"(?U)\w+|[^\w\s]")
    return F.aggregate(texts, F.lit(0).cast("bigint"), lambda n, t: n + F.regexp_count(t, pattern))


def python_tokens(encode: Callable[[str], list]) -> TokenCounter:
    """Counter that runs a Python tokenizer over Arrow batches."""

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda row: 0 if row is None else sum(len(encode(t)) for t in row if t is not None))

    return lambda texts: count(texts)


def chat_cost(messages: Column, max_tokens: Column, n: Column, counter: TokenCounter) -> Column:
    """4 per message, minus 1 for a name, plus all values, plus 2, plus the answers' budget."""
    values = F.flatten(
        F.transform(messages, lambda m: F.array_compact(F.array(m["role"], m["content"], m["name"])))
    )
    names = F.size(F.filter(messages, lambda m: m["name"].isNotNull()))
    return F.lit(4) * F.size(messages) - names + counter(values) + F.lit(2) + n * max_tokens


def prompt_cost(prompts: Column, max_tokens: Column, n: Column, counter: TokenCounter) -> Column:
    return counter(prompts) + n * max_tokens * F.size(prompts)


def request_cost(
    endpoint: Column,
    *,
    messages: Column,
    prompts: Column,
    inputs: Column,
    max_tokens: Column | None = None,
    n: Column | None = None,
    counter: TokenCounter = word_tokens,
) -> Column:
    """Token estimate by endpoint kind.

    ``messages`` is an array of ``struct<role, content, name>``, ``prompts`` and ``inputs`` are
    arrays of strings. Any other endpoint is an error.
    """
    limit = F.coalesce(max_tokens if max_tokens is not None else F.lit(None), F.lit(DEFAULT_MAX_TOKENS))
    copies = F.coalesce(n if n is not None else F.lit(None), F.lit(1))
    completion = endpoint.endswith("completions") | endpoint.endswith("generate") | endpoint.endswith("chat")
    return (
        F.when(completion & endpoint.startswith("chat"), chat_cost(messages, limit, copies, counter))
        .when(completion, prompt_cost(prompts, limit, copies, counter))
        .when(endpoint == "embeddings", counter(inputs))
        .otherwise(F.raise_error(F.concat(F.lit("no token estimate for endpoint "), F.coalesce(endpoint, F.lit("NULL")))))
        .cast("bigint")
    )
