"""Latency fields of saved responses, verbose run texts and resource samples.

Seconds are cut (not rounded) to 6 decimals and token rates to 2, by integer division.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalflow.functions.text import with_json_object


def _int_div(a: Column, b: Column) -> Column:
    """Integer division towards zero; NULL when the divisor is zero or NULL."""
    return F.call_function("div", a, F.nullif(b, F.lit(0)))


def _to_micros(seconds: Column) -> Column:
    return F.rint(seconds * F.lit(1e6)).cast("bigint")


def _micros_to_seconds(micros: Column) -> Column:
    return micros.cast("double") / F.lit(1e6)


def _token_rate(tokens: Column, total_micros: Column) -> Column:
    """Tokens per second cut to 2 decimals; NULL for no tokens or no time."""
    cents = _int_div(tokens * F.lit(100_000_000), total_micros)
    return F.when((tokens != 0) & (total_micros > 0), cents.cast("double") / F.lit(100.0))


_LATENCY = ("load_s", "first_token_s", "total_s", "tokens", "tokens_per_s")


def with_response_latency(df: DataFrame, response_json: Column, measured_s: Column) -> DataFrame:
    """The rows with load, first-token and total seconds, tokens and token rate of their response.

    Server times are nanoseconds. The measured time stands in for the total when the server
    gave none; an invalid or failed response keeps only the measured time. Each value that is needed more than
    once is a projection of its own, which the optimizer does not merge into the next: the JSON is parsed once
    and everything stays in generated code.
    """
    thousand = F.lit(1000).cast("bigint")
    rows = with_json_object(df.withColumn("_measured", measured_s), response_json, "_json")

    def nanos(name: str) -> Column:
        return F.coalesce(F.try_variant_get("_json", f"$.{name}", "bigint"), F.lit(0).cast("bigint"))

    error = F.try_variant_get("_json", "$.error", "string")
    rows = rows.withColumns(
        {
            "_usable": F.col("_json").isNotNull() & (error.isNull() | error.isin("", "false")),
            "_total": nanos("total_duration"),
            "_load": nanos("prompt_eval_duration"),
            "_generation": nanos("eval_duration"),
            "_tokens": nanos("eval_count"),
        }
    )
    usable, total, tokens = F.col("_usable"), F.col("_total"), F.col("_tokens")
    rows = rows.withColumn("_timed", usable & (F.col("_generation") != 0) & (total != 0))
    timed = F.col("_timed")
    micros = F.when(timed, _int_div(total, thousand)).otherwise(_to_micros(F.col("_measured")))
    rows = rows.withColumn("_micros", micros)
    return rows.select(
        *[c for c in df.columns if c not in _LATENCY],
        F.when(usable & (F.col("_load") != 0), _micros_to_seconds(_int_div(F.col("_load"), thousand))).alias("load_s"),
        F.when(timed, _micros_to_seconds(_int_div(total - F.col("_generation"), thousand))).alias("first_token_s"),
        _micros_to_seconds(F.col("_micros")).alias("total_s"),
        F.when(usable, tokens).alias("tokens"),
        F.when(usable, _token_rate(tokens, F.col("_micros"))).alias("tokens_per_s"),
    )


def _millis(text: Column, *patterns: str) -> Column:
    """Seconds of the first pattern that matches a millisecond amount."""
    found = [F.regexp_extract(text, p, 1).try_cast("double") / F.lit(1000.0) for p in patterns]
    return F.coalesce(*found)


def _largest_count(text: Column, *patterns: str) -> Column:
    """Largest count of the first pattern that matches at all."""

    def largest(pattern: str) -> Column:
        counts = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        return F.array_max(F.transform(counts, lambda n: n.try_cast("bigint")))

    return F.coalesce(*[largest(p) for p in patterns])


def text_latency(text: Column, total_s: Column) -> Column:
    """Struct of latency fields printed in a verbose run text; several wordings are known."""
    tokens = _largest_count(
        text, r"eval count: *([0-9]+) token\(s\)", "generated ([0-9]+) tokens", "eval ([0-9]+) tokens"
    )
    total_micros = _to_micros(total_s)
    return F.struct(
        _millis(text, r"load ([0-9.]+)ms", r"loaded [^\n]* in ([0-9.]+)ms").alias("load_s"),
        _millis(text, r"first token ([0-9.]+)ms", r"first token in ([0-9.]+)ms").alias("first_token_s"),
        total_s.alias("total_s"),
        tokens.alias("tokens"),
        _token_rate(tokens, total_micros).alias("tokens_per_s"),
    )


def resource_sample(line: Column) -> Column:
    """Struct ``cpu_pct, mem_mib`` of one saved sample line; other memory units are NULL."""
    return F.struct(
        F.regexp_extract(line, r"([0-9.]+)%", 1).try_cast("double").alias("cpu_pct"),
        F.regexp_extract(line, r"([0-9.]*)MiB", 1).try_cast("double").alias("mem_mib"),
    )
