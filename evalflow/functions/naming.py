"""Keys and classes derived from dataset names, model names and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalflow.functions.text import blank_to_null

# Device names that cannot be file names.
RESERVED_NAMES = [
    "CON", "PRN", "AUX", "NUL",
    "COM1", "COM2", "COM3", "COM4", "COM5", "COM6", "COM7", "COM8", "COM9",
    "LPT1", "LPT2", "LPT3", "LPT4", "LPT5", "LPT6", "LPT7", "LPT8", "LPT9",
]


def safe_name(name: Column) -> Column:
    """A name usable as file or partition name on every system."""
    cleaned = F.rtrim(F.translate(name, '<>:"/\\|?*', "__-______"), F.lit(". "))
    unusable = (cleaned == "") | F.upper(cleaned).isin(RESERVED_NAMES)
    return F.when(unusable, F.concat(F.lit("_"), cleaned)).otherwise(cleaned)


def artifact_key(dataset: Column, model: Column) -> Column:
    return safe_name(F.concat(dataset, F.lit("."), model))


# The size labels 7B, 8B, 13-14B, 27-30B, 70B and Unknown.
def model_size(model: Column, compat: bool = False) -> Column:
    """Size class of a model name.

    The default reads the number in front of the ``b``; ``compat=True`` looks for the texts
    7b, 8b, 13b/14b, 27b/30b and 70b in this order, so that 27b counts as 7B.
    """
    name = F.lower(model)
    if compat:
        return (
            F.when(name.contains("7b"), "7B")
            .when(name.contains("8b"), "8B")
            .when(name.contains("13b") | name.contains("14b"), "13-14B")
            .when(name.contains("27b") | name.contains("30b"), "27-30B")
            .when(name.contains("70b"), "70B")
            .otherwise("Unknown")
        )
    billions = F.regexp_extract(name, r"(?:^|[^0-9.])([0-9]+)b(?:$|[^a-z0-9])", 1).try_cast("int")
    return (
        F.when(billions == 7, "7B")
        .when(billions == 8, "8B")
        .when(billions.isin(13, 14), "13-14B")
        .when(billions.isin(27, 30), "27-30B")
        .when(billions == 70, "70B")
        .otherwise("Unknown")
    )


def is_chat_model(model: Column) -> Column:
    return F.lower(model).rlike("^(gpt|o1|o3)")


def provider_kind(model: Column) -> Column:
    return F.when(is_chat_model(model), "chat").otherwise("prompt")


def endpoint_kind(url: Column) -> Column:
    """Endpoint of a request URL, by the documented forms, else NULL.

    Hosted deployment: ``https://host/openai/deployments/name/<endpoint>?api-version=...``; hosted API:
    ``https://host/v1/<endpoint>``; local server: ``http://host:port/api/<endpoint>``. The path is read by its
    segments; the query is not part of it.
    """
    secure = F.try_parse_url(url, F.lit("PROTOCOL")) == "https"
    local = (F.try_parse_url(url, F.lit("PROTOCOL")) == "http") & F.contains(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit(":"))
    segments = F.split(F.try_parse_url(url, F.lit("PATH")), "/")
    first, second = F.get(segments, 1), F.get(segments, 2)

    def behind(n: int) -> Column:
        return blank_to_null(F.array_join(F.slice(segments, n + 2, F.greatest(F.size(segments), F.lit(1))), "/"))

    return (
        F.when(secure & (first == "openai") & (second == "deployments"), behind(3))
        .when(secure & first.rlike("^v[0-9]+$"), behind(1))
        .when(local & (first == "api"), behind(1))
    )
