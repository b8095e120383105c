"""Classes of call errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RATE_LIMIT, API, OTHER = "rate_limit", "api", "other"


def is_rate_limit(message: Column) -> Column:
    return F.coalesce(F.lower(message).rlike("rate limit|rate_limit"), F.lit(False))


def error_class(error: Column, api_error: Column | None = None) -> Column:
    """Class of a failed call; NULL when it did not fail.

    ``error`` is the text of an exception (connection, time-out, HTTP status, unreadable
    answer), ``api_error`` the message of an error object inside a response.
    """
    api_error = F.lit(None).cast("string") if api_error is None else api_error
    return (
        F.when(is_rate_limit(api_error) | is_rate_limit(error), RATE_LIMIT)
        .when(api_error.isNotNull(), API)
        .when(error.isNotNull(), OTHER)
    )
