"""Time arithmetic that does not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = "1970-01-01"


def micros(time: Column) -> Column:
    """Microseconds of a time without zone since 1970-01-01 00:00:00."""
    days = F.date_diff(time.cast("date"), F.lit(_EPOCH).cast("date")).cast("bigint")
    minutes = (days * 24 + F.hour(time)) * 60 + F.minute(time)
    second = F.extract(F.lit("SECOND"), time)
    return minutes * 60_000_000 + (second * 1_000_000).cast("bigint")


def seconds_between(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(1e6)
