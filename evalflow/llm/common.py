"""What several operators of this package need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that part words in the word-based operators (the bytes `bytes.split()` parts at).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the input does not have, for helper columns beside whatever columns come in."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def uniform(*values: Column | str, seed: int = 0) -> Column:
    """A repeatable number in (0, 1) from the values."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *values), 11) + 0.5) / float(1 << 53)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")
