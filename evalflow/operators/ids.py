"""Row positions and running values over a global or per-group order.

A window over a large group puts the whole group into one task. These operators range-partition
by (group, order) instead, which also splits a group that holds most of the rows, compute inside
the partitions, and shift by the totals of the partitions before. The order must be total (add a
unique column), so that equal keys can be split too.

The rows are written once in between; select the columns that are needed first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalflow.staging import stage_dealt

_PART, _SEQ = "_part", "_seq"


def _ranged(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], partitions: int | None) -> DataFrame:
    """Staged copy of ``df``, range-partitioned and sorted, with its partition and row number.

    This is the one exchange of the rows: the copy is dealt by partition, so windows over it are computed where it is read.
    """
    keys = [*group, *order]
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    numbered = ranged.sortWithinPartitions(*keys).withColumn("_mid", F.monotonically_increasing_id())
    # monotonically_increasing_id holds the partition in its upper and the row in its lower 33 bits.
    numbered = numbered.withColumns(
        {
            _PART: F.shiftright("_mid", 33).cast("int"),
            _SEQ: F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)),
        }
    ).drop("_mid")
    buckets = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage_dealt(numbered, "ranged", _PART, max(1, buckets))


def _group_window(group: Sequence[str]):
    return W.partitionBy(*group) if group else W.partitionBy(F.lit(0))


def positions(
    df: DataFrame,
    order: Sequence[Column | str],
    group: Sequence[str] = (),
    name: str = "position",
    partitions: int | None = None,
) -> DataFrame:
    """Add the zero-based position of each row in the order (inside its group)."""
    counted = running_values(df, order, {"_count": ("sum", F.lit(1).cast("bigint"))}, group, partitions)
    return counted.select(*df.columns, (F.col("_count") - 1).alias(name))


def running_values(
    df: DataFrame,
    order: Sequence[Column | str],
    values: Mapping[str, tuple[str, Column]],
    group: Sequence[str] = (),
    partitions: int | None = None,
) -> DataFrame:
    """Add running sums or maxima from the start of the group up to and including the row.

    ``values`` maps a new column to ``("sum" | "max", expression)``. A group goes on in a partition only where it has the
    partition's first row, so what came before is one row per partition at most, whatever the number of groups.
    """
    merge = {"sum": F.sum, "max": F.max}
    inputs = {f"_in_{name}": expr for name, (_, expr) in values.items()}
    ranged = _ranged(df.withColumns(inputs), group, order, partitions)
    totals = ranged.groupBy(*group, _PART).agg(
        F.min(_SEQ).alias("_first"),
        F.max(_SEQ).alias("_last"),
        *[merge[kind](f"_in_{name}").alias(f"_tot_{name}") for name, (kind, _) in values.items()],
    )
    # Groups that have the first or the last row of a partition; no other one can be in two.
    ends = totals.withColumn("_end", F.max("_last").over(W.partitionBy(_PART))).where("_first = 0 or _last = _end")
    before = _group_window(group).orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)
    shifts = ends.select(
        *[F.col(g).alias(f"_r_{g}") for g in group],
        F.col(_PART).alias("_r_part"),
        F.count("*").over(before).alias("_earlier"),
        *[merge[kind](f"_tot_{name}").over(before).alias(f"_before_{name}") for name, (kind, _) in values.items()],
    ).where("_earlier > 0")
    inside = W.partitionBy(*group, _PART).orderBy(_SEQ).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = ranged.withColumns(
        {f"_run_{name}": merge[kind](f"_in_{name}").over(inside) for name, (kind, _) in values.items()}
    )
    # A NULL group is a group.
    same = [F.col(g).eqNullSafe(F.col(f"_r_{g}")) for g in group]
    joined = rows.join(F.broadcast(shifts), reduce(and_, same, F.col(_PART) == F.col("_r_part")), "left")

    def total(name: str, kind: str) -> Column:
        here, earlier = F.col(f"_run_{name}"), F.col(f"_before_{name}")
        if kind == "max":
            return F.greatest(here, earlier)
        return F.when(here.isNotNull() | earlier.isNotNull(), F.coalesce(here, F.lit(0)) + F.coalesce(earlier, F.lit(0)))

    return joined.select(*df.columns, *[total(name, kind).alias(name) for name, (kind, _) in values.items()])


def assign_task_ids(
    df: DataFrame, order: Sequence[Column | str], name: str = "task_id", start: int = 0, partitions: int | None = None
) -> DataFrame:
    """Dense ids 0, 1, 2, ... in the given total order."""
    numbered = positions(df, order, name="_position", partitions=partitions)
    return numbered.select((F.col("_position") + start).alias(name), *df.columns)


def keyed_task_ids(df: DataFrame, key: Sequence[str], name: str = "task_id") -> DataFrame:
    """Repeatable ids from a hash of the row's key, in place of random ones."""
    return df.withColumn(name, F.sha2(F.to_json(F.struct(*key)), 256))


def limit_rows(df: DataFrame, n: int, order: Sequence[Column | str]) -> DataFrame:
    """The first ``n`` rows in the order; no task holds all of them."""
    return limit_per_group(df, n, order, [])


def limit_per_group(df: DataFrame, n: int, order: Sequence[Column | str], group: Sequence[str] = ("split",)) -> DataFrame:
    """The first ``n`` rows of every group: those up to the group's n-th key.

    Keys alone are dealt by range and numbered, in as many tasks as a group needs; the rows themselves are only filtered.
    A group with fewer rows has no such key. The order must be total and ascending.
    """
    names = [f"_k{i}" for i in range(len(order))]
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    slim = df.select(*group, *[k.alias(name) for k, name in zip(keys, names, strict=True)])
    numbered = positions(slim, names, group, "_rank").where(F.col("_rank") == n - 1)
    last = numbered.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.struct(*names).alias("_limit"))
    key = F.struct(*[k.alias(name) for k, name in zip(keys, names, strict=True)])
    if n < 1:
        return df.limit(0)
    if not group:
        found = last.first()
        if found is None:
            return df
        limit = F.struct(*[F.lit(v).cast(t).alias(c) for c, v, (_, t) in zip(names, found["_limit"], slim.dtypes, strict=True)])
        return df.where(key <= limit)
    same = reduce(and_, [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group])
    return df.join(last, same, "left").where(F.col("_limit").isNull() | (key <= F.col("_limit"))).select(*df.columns)


def batch_numbers(
    df: DataFrame, batch_size: int, total: int | None = None, id_column: str = "task_id", name: str = "batch_no"
) -> DataFrame:
    """Batch number of each request by its dense id; the size is kept within 5..100 and the total."""
    size = min(max(5, batch_size), 100)
    if total is not None:
        size = max(1, min(size, total))
    return df.withColumn(name, F.floor(F.col(id_column) / size))
