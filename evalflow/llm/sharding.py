"""Sharding by histogram sort: exact byte counts below candidate boundaries, refined until the splitters fit.

Rows are ordered by a 64-bit key whose upper 36 bits come from the text and whose lower 28 bits come from
the document id: equal texts are neighbours. A splitter stays between groups of equal texts if it can come
near enough to its target there, and otherwise cuts the group.
Each round counts the exact bytes of the cells around every splitter that is not yet near enough, in finer cells
than the round before; a round moves at most (splitters x 4096) sums to the driver, whatever the number of
rows. Shards of many rows are cut into pieces, whose borders may be rough, so that no task numbers a whole shard.
Rows cross the network once, to their piece.

Where rows that repeat id and text weigh more than a splitter may be off, all rows get a number of their own, which
replaces the id in the key; the numbered rows are written first, so that every pass sees the same numbers.

Defined results: rows of equal text and id stay together unless there are too many. A NULL text has no bytes.
A NULL id is an id like any other. An empty table gives an empty result. All columns are kept, whatever
their names, except `shard` and `slot`, which are replaced.
"""

from __future__ import annotations

import bisect
import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalflow.llm.common import fresh, table
from evalflow.staging import stage

SHARDS = 40
#: Distance of a splitter from its target, as a share of a shard's bytes.
TOLERANCE = 0.002
#: Rows that one window numbers at most, about; larger shards are numbered in several pieces.
PIECE_ROWS = 500_000
ROW_BYTES = 16
#: The same for a splitter between two groups of equal texts; beyond it the group is cut.
GROUP_TOLERANCE = 0.01

_BITS = 12
_GROUP_BITS = 28
_TOP = 64 - _BITS


def sort_key(text: str = "text", doc_id: str = "doc_id") -> Column:
    group = F.shiftleft(F.shiftright(F.xxhash64(F.col(text)), _GROUP_BITS), _GROUP_BITS)
    return group.bitwiseOR(F.xxhash64(F.lit(1), F.col(doc_id)).bitwiseAND(F.lit((1 << _GROUP_BITS) - 1)))


def byte_size(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + ROW_BYTES).cast("bigint")


def splitters(keys: DataFrame, parts: int, tolerance: float = TOLERANCE, cells_each: int = 1 << _BITS) -> list[int]:
    """Boundaries b_1 <= ... <= b_(parts - 1) on `key` that leave equal sums of `size` between them.

    ``keys`` has the columns key and size and is read once per round; a round has about ``cells_each`` cells for
    each boundary.
    """
    total = keys.agg(F.sum("size")).first()[0]
    if not total or parts < 2:
        return []
    near, whole = (total / parts * t for t in (tolerance, max(tolerance, GROUP_TOLERANCE)))
    targets = [total * j / parts for j in range(1, parts)]
    found: dict[int, int] = {}
    # For each open splitter: the cell of the last round it lies in, and the bytes below that cell.
    open_in: dict[int, tuple[int | None, int]] = {j: (None, 0) for j in range(len(targets))}
    shift = 64
    while open_in:
        parents = len({c for c, _ in open_in.values()})
        finer = max(0, shift - min(_BITS, max(4, math.ceil(math.log2(cells_each * parts / parents)))))
        if finer < _GROUP_BITS < shift:  # a round ends where groups of equal texts begin
            finer = _GROUP_BITS
        rows = keys
        if shift < 64:
            cells = sorted({c for c, _ in open_in.values()})
            rows = keys.where(F.shiftright("key", shift).isin(cells))
        sums = rows.groupBy(F.shiftright("key", finer).alias("cell")).agg(F.sum("size").alias("size")).collect()
        inside: dict[int | None, list[tuple[int, int]]] = {}
        for cell, size in sorted((r["cell"], r["size"]) for r in sums):
            inside.setdefault(None if shift == 64 else cell >> (shift - finer), []).append((cell, size))
        still: dict[int, tuple[int | None, int]] = {}
        for j, (parent, below) in open_in.items():
            for cell, size in inside[parent]:
                if below + size >= targets[j]:
                    break
                below += size
            before, after = targets[j] - below, below + size - targets[j]
            if min(before, after) <= (whole if finer == _GROUP_BITS else near) or finer == 0:
                found[j] = (cell if before <= after else cell + 1) << finer
            else:
                still[j] = (cell, below)
        open_in, shift = still, finer
    bounds = [found[j] for j in range(len(targets))]
    return [max(bounds[: j + 1]) for j in range(len(bounds))]


def _part_of(key: Column, bounds: Sequence[int]) -> Column:
    """Number of boundaries at or below the key: looked up by the key's upper bits, then compared in the cell."""
    bounds = [b for b in bounds if b < 1 << 63]
    base, inner = [], []
    for cell in range(-(1 << (_BITS - 1)), 1 << (_BITS - 1)):
        low, high = (bisect.bisect_left(bounds, c << _TOP) for c in (cell, cell + 1))
        base.append(low)
        inner.append(bounds[low:high])
    at = F.shiftright(key, _TOP) + (1 << (_BITS - 1))
    below = F.from_json(F.lit(json.dumps(base)), "array<int>")
    within = F.from_json(F.lit(json.dumps(inner)), "array<array<bigint>>")
    return F.get(below, at) + F.size(F.filter(F.get(within, at), lambda b: b <= key))


def shard(
    docs: DataFrame,
    shards: int = SHARDS,
    key: Column | None = None,
    size: Column | None = None,
    tolerance: float = TOLERANCE,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Add `shard` (0 to shards - 1, near equal sums of size) and `slot` (position in the shard from 0)."""
    docs = docs.drop("shard", "slot")
    kept = docs.columns
    key = sort_key() if key is None else key
    size = byte_size() if size is None else size
    keys = stage(docs.select(key.alias("key"), size.alias("size")), "shard-keys")
    whole = keys.agg(F.sum("size")).first()[0] or 0
    repeated = keys.groupBy("key").agg(F.sum("size").alias("size"), F.count("*").alias("n")).where("n > 1")
    if not repeated.where(F.col("size") > tolerance * whole / shards).isEmpty():
        number = fresh(docs, "number")
        docs = stage(docs.withColumn(number, F.monotonically_increasing_id()), "shard-numbered")
        low = F.lit((1 << _GROUP_BITS) - 1)
        key = key.bitwiseAND(F.lit(-1 << _GROUP_BITS)).bitwiseOR(F.xxhash64(key, number).bitwiseAND(low))
        keys = stage(docs.select(key.alias("key"), size.alias("size")), "shard-keys")
    pieces = max(1, -(-keys.count() // (shards * piece_rows)))
    of_shards = splitters(keys, shards, tolerance)
    bounds = of_shards if pieces == 1 else sorted({*of_shards, *splitters(keys, shards * pieces, 0.5, 16)})
    k, piece, first = (fresh(docs, c) for c in ("key", "piece", "first"))
    # The exact rows of every piece, from the narrow table: one row per piece.
    counts = keys.groupBy(
        _part_of(F.col("key"), bounds).alias("piece"), _part_of(F.col("key"), of_shards).alias("shard")
    ).count()
    starts = counts.select(
        F.col("piece").alias(f"{piece}_of"),
        (F.sum("count").over(W.partitionBy("shard").orderBy("piece")) - F.col("count")).alias(first),
    )
    dealt = docs.withColumn(k, key).withColumn(piece, _part_of(F.col(k), bounds))
    # Rows of equal key and id may still differ; the order among them is that of their other plain columns.
    ties = [c for c, kind in docs.dtypes if kind in ("bigint", "int", "string")]
    numbered = dealt.withColumn("slot", F.row_number().over(W.partitionBy(piece).orderBy(k, *ties)))
    return numbered.join(starts, F.col(piece) == F.col(f"{piece}_of"), "left").select(
        *kept,
        _part_of(F.col(k), of_shards).cast("int").alias("shard"),
        (F.col("slot") - 1 + F.coalesce(F.col(first), F.lit(0))).cast("bigint").alias("slot"),
    )


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        byte_size().alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        sort_key().alias("sort_key"),
    )
    return shard(rows, key=F.col("sort_key"), size=F.col("size")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
