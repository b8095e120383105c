"""Mixing sources to target weights by Pareto order sampling.

Every document of a source should be taken target / size times. The whole copies in that number are
certain. For the rest, a document with inclusion probability p gets the rank (U / (1 - U)) / (p / (1 - p)),
U being a repeatable number from its id and text, and documents are taken in rank order until the words that are
left of the target are filled: a sample of fixed size. Documents larger than what is left are left out from the start.
Where one stops the draw, a further round goes on down the ranks with the unused documents of at most half the
gap, so every round at least halves the gap or uses up those documents. Then the unused document nearest to the gap in
size closes it, if that comes nearer to the target. Ranks are summed by range partitions (`running_values`), so a source with
most of the rows is no single task.

Defined results: a NULL source is a source, the last one. NULL and empty texts have size 0 and take nothing.
Rows that agree in all columns are drawn one by one. An empty table gives an empty result. Helper columns
get names that the input does not have.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalflow.llm.common import fresh, table, uniform, word_count
from evalflow.operators.ids import positions, running_values
from evalflow.staging import stage

#: Weights of the sources in their order, repeated as often as needed.
WEIGHTS = (3, 1, 2)
#: Size of the mix, as a share of all words.
SHARE = 1.5
#: Most copies of a document.
MOST = 2
SEED = 20


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """`source`, `source_size`, `target`: shares by weight, none above ``most`` times its source.

    A source is full when the level (target per weight) reaches its own limit per weight. In the order of
    those limits the level follows from running sums, so no loop is needed. ``sizes`` has the columns source
    and size, one row per document; the windows see one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighted = totals.withColumn("weight", F.get(cycle, (F.row_number().over(by_name) - 1) % len(weights)))
    weighted = weighted.withColumn("limit", F.col("source_size") * float(most))
    by_limit = W.partitionBy(F.lit(0)).orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    full = F.coalesce(F.sum("limit").over(by_limit.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_limit.rowsBetween(0, W.unboundedFollowing))
    everything = W.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.col("full")) / F.col("rest")
    levels = weighted.withColumns({"full": full, "rest": rest}).withColumn("level", level)
    # The first source, in the order of the limits, that does not get full: of sources with equal limits per weight, only the
    # level of the first one counts none of them as full.
    ratio = F.col("limit") / F.col("weight")
    first = F.struct(ratio, F.col("source").isNull(), "source", "level")
    found = F.min(F.when(F.col("level") < ratio, first)).over(everything)["level"]
    return levels.select(
        "source",
        "source_size",
        F.least(F.coalesce(found * F.col("weight"), F.col("limit")), F.col("limit")).alias("target"),
    )


def mix(
    docs: DataFrame,
    size: Column | None = None,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    seed: int = SEED,
) -> DataFrame:
    """`doc_id`, `text_key`, `size`, `source_size`, `target` and `copies` for every document.

    ``text_key`` is the 64-bit hash of the text, which tells rows with the same id apart.
    """
    size = word_count(F.col("text")) if size is None else size
    slim = stage(
        docs.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("text_key")), "mix-sizes"
    )
    goal = targets(slim.select("source", "size"), weights, share, most).withColumnRenamed("source", "goal_source")
    rows = slim.join(goal, F.col("source").eqNullSafe(F.col("goal_source")), "left").drop("goal_source")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("sure", F.floor(each)).withColumn("p", each - F.col("sure"))
    u = uniform("doc_id", "text_key", seed=seed)
    named = ["doc_id", "source", "size", "text_key", "source_size", "target", "sure"]
    pool = rows.where((F.col("p") > 0) & (F.col("size") > 0)).select(
        *named,
        (u / (1 - u) * (1 - F.col("p")) / F.col("p")).alias("rank"),
        (F.col("target") - F.col("sure") * F.col("source_size")).alias("gap"),
        F.monotonically_increasing_id().alias("row"),  # tells rows apart that agree in all columns
    )
    parts, fits = [], F.col("size") <= F.col("gap")
    while True:
        summed = running_values(pool, ["rank", "doc_id", "text_key"], {"filled": ("sum", F.when(fits, F.col("size")).otherwise(0))}, ["source"])
        drawn = stage(summed.withColumn("drawn", fits & (F.col("filled") <= F.col("gap"))), "mix-ranks")
        gaps = drawn.groupBy("source").agg((F.first("gap") - F.coalesce(F.max(F.when(F.col("drawn"), F.col("filled"))), F.lit(0))).alias("left"))
        gaps = stage(gaps.withColumnRenamed("source", "gap_source"), "mix-gaps")
        judged = drawn.join(gaps, F.col("source").eqNullSafe(F.col("gap_source")))
        open_ = ~F.col("drawn") & (F.col("size") <= 2 * F.col("left"))  # larger ones cannot come nearer to the target
        parts.append(judged.where(~open_).select(*named, F.col("drawn").cast("bigint").alias("more")))
        pool = judged.where(open_).select(*named, "rank", F.col("left").alias("gap"), "row")
        fits = 2 * F.col("size") <= F.col("gap")
        if pool.where(fits).isEmpty():
            break
    last = pool.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")), "rank", "doc_id", "text_key", "row")).alias("best"))
    last = last.select(F.col("source").alias("last_source"), F.col("best.row").alias("last_row"))
    closed = pool.join(last, F.col("source").eqNullSafe(F.col("last_source"))).select(
        *named, (F.col("row") == F.col("last_row")).cast("bigint").alias("more")
    )
    chosen = reduce(DataFrame.unionByName, parts, closed)
    whole = rows.where((F.col("p") <= 0) | (F.col("size") <= 0)).select(
        *named, F.lit(0).cast("bigint").alias("more")
    )
    return chosen.unionByName(whole).select(
        "doc_id", "source", "text_key", "size", "source_size", "target", (F.col("sure") + F.col("more")).alias("copies")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix: a document taken twice comes twice, with all its columns."""
    taken = mix(docs, **options).withColumn("rows", F.lit(1).cast("bigint"))
    # Rows that agree in id and text share one entry: all get the same whole copies, the first ones of them one more.
    taken = taken.groupBy("doc_id", "source", "text_key").agg(F.sum("copies").alias("copies"), F.sum("rows").alias("rows"))
    names = {c: fresh(docs, c) for c in ("t_id", "t_source", "t_key", "t_copies", "t_rows", "t_no", "t_row")}
    entry = taken.select(
        F.col("doc_id").alias(names["t_id"]), F.col("source").alias(names["t_source"]), F.col("text_key").alias(names["t_key"]),
        F.col("copies").alias(names["t_copies"]), F.col("rows").alias(names["t_rows"]),
    )
    same = (
        F.col("doc_id").eqNullSafe(F.col(names["t_id"]))
        & F.col("source").eqNullSafe(F.col(names["t_source"]))
        & (F.xxhash64("text") == F.col(names["t_key"]))
    )
    keyed = docs.join(entry, same)
    copies, rows = F.col(names["t_copies"]), F.col(names["t_rows"])
    alone = keyed.where(copies % rows == 0).withColumn(names["t_no"], F.floor(copies / rows).cast("int"))
    uneven = keyed.where(copies % rows > 0)
    if not uneven.isEmpty():
        group = [names[c] for c in ("t_id", "t_source", "t_key")]
        numbered = positions(uneven.withColumn(names["t_row"], F.monotonically_increasing_id()), [names["t_row"]], group, names["t_no"])
        more = (F.col(names["t_no"]) < copies % rows).cast("int")
        alone = alone.unionByName(numbered.withColumn(names["t_no"], F.floor(copies / rows).cast("int") + more).drop(names["t_row"]))
    several = alone.where(F.col(names["t_no"]) > 0)
    each = F.explode(F.sequence(F.lit(1), F.col(names["t_no"])))
    return several.withColumn(names["t_no"], each).select(*docs.columns)


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )
