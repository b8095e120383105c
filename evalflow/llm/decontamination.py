"""Benchmark decontamination by SimHash over item-sized windows, verified by exact shingle similarity.

Words are runs of letters and digits in lower case; a shingle is five words (all words of a shorter item).

1. Windows. An item with m shingles is similar to a window only if the window lacks fewer than a known number of
   them, so any MISSING share of the item's shingles plus one hits every similar window. Those shingles, the seeds,
   are looked up in the documents by a join, and every hit places a window of the item's length so that the seed
   stands where the item has it. Windows with the same words are one content, however many documents hold it.
2. Fingerprints. 64-bit SimHash of the shingles of each content and each item, every shingle weighing as
   often as it occurs.
3. Multi-index. Fingerprints are cut into four blocks of 16 bits. Two fingerprints within RADIUS bits agree in
   one of the blocks up to RADIUS // 4 bits, so items are entered under all block values that near to theirs, and
   an equality join over blocks finds every pair within the radius.
4. Verification. Pairs are kept if the weighted Jaccard similarity of their shingles (sum of minima over sum of
   maxima) is SIMILARITY or more, computed exactly.

All steps are DataFrame operations. The benchmark is looked up by joins; Spark broadcasts its seeds if they are small.

Defined results: NULL and empty texts or items match nothing. Rows with equal id and text are one document. A
NULL id is an id, of a document and of an item. Items are told apart by their words: those with equal words are all reported, and
an item id with several texts is reported once for a document, with the best window of any of them. Empty tables give an empty result. Extra columns of either
table do not matter.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalflow.llm.common import table
from evalflow.staging import stage

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 15
_BLOCKS, _WIDTH = 4, 16


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def shingles(of: Column, first: Column, last: Column, size: Column) -> Column:
    """Hashes of the shingles that begin at the word positions first to last."""
    return F.when(
        last >= first, F.transform(F.sequence(first, last), lambda i: F.xxhash64(F.slice(of, i + 1, size)))
    ).otherwise(F.array().cast("array<bigint>"))


def fingerprints(sets: DataFrame, key: list[str]) -> DataFrame:
    """The key and `fingerprint`, the SimHash of the array `shingles`."""
    bits = sets.select(*key, F.explode("shingles").alias("h"))
    votes = bits.groupBy(*key).agg(
        *[F.sum(F.shiftright("h", b).bitwiseAND(F.lit(1)) * 2 - 1).alias(f"b{b}") for b in range(64)]
    )
    total = F.lit(0).cast("bigint")
    for b in range(64):
        total = total.bitwiseOR(F.when(F.col(f"b{b}") > 0, F.shiftleft(F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint")))
    return votes.select(*key, total.alias("fingerprint"))


def _block(fingerprint: Column, k: int) -> Column:
    return F.shiftrightunsigned(fingerprint, k * _WIDTH).bitwiseAND(F.lit((1 << _WIDTH) - 1)).cast("int")


def _masks(radius: int) -> Column:
    flips = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(_WIDTH), r)]
    return F.from_json(F.lit(str(flips)), "array<int>")


def within_radius(contents: DataFrame, items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All pairs of rows whose fingerprints differ in at most ``radius`` bits: the columns of both sides."""
    entered = items.select("*", F.explode(_masks(radius // _BLOCKS)).alias("mask")).select(
        *items.columns,
        F.posexplode(F.array(*[_block(F.col("fingerprint"), k).bitwiseXOR(F.col("mask")) for k in range(_BLOCKS)])).alias("block", "value"),
    )
    asked = contents.select(
        *contents.columns, F.posexplode(F.array(*[_block(F.col("fingerprint"), k) for k in range(_BLOCKS)])).alias("block", "value")
    )
    # The entries are some 2800 times the items, which Spark's estimate does not see: never broadcast them.
    a, b = asked.alias("a"), entered.hint("merge").alias("b")
    near = F.bit_count(F.col("a.fingerprint").bitwiseXOR(F.col("b.fingerprint"))) <= radius
    met = a.join(b, (F.col("a.block") == F.col("b.block")) & (F.col("a.value") == F.col("b.value")) & near)
    return met.select(
        *[F.col(f"a.{c}") for c in contents.columns if c != "fingerprint"],
        *[F.col(f"b.{c}") for c in items.columns if c != "fingerprint"],
    ).distinct()


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two arrays as bags."""
    def times(of: Column, x: Column) -> Column:
        return F.size(F.filter(of, lambda y: y == x))

    common = F.aggregate(F.array_distinct(a), F.lit(0), lambda total, x: total + F.least(times(a, x), times(b, x)))
    return common / (F.size(a) + F.size(b) - common)


def prepared_items(benchmark: DataFrame) -> DataFrame:
    """`item_id`, `length` in words, shingle `size`, `shingles` and their hashes `i1` and `i2` of every item with words."""
    found = benchmark.select("item_id", words(F.col("text")).alias("words")).withColumn("length", F.size("words"))
    found = found.where("length > 0").withColumn("size", F.least("length", F.lit(SHINGLE)))
    cut = shingles(F.col("words"), F.lit(0), F.col("length") - F.col("size"), F.col("size"))
    found = found.select("item_id", "length", "size", cut.alias("shingles"))
    return stage(found.select("*", *_content("i1", "i2")), "benchmark-items")


def _content(first: str, second: str) -> list[Column]:
    """The two hashes that stand for a list of shingles."""
    return [F.xxhash64("size", "shingles").alias(first), F.xxhash64(F.lit(1), "size", "shingles").alias(second)]


def leaks(
    docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, radius: int = RADIUS
) -> DataFrame:
    """`doc_id`, `text_key`, `item_id`, `start` (word) and `similarity` of the best window, for each pair found."""
    items = prepared_items(benchmark)
    # A similar window lacks at most (1 - least) * m of the item's m shingles, also if it is cut short by the text.
    lacking = F.floor(F.size("shingles") * (1 - least) + F.lit(1e-9)).cast("int")
    seeds = items.select("length", "size", "shingles", F.posexplode("shingles").alias("place", "shingle"))
    # The seeds of an item: its shingles of smallest hash, lacking + 1 of them; the same for items with equal words.
    seeds = seeds.where(F.array_position(F.array_sort("shingles"), F.col("shingle")) <= lacking + 1)
    seeds = stage(seeds.select("length", "size", "place", "shingle").distinct(), "benchmark-seeds")

    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("words"))
    hits = None
    for size in sorted(r["size"] for r in items.select("size").distinct().collect()):  # 1 to SHINGLE
        cut = shingles(F.col("words"), F.lit(0), F.size("words") - size, F.lit(size))
        of_size = seeds.where(F.col("size") == size)
        found = keyed.select("doc_id", "text_key", F.size("words").alias("n"), F.posexplode(cut).alias("at", "h"))
        found = found.join(of_size, F.col("h") == F.col("shingle")).select("doc_id", "text_key", "n", "length", "size", "at", "place")
        hits = found if hits is None else hits.unionByName(found)
    kind = "doc_id long, text_key long, item_id long, start int, similarity double"
    if hits is None:
        return docs.sparkSession.createDataFrame([], kind)
    last = F.greatest(F.col("n") - F.col("length"), F.lit(0))
    placed = hits.select("doc_id", "text_key", "length", "size", F.least(F.greatest(F.col("at") - F.col("place"), F.lit(0)), last).alias("start"))
    placed = stage(
        placed.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("length", "size", "start")).alias("windows")),
        "benchmark-windows",
    )

    w = placed.select(F.col("doc_id").alias("w_id"), F.col("text_key").alias("w_key"), "windows")
    holding = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").join(
        w, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("text_key") == F.col("w_key"))
    )
    windows = holding.select("doc_id", "text_key", words(F.col("text")).alias("words"), F.explode("windows").alias("w"))
    end = F.least(F.col("w.start") + F.col("w.length"), F.size("words")) - F.col("w.size")
    windows = windows.select(
        "doc_id", "text_key", "w.start", "w.size", shingles(F.col("words"), F.col("w.start"), end, F.col("w.size")).alias("shingles")
    ).distinct()
    windows = stage(windows.select("*", *_content("c1", "c2")), "benchmark-contents")
    contents = windows.groupBy("c1", "c2").agg(F.first("size").alias("c_size"), F.first("shingles").alias("c_shingles"))

    prints = fingerprints(contents.withColumnRenamed("c_shingles", "shingles"), ["c1", "c2", "c_size"])
    # One row per text of an item, whatever ids it has; the ids come back at the end.
    distinct = items.groupBy("i1", "i2").agg(F.first("size").alias("size"), F.first("shingles").alias("shingles"))
    item_prints = stage(fingerprints(distinct, ["i1", "i2", "size"]), "benchmark-fingerprints")
    near = within_radius(prints, item_prints, radius).where("c_size = size").select("c1", "c2", "i1", "i2")
    judged = (
        near.join(contents, ["c1", "c2"])
        .join(distinct.select("i1", "i2", "shingles"), ["i1", "i2"])
        .withColumn("similarity", similarity(F.col("c_shingles"), F.col("shingles")))
        .where(F.col("similarity") >= least)
        .join(items.select("i1", "i2", "item_id").distinct(), ["i1", "i2"])
        .select("c1", "c2", "item_id", "similarity")
    )
    best = F.min(F.struct(-F.col("similarity"), "start")).alias("best")
    found = windows.select("doc_id", "text_key", "start", "c1", "c2").join(judged, ["c1", "c2"])
    return found.groupBy("doc_id", "text_key", "item_id").agg(best).select(
        "doc_id", "text_key", "item_id", F.col("best.start").alias("start"), (-F.col("best.col1")).alias("similarity")
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a benchmark item, with all their columns."""
    found = leaks(docs, benchmark, **options).select(
        F.col("doc_id").alias("leak_id"), F.col("text_key").alias("leak_key")
    ).distinct()
    return docs.join(
        found, F.col("doc_id").eqNullSafe(F.col("leak_id")) & (F.xxhash64("text") == F.col("leak_key")), "left_anti"
    )


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, with the item and the place."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")
