import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from evalflow.llm import sharding as S


def by_shard(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["shard"]].append(r)
    return out


@pytest.fixture(scope="module")
def documents(spark):
    # A third of the rows are equal texts; sizes differ widely.
    return spark.range(9000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.lit("the same text")).otherwise(F.repeat(F.lit("ä"), (F.pmod(F.xxhash64("id"), F.lit(200))).cast("int"))).alias("text"),
        F.lit("old").alias("slot"), F.lit(1).alias("key"), F.lit(2).alias("piece"), F.lit(3).alias("first"),
    ).cache()


@pytest.mark.parametrize("shards,piece_rows", [(1, 10**6), (7, 10**6), (40, 50)])
def test_bytes_are_near_equal_and_slots_gapless(documents, shards, piece_rows):
    done = S.shard(documents, shards, piece_rows=piece_rows)
    rows = done.withColumn("size", S.byte_size()).collect()
    groups = by_shard(rows)
    assert set(groups) == set(range(shards)) and len(rows) == documents.count()
    mean = sum(r["size"] for r in rows) / shards
    for g in groups.values():
        assert sorted(r["slot"] for r in g) == list(range(len(g)))
        assert sum(r["size"] for r in g) == pytest.approx(mean, rel=0.03)
    assert set(documents.columns) - {"slot"} <= set(done.columns)


def test_small_groups_stay_together_and_reruns_agree(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("group "), F.floor(F.col("id") / 4)).alias("text"))
    first = S.shard(rows, 4)
    assert first.groupBy("text").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0
    again = S.shard(rows.repartition(9), 4)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.select(*first.columns).collect()))


def test_splitters_meet_the_tolerance(spark):
    keys = spark.range(50_000).select((F.col("id") * F.col("id") * 77_777).alias("key"), (F.col("id") % 50 + 1).alias("size"))
    bounds = S.splitters(keys, 8, 0.001)
    rows = keys.collect()
    total = sum(r["size"] for r in rows)
    for j, b in enumerate(bounds, 1):
        assert sum(r["size"] for r in rows if r["key"] < b) == pytest.approx(total * j / 8, abs=total / 8 * 0.01)
    assert bounds == sorted(bounds)


def test_awkward_tables(awkward, no_documents):
    done = S.shard(awkward, 3)
    assert done.columns == [c for c in awkward.columns if c != "shard"] + ["shard", "slot"]
    for g in by_shard(done.collect()).values():
        assert sorted(r["slot"] for r in g) == list(range(len(g)))
    assert done.count() == awkward.count() and S.shard(no_documents).count() == 0


def test_size_and_checksum(spark):
    row = spark.createDataFrame([("ä1",), (None,)], "text string").select(S.byte_size().alias("n"), F.crc32(F.coalesce("text", F.lit(""))).alias("c")).collect()
    assert [tuple(r) for r in row] == [(19, zlib.crc32("ä1".encode())), (16, 0)]


def test_repeated_rows_keep_the_law(spark):
    """Rows of one id and text that are most of the table are spread; slots stay gapless, extra columns come back."""
    rows = [(7, "the same row", 1)] * 300 + [(k, f"row number {k:03}", 2) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, number int").repartition(5)
    groups = by_shard(S.shard(docs, 4).collect())
    assert sorted(len(g) for g in groups.values()) == [100] * 4 or max(map(len, groups.values())) <= 103
    assert sum(len(g) for g in groups.values()) == 400 and sum(r["number"] for g in groups.values() for r in g) == 500
    for g in groups.values():
        assert sorted(r["slot"] for r in g) == list(range(len(g)))
