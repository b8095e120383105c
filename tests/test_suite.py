"""Every registered query against its SQL counterpart on the smallest scale factor."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from evalflow.staging import stage_path
from suite import stream_queries
from suite.check import compare

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(entry_points.queries()))
def test_query(spark, name):
    ok, note = compare(spark, SF_DIR, entry_points.queries()[name], entry_points.oracle_sql().get(name))
    assert ok, note


def test_the_comparison_notices_differences(spark):
    sql = entry_points.oracle_sql()["extract_sql"]
    ok, _ = compare(spark, SF_DIR, entry_points.queries()["extract_sql"], sql.replace("AS gen_sql", "|| ' ' AS gen_sql"))
    assert not ok


def test_stream_slices_are_cut_by_many_tasks(spark):
    """Every slice is one micro-batch, in the order of time, and its files come from all tasks that derive the calls."""
    seen = {}

    def run(calls):
        def step(batch, batch_id):
            read = batch.select("ts", F.input_file_name().alias("file"))
            seen[batch_id] = tuple(read.agg(F.count_distinct("file"), F.min("ts"), F.max("ts")).first())

        calls.writeStream.foreachBatch(step).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    state, key = stage_path(spark, "state"), "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        stream_queries._in_slices(spark, SF_DIR, run)
    finally:
        spark.conf.set(key, before)
    assert sorted(seen) == [0, 1, 2, 3]
    assert all(files > 1 for files, _, _ in seen.values())
    assert all(seen[k][2] < seen[k + 1][1] for k in range(3))
