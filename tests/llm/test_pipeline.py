"""Every stage of the pipeline on the smallest tables, against brute force over what the stage before kept."""

import os

import pytest

import corpus_pipeline
from evalflow.staging import stage

from .test_decontamination import brute as brute_leaks
from .test_jaccard import brute as brute_components

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, before = docs.columns, docs
    kept = {}
    for name, step in corpus_pipeline.STAGES:
        kept[name] = (before, after := stage(step(spark, before, SF_DIR), "pipeline-test"))
        assert after.columns == columns + ["shard", "slot"] * (name == "sharding")
        before = after

    def texts(df):
        return [tuple(r) for r in df.select("doc_id", "text").collect()]

    before, after = map(texts, kept["toxicity"])
    assert set(after) <= set(before) and len(after) > 0.7 * len(before)

    before, after = map(texts, kept["near_duplicates"])
    components = brute_components(before, 5, 80)
    assert sorted(i for i, _ in after) == sorted({c for _, c in components.values()})

    before, after = map(texts, kept["decontamination"])
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    assert {i for i, _ in before} - {i for i, _ in after} == {i for i, _ in brute_leaks(before, items)}

    before, after = map(texts, kept["mixing"])
    sizes = [sum(len((t or "").split()) for _, t in rows) for rows in (before, after)]
    assert set(after) <= set(before) and sizes[1] == pytest.approx(1.5 * sizes[0], rel=0.1)
    assert max(after.count(x) for x in set(after)) <= 2

    before, after = kept["sharding"]
    assert before.count() == after.count() and sorted(texts(before), key=str) == sorted(texts(after), key=str)


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF_DIR).columns[-2:] == ["shard", "slot"]
