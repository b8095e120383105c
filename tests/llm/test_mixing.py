from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from evalflow.llm import mixing as M


def reshared(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """The contract, step by step: share by weight, stop full sources, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, rest = {s: 0.0 for s in names}, set(names), share * sum(sizes.values())
    while rest > 1e-9 and free:
        total = sum(weight[s] for s in free)
        for s in list(free):
            target[s] += rest * weight[s] / total
        rest = sum(max(0.0, target[s] - most * sizes[s]) for s in free)
        for s in list(free):
            if target[s] >= most * sizes[s]:
                target[s] = most * sizes[s]
                free.discard(s)
    return target


@pytest.fixture(scope="module")
def documents(spark):
    # A source that holds a third of all rows, and one without a name.
    return spark.range(6000).select(
        F.col("id").alias("doc_id"),
        F.repeat(F.lit("word "), (F.pmod(F.xxhash64("id"), F.lit(90)) + 1).cast("int")).alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"),
        F.lit(1).alias("size"), F.lit("x").alias("rank"), F.lit("y").alias("copies"), F.lit(2).alias("target"),
    ).cache()


def test_targets_and_taken_words(documents):
    rows = M.mix(documents).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
        assert 0 <= r["copies"] <= 2 and r["source_size"] > 0
    assert len(rows) == documents.count()
    want = reshared(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s], rel=1e-9) and taken[s] == pytest.approx(target[s], rel=0.01)
        assert abs(taken[s] - target[s]) <= 45


def test_reruns_agree_and_seeds_differ(documents):
    first, again, other = (sorted(map(tuple, M.mix(documents.repartition(n), seed=s).select("doc_id", "copies").collect())) for n, s in ((3, 20), (7, 20), (3, 21)))
    assert first == again and first != other


def test_inclusion_follows_the_probability(documents):
    """Over seeds, a document is drawn as often as the rest of its target asks."""
    rows = documents.where("source = 'hot'").limit(400)
    rows = rows.unionByName(documents.where("source = 's1'").limit(100))
    drawn = defaultdict(int)
    share = None
    for seed in range(8):
        for r in M.mix(rows, weights=(1, 3), share=0.6, seed=seed).where("source = 'hot'").collect():
            drawn[r["doc_id"]] += r["copies"]
            share = r["target"] / r["source_size"]
    assert sum(drawn.values()) / (8 * len(drawn)) == pytest.approx(share, abs=0.08)
    assert max(drawn.values()) <= 8 and len({n for n in drawn.values()}) > 2


@pytest.mark.parametrize("long,share", [(250, 0.2), (110, 0.25)])
def test_a_long_document_does_not_end_a_source(spark, long, share):
    """Half or 30 % of a source in one document among short ones: these fill what it cannot."""
    rows = spark.range(24 * 101).where("id % 101 <= 70 + floor(id / 101)").select(
        F.col("id").alias("doc_id"),
        F.repeat(F.lit("w "), F.when(F.col("id") % 101 == 0, long).otherwise(F.col("id") % 5 + 1).cast("int")).alias("text"),
        F.concat(F.lit("s"), F.floor(F.col("id") / 101)).alias("source"),
    )
    taken, target = defaultdict(int), {}
    for r in M.mix(rows, weights=(1,), share=share).collect():
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
    assert len(target) == 24 and all(abs(taken[s] - target[s]) <= 5 for s in target)


def test_equal_rows_close_a_gap_one_by_one(spark):
    rows = spark.createDataFrame([(1, "a a a a a", "x")] * 6, "doc_id long, text string, source string")
    assert sum(r["copies"] for r in M.mix(rows, weights=(1,), share=0.3).collect()) == 2


def test_documents_of_the_mix(documents):
    mixed = M.mixed_documents(documents)
    assert mixed.columns == documents.columns
    words = mixed.select(F.sum(M.word_count(F.col("text")))).first()[0]
    taken = M.mix(documents).select(F.sum(F.col("copies") * F.col("size"))).first()[0]
    assert words == taken


def test_awkward_tables(awkward, no_documents):
    rows = M.mix(awkward).collect()
    assert len(rows) == awkward.count() and all(r["copies"] * r["size"] <= 2 * r["size"] for r in rows)
    assert M.mixed_documents(awkward).columns == awkward.columns
    assert M.mix(no_documents).count() == 0 and M.mixed_documents(no_documents).count() == 0


def test_all_texts_empty(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id long, text string, source string")
    assert [(r["target"], r["copies"]) for r in M.mix(rows).collect()] == [(0.0, 0), (0.0, 0)]


@pytest.mark.parametrize("sources", [1, 2, 3, 6, 9, 14])
def test_targets_of_equal_sources(spark, sources):
    sizes = {f"s{k:02}": 100 for k in range(sources)}
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in M.targets(rows).collect()}
    assert got == pytest.approx(reshared(sizes)) and sum(got.values()) == pytest.approx(min(150 * sources, 200 * sources))


def test_targets_of_partly_equal_sources(spark):
    sizes = {"a": 100, "b": 100, "c": 50, "d": 100, "e": 100, "f": 1000, "g": 300, None: 100}
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in M.targets(rows).collect()}
    assert got == pytest.approx(reshared(sizes)) and min(got.values()) >= 0


@pytest.mark.parametrize("rows", [100, 7])
def test_repeated_rows_come_as_often_as_they_are_taken(spark, rows):
    docs = spark.createDataFrame([(5, "two words", "s", 1)] * rows + [(6, "three more words", "s", 2)], "doc_id long, text string, source string, t_no int")
    taken = M.mix(docs, share=1.25).agg(F.sum(F.col("copies") * F.col("size"))).first()[0]
    mixed = M.mixed_documents(docs, share=1.25)
    assert mixed.columns == docs.columns
    words = mixed.agg(F.sum(F.size(F.split("text", " ")))).first()[0]
    assert words == taken and abs(taken - 1.25 * (2 * rows + 3)) <= 3
