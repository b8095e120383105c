import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalflow.llm import jaccard as J

from .conftest import DOCUMENTS, rows_of, words


def brute(rows, size=4, percent=85):
    """Components by comparing every pair; rows of (id, text)."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return {i: (len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)}


def variants(seed, families=25):
    rng = random.Random(seed)
    out = []
    for f in range(families):
        base = words(f"{seed}{f}", rng.randrange(3, 160), 500)
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(9)}"
            out.append(" ".join(copy[: len(copy) - rng.randrange(0, 2)]))
    common = words("common", 25)
    return out + [" ".join(words(f"c{seed}{k}", 15) + common) for k in range(40)]


@pytest.mark.parametrize("size,percent,block", [(4, 85, J.BLOCK_SHINGLES), (4, 85, 200), (5, 80, 400), (2, 50, 300)])
def test_components_equal_brute_force(spark, monkeypatch, size, percent, block):
    monkeypatch.setattr(J, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(J, "HEAVY_FROM", 5)
    rows = list(enumerate(variants(size)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.near_duplicates(df, size, percent).collect()}
    assert got == brute(rows, size, percent)
    assert len({c for _, c in got.values()}) < len(rows)


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80)])
def test_short_sets_link_by_one_shingle(spark, size, percent):
    """Texts around the border of short sets, cut by words at either end, against brute force."""
    rng = random.Random(size)
    texts = []
    for f in range(12):
        base = words(f"short{f}", size + 15, 3000)
        for _ in range(8):
            at = rng.randrange(0, 4)
            texts.append(" ".join(base[at : at + size - 1 + rng.randrange(1, 15)]))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.near_duplicates(df, size, percent).collect()}
    assert got == brute(rows, size, percent) and len({c for _, c in got.values()}) < len(set(texts))


def test_groups_hold_no_short_sets_and_blocks_few_members(spark, monkeypatch):
    """Short texts with a common opening meet in no group; blocks of a large group are bounded by members."""
    seen, plain = [], J._group_pairs

    def spied(classes, percent):
        seen.append(classes.groupBy("group").agg(F.count("*").alias("members"), F.min("n").alias("n")).collect())
        return plain(classes, percent)

    monkeypatch.setattr(J, "_group_pairs", spied)
    monkeypatch.setattr(J, "BLOCK_MEMBERS", 20, raising=False)
    opening = " ".join(words("opening", 24))
    texts = [f"a common opening of t{k}" for k in range(400)] + [f"{opening} e{k}" for k in range(400)]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["component_id"] for r in J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] == (k if k < 400 else 400) for k in got) and len(got) == 800
    assert all(r["n"] > 2 and r["members"] <= 60 for r in seen[0])


def test_a_large_family_is_in_few_groups(spark):
    """Copies of one text, most with more changes than a link allows, are in a few groups."""
    rng = random.Random(8)
    base, texts = words("base", 150), []
    for k in range(400):
        copy = list(base)
        for _ in range(k % 8):
            copy[rng.randrange(len(copy))] = f"own{k}x{rng.randrange(1000)}"
        texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    signed = J.signatures(docs, 4, 85, J.heavy_shingles(docs, 4, 85))
    classes = signed.select("set_id", "n", "prefix", F.col("head").alias("group")).dropDuplicates(["set_id"])
    groups = classes.select("group").distinct().count()
    plain = signed.select(F.array_min("prefix").alias("head")).distinct().count()
    assert groups < 20 < plain and J._group_pairs(classes, 85).count() <= groups * groups
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_every_order_keeps_all_links(spark):
    """Prefixes share what linked sets must share, whatever shingles count as heavy."""
    rng = np.random.default_rng(4)
    for _ in range(200):
        a = np.unique(rng.integers(0, 60, 40).astype(np.uint64))
        b = np.unique(np.concatenate([rng.choice(a, len(a) - rng.integers(0, 5), replace=False), rng.integers(60, 70, 2).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        if 100 * common >= 85 * (len(a) + len(b) - common):
            heavy = np.sort(rng.choice(np.arange(60, dtype=np.uint64), 20, replace=False))
            heavy = J.Heavy(heavy, np.ones(len(heavy), dtype=np.int64))
            shared = np.intersect1d(J._prefix(J._ordered(a, heavy), 85), J._prefix(J._ordered(b, heavy), 85))
            assert len(shared) >= min(J.REPEATS, J.fewest(len(a)), J.fewest(len(b)))


def test_opening_gives_a_spanning_forest():
    same = np.arange(100, dtype=np.uint64)
    group = [(bytes([k]), np.append(same, np.uint64(1000 + k))) for k in range(30)]
    assert len(J.spanning_links(group, None, 85)) == 29
    other = [(bytes([100 + k]), np.append(same, np.uint64(2000 + k))) for k in range(30)]
    assert len(J.spanning_links(group, other, 85)) == 59
    assert J.spanning_links(group, [(b"z", np.arange(5000, 5100, dtype=np.uint64))], 85) == []


def test_components_of_a_chain(spark):
    edges = [(bytes([0, k]), bytes([0, k + 1])) for k in range(60)] + [(bytes([9, 9]), bytes([9, 1]))] * 2
    got = {bytes(r["node"]): bytes(r["root"]) for r in J.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert got == {bytes([0, k]): bytes([0, 0]) for k in range(1, 61)} | {bytes([9, 9]): bytes([9, 1])}


def test_awkward_rows(spark, awkward, no_documents):
    rows = [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    want = brute(rows)
    got = J.near_duplicates(awkward).collect()
    assert len(got) == len(rows) and all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] for r in got)
    assert J.near_duplicates(no_documents).count() == 0


def test_one_of_each(spark, awkward, no_documents):
    kept = J.one_of_each(awkward)
    assert kept.columns == awkward.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect())
    # 7, 8, 9 and the row without id are near copies of 6; the two equal rows become one; texts without words stay.
    gone = {7, 8, 9}
    assert ids == [(False, i) for i in range(18) if i not in gone] + [(False, 100)]
    assert J.one_of_each(no_documents).count() == 0
    nameless = spark.createDataFrame(rows_of([" ".join(words(1, 50))] * 3, [None] * 3), DOCUMENTS)
    assert J.one_of_each(nameless).count() == 1


def test_rounds_take_tasks_by_their_edges(spark, monkeypatch):
    """A chain of 40 nodes is one task's work in every round, however many shuffle partitions there are."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    parts, plain = [], J.stage

    def spied(df, label):
        written = plain(df, label)
        parts.append(len(written.inputFiles()))
        return written

    monkeypatch.setattr(J, "stage", spied)
    edges = spark.createDataFrame([(bytes([k]), bytes([k + 1])) for k in range(40)], "a binary, b binary")
    try:
        for key, value in zip(kept, ("37", "false"), strict=True):
            spark.conf.set(key, value)
        got = J.components(edges).collect()
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
    assert {(bytes(r["node"]), bytes(r["root"])) for r in got} == {(bytes([k]), bytes([0])) for k in range(1, 41)}
    assert len(parts) > 2 and max(parts[1:]) == 1
