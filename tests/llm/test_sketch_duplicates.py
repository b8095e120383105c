import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalflow.llm import set_sketch as K
from evalflow.llm import sketch_duplicates as D

from .conftest import words
from .test_jaccard import brute, variants


def pair(rng, n_a, n_b, common):
    values = rng.integers(0, 1 << 63, n_a + n_b - common, dtype=np.int64).astype(np.uint64)
    return np.sort(values[:n_a]), np.sort(values[n_a - common :])


def counts(x, y):
    larger, smaller = int((x > y).sum()), int((x < y).sum())
    return np.array([larger]), np.array([smaller]), np.array([len(x) - larger - smaller])


def test_registers_are_truncated_minima_that_merge():
    rng = np.random.default_rng(2)
    sets = [np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 2, 6, 40, 300, 5000)] + [np.zeros(0, dtype=np.uint64)]
    made = K.sketches(sets)
    assert made.dtype == np.uint16 and made.shape == (7, K.REGISTERS) and (made[6] == 0).all() and (made[:6] > 0).all()
    # The same set alone and beside others, and the union from its parts.
    assert all((K.sketches([s])[0] == made[k]).all() for k, s in enumerate(sets))
    union = np.unique(np.concatenate(sets[3:6]))
    assert (K.sketches([union])[0] == K.merged(*made[3:6])).all()
    # The mean of the registers grows by the logarithm of the size.
    grown = (made[5].mean() - made[4].mean()) * np.log(K.BASE)
    assert abs(grown - np.log(5000 / 300)) < 0.4


@pytest.mark.parametrize("n_a,n_b,common", [(200, 200, 180), (200, 200, 60), (400, 300, 290), (1000, 900, 0), (50, 60, 50)])
def test_joint_estimate_is_near_the_similarity(n_a, n_b, common):
    rng = np.random.default_rng(n_a + common)
    true, found, same = common / (n_a + n_b - common), [], []
    for _ in range(60):
        x, y = K.sketches(pair(rng, n_a, n_b, common))
        c = counts(x, y)
        found.append(float(K.estimate(np.array([n_a]), np.array([n_b]), *c)[0]))
        same.append(c[2][0] / K.REGISTERS)
    assert abs(np.mean(found) - true) < 0.015 and np.std(found) < 0.04
    assert abs(np.mean(same) - true) < 0.03  # locality-sensitive


def test_pairs_at_the_border_are_kept_and_far_ones_not():
    rng = np.random.default_rng(7)
    missed = apart = 0
    for _ in range(150):
        n = int(rng.integers(100, 300))
        common = -(-2 * n * 85 // 185)
        x, y = K.sketches(pair(rng, n, n, common))
        missed += not K.may_reach(0.85, D.SLACK, np.array([n]), np.array([n]), *counts(x, y))[0]
        missed += not (D._buckets(np.stack([x]), D.BANDS) == D._buckets(np.stack([y]), D.BANDS)).any()
        x, y = K.sketches(pair(rng, n, n, n // 2))
        apart += not K.may_reach(0.85, D.SLACK, np.array([n]), np.array([n]), *counts(x, y))[0]
    assert missed == 0 and apart == 150
    assert not K.may_reach(0.85, D.SLACK, np.array([100]), np.array([84]), np.array([0]), np.array([0]), np.array([252]))[0]


def got_of(docs, size=5, percent=85):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in D.near_duplicates(docs, size, percent).collect()}


@pytest.mark.parametrize("size,percent,members", [(5, 85, 1000), (5, 85, 7), (3, 70, 20)])
def test_components_equal_brute_force(spark, monkeypatch, size, percent, members):
    monkeypatch.setattr(D, "BLOCK_MEMBERS", members)
    texts = variants(size + percent) + [" ".join(words("long", 30 + k)) for k in range(12)]
    rows = list(enumerate(texts))
    got = got_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), size, percent)
    assert got == brute(rows, size, percent) and len({c for _, c in got.values()}) < len(rows)


def family(n, seed=8):
    """Copies of one text with 0 to 7 changes, most of them too many for a link."""
    rng = random.Random(seed)
    base, texts = words("base", 150), []
    for k in range(n):
        copy = list(base)
        for _ in range(k % 8):
            copy[rng.randrange(len(copy))] = f"own{k}x{rng.randrange(1000)}"
        texts.append(" ".join(copy))
    return texts


def test_a_large_family_gives_no_pairs_of_all_members(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_MEMBERS", 100)
    rows = list(enumerate(family(400)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    seen, plain = {}, D.components

    def spied(edges, *a, **k):
        seen[len(seen)] = edges.distinct().count()
        return plain(edges, *a, **k)

    monkeypatch.setattr(D, "components", spied)
    assert got_of(docs) == brute(rows, 5)
    # Candidates of the heads, of the blocks, and links: some per member, not by their square.
    assert max(seen.values()) < 400 * 42 / 4


def test_blocks_find_what_the_heads_do_not(spark, monkeypatch):
    """Two linked texts in one bucket, whose head is linked to neither."""
    cells = [dict(n=100, set_id=bytes([k])) for k in range(3)]
    rng = np.random.default_rng(1)
    a, b = pair(rng, 100, 100, 95)
    c = np.sort(rng.integers(0, 1 << 62, 100).astype(np.uint64))
    for cell, s in zip(cells, (c, a, b), strict=True):
        cell["registers"] = K.sketches([s])[0].tobytes()
    assert D._block_candidates(cells, None, 85) == [(bytes([1]), bytes([2]))]
    assert D._block_candidates(cells[:2], cells[2:], 85) == [(bytes([1]), bytes([2]))]
    assert D._block_candidates(cells[1:], cells[:1], 85) == []
    rows = [(c["set_id"], 0, 0, 100, c["registers"]) for c in cells]
    sketched = spark.createDataFrame(rows, "set_id binary, doc_id long, text_key long, n long, registers binary")
    one = sketched.select("set_id", F.lit(7).cast("long").alias("bucket"))
    monkeypatch.setattr(D, "bucket_cells", lambda s: one)
    found = D.candidate_clusters(sketched, 85).collect()
    assert [(bytes(r["node"]), bytes(r["root"])) for r in found] == [(bytes([2]), bytes([1]))]


def test_blocks_compare_clusters_only():
    """Members that heads have connected are left out; a pair of two clusters is found in a block and across two."""
    rng = np.random.default_rng(1)
    a, b = pair(rng, 100, 100, 95)
    cells = [dict(n=100, set_id=bytes([k]), root=bytes([0]), registers=K.sketches([s])[0].tobytes()) for k, s in enumerate((a, b, a))]
    assert D._block_candidates(cells, None, 85) == D._block_candidates(cells[:1], cells[1:], 85) == []
    cells[2]["root"] = bytes([2])
    assert {max(p) for p in D._block_candidates(cells, None, 85)} == {bytes([2])}
    assert D._block_candidates(cells[:1], cells[1:], 85) == [(bytes([0]), bytes([2]))]


def test_rising_likelihood_decides_like_the_best_estimate():
    rng = np.random.default_rng(3)
    n_a, n_b = rng.integers(6, 900, 5000), rng.integers(6, 900, 5000)
    n_b[::2] = np.maximum(6, (n_a[::2] * rng.uniform(0.8, 1.25, 2500)).astype(int))
    equal = rng.integers(150, 253, 5000)
    larger = ((252 - equal) * rng.uniform(0, 1, 5000)).astype(int)
    counts = (n_a.astype(float), n_b.astype(float), larger, 252 - equal - larger, equal)
    best = K.estimate(*counts)
    close = K.log_likelihood(best, *counts) - K.log_likelihood(np.full(5000, 0.85), *counts) <= D.SLACK
    fits = np.minimum(n_a, n_b) >= 0.85 * np.maximum(n_a, n_b) * (1 - 1e-12)
    got = K.may_reach(0.85, D.SLACK, n_a, n_b, *counts[2:])
    assert (got == (fits & ((best >= 0.85) | close))).all() and 500 < got.sum() < 4500


def test_awkward_rows(spark, awkward, no_documents):
    rows = [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    want = brute(rows, 5)
    got = D.near_duplicates(awkward).collect()
    assert len(got) == len(rows) and all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] for r in got)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert D.near_duplicates(no_documents).count() == 0
    assert D.near_duplicates(awkward.where(F.col("text").isNull())).agg(F.max("n_shingles")).first()[0] == 0
    assert D.least_size(85) == 6 and D.least_size(80) == 4 and D.least_size(100) == float("inf")
