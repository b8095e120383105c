import numpy as np
import pytest
from pyspark.sql import functions as F

from evalflow.llm import neighbours as N

VECTORS = "vec_id long, embedding array<float>, label int, shard int, dim string"


def brute(ids, points, k, step):
    out = {}
    order = np.argsort(ids)
    ids, points = ids[order], points[order]
    for i, q in zip(ids.tolist(), points, strict=True):
        if i % step == 0:
            score = (points * q).sum(axis=1)
            score[ids == i] = -np.inf
            best = [j for j in np.lexsort((ids, -score))[:k] if score[j] > -np.inf]
            out[i] = [(int(ids[j]), float(score[j])) for j in best]
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(7)
    points = rng.normal(size=(1500, 16)).astype(np.float32) * rng.uniform(0.2, 3, size=(1500, 1)).astype(np.float32)
    points[200:700] = points[200]  # a third of all vectors are equal
    rows = [(i, p.tolist(), 0, 0, "x") for i, p in enumerate(points)]
    return spark.createDataFrame(rows, VECTORS), points.astype(np.float64)


def collected(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: [(v, s) for _, v, s in sorted(rows)] for q, rows in out.items()}


def test_factor_one_is_exact(vectors):
    df, points = vectors
    got = collected(N.nearest(N.usable(df), k=10, relax=1.0, shard_rows=300, block_rows=16))
    assert got == brute(np.arange(len(points)), points, 10, 20)


def test_recall_of_the_default_factor(spark):
    rng = np.random.default_rng(8)
    points = rng.normal(size=(6000, 64))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    rows = [(i, p.tolist(), 0, 0, "x") for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, shard int, dim string")
    got = collected(N.nearest(N.usable(df)))
    want = brute(np.arange(len(points)), points, 20, 20)
    hits = [len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want]
    assert got.keys() == want.keys() and np.mean(hits) >= 0.95


def test_pruning_visits_less_where_vectors_cluster():
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 8)) * 20
    points = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 8)) * 0.1
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    tree = N.Tree.build(np.arange(4000), points)
    queries = np.arange(0, 4000, 100)
    places, _ = tree.search(queries, points[queries], np.full(len(queries), -np.inf), 5, 1.0)
    assert tree.visited < 0.6 * 4000 * len(queries)
    want = brute(np.arange(4000), points, 5, 100)
    for q, found in zip(queries.tolist(), places, strict=True):
        assert {int(tree.ids[p]) for p in found} == {v for v, _ in want[q]}


def _shapes():
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 16)) * 3
    return {
        "four": rng.normal(size=(3000, 4)),
        "eight": rng.normal(size=(3000, 8)),
        "rank five": rng.normal(size=(3000, 5)) @ rng.normal(size=(5, 64)),
        "clusters": centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 16)),
        "tight clusters": centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 16)) * 0.1,
    }


@pytest.mark.parametrize("shape", _shapes())
@pytest.mark.parametrize("unit", [True, False])
def test_recall_on_low_dimensions_and_clusters(shape, unit):
    points = _shapes()[shape]
    if unit:
        points /= np.linalg.norm(points, axis=1, keepdims=True)
    tree = N.Tree.build(np.arange(3000), points)
    queries = np.arange(0, 3000, 20)
    places, _ = tree.search(queries, points[queries], np.full(len(queries), -np.inf), 20, N.RELAX)
    want = brute(np.arange(3000), points, 20, 20)
    hits = [len({int(tree.ids[p]) for p in found if p >= 0} & {v for v, _ in want[q]}) for q, found in zip(queries.tolist(), places, strict=True)]
    assert np.mean(hits) / 20 >= 0.95 and min(hits) >= 18


def test_relaxed_search_keeps_first_hits_and_serves_vantage_points():
    points = _shapes()["four"]
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    tree = N.Tree.build(np.arange(3000), points)
    every = np.arange(3000)
    places, _ = tree.search(every, points, np.full(3000, -np.inf), 20, 8.0)
    assert (places >= 0).all() and all(len(set(p)) == 20 for p in places.tolist())
    root = tree.ids[:1]
    places, _ = tree.search(root, points[root], np.full(1, -np.inf), 20, 4.0)
    want = {v for v, _ in brute(every, points, 20, 1)[int(root[0])]}
    assert len({int(tree.ids[p]) for p in places[0]} & want) >= 18


def test_unusable_vectors_and_repeated_ids(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [1.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]),
        (9, []), (None, [1.0, 1.0]), (40, [1.0, 1.0, 1.0]), (3, [1.0, 1.0]), (3, [0.5, 0.5]), (10, [2.0, 2.0]), (11, [2.0, 2.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collected(N.nearest(N.usable(df)))
    assert got == {0: [(10, 2.0), (11, 2.0), (3, 0.5), (20, 0.0)], 20: [(10, 2.0), (11, 2.0), (3, 0.5), (0, 0.0)]}


def test_empty_table(spark):
    assert N.nearest(N.usable(spark.createDataFrame([], VECTORS))).count() == 0
    assert N.nearest(N.usable(spark.createDataFrame([(1, [1.0], 0, 0, "")], VECTORS))).select(F.max("rank")).first()[0] is None


@pytest.mark.parametrize("scale", [1e-180, 1e-8, 1e-6, 1e8, 1e150])
@pytest.mark.parametrize("dims", [4, 16])
def test_exact_at_every_scale(scale, dims):
    rng = np.random.default_rng(dims)
    points = rng.normal(size=(1500, dims)) * scale
    points[100:140] = points[100]
    with np.errstate(under="ignore"):
        want = brute(np.arange(1500), points, 20, 50)
    tree = N.Tree.build(np.arange(1500), points)
    queries = np.arange(0, 1500, 50)
    places, best = tree.search(queries, points[queries], np.full(len(queries), -np.inf), 20, 1.0)
    for q, found, scores in zip(queries.tolist(), places, best, strict=True):
        if scale > 1e-150:
            assert list(zip(tree.ids[found].tolist(), scores.tolist(), strict=True)) == want[q]
        else:  # products of such numbers vanish, so all scores are equal
            assert [s for _, s in want[q]] == scores.tolist()


def test_exact_for_lengths_of_every_magnitude_in_one_tree():
    rng = np.random.default_rng(3)
    points = rng.normal(size=(2000, 8)) * 10.0 ** rng.uniform(-9, 9, size=(2000, 1))
    tree = N.Tree.build(np.arange(2000), points)
    queries = np.arange(0, 2000, 40)
    places, best = tree.search(queries, points[queries], np.full(len(queries), -np.inf), 20, 1.0)
    want = brute(np.arange(2000), points, 20, 40)
    for q, found, scores in zip(queries.tolist(), places, best, strict=True):
        assert list(zip(tree.ids[found].tolist(), scores.tolist(), strict=True)) == want[q]


@pytest.mark.parametrize("scale", [1e-7, 1e7])
def test_query_at_other_scales(spark, scale):
    points = np.random.default_rng(4).normal(size=(900, 6)) * scale
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>")
    assert collected(N.nearest(N.usable(df), k=7, shard_rows=200)) == brute(np.arange(900), points, 7, 20)
