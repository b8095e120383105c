"""Nearest neighbours by inner product: one vantage-point tree per shard, pruned by the triangle inequality.

Inner product becomes distance by one more coordinate: with M the largest norm of a shard, x is extended by
sqrt(M**2 - |x|**2) and a query by 0, and |q - x|**2 = |q|**2 + M**2 - 2 q.x. A subtree whose points have
distances between low and high to its vantage point v holds nothing nearer to q than
max(low - d(q, v), d(q, v) - high). It is skipped if this bound times the factor RELAX exceeds the distance of the
k-th best found so far. With factor one, the default, only subtrees without an answer are skipped (exact search); a larger one
skips more and may miss some.

Vectors are dealt to shards of bounded size by the hash of their id; every one is indexed. A query is first searched
in its own shard, which gives a lower limit for its k-th best anywhere, then in every other shard, in blocks
of queries: a task holds one tree and one block. Splits are by rank, so many equal vectors still give a tree
of logarithmic depth. Scores are summed in double precision in one fixed order from the original vectors.

Defined results: vectors that are NULL, empty, all zero, or hold NULL or non-finite components, and rows without id, take
no part. Of rows with the same id the one with the smallest vector stands for the id. Only vectors of equal length are
compared. Ties go to the smaller id. With fewer than k candidates all are returned; an empty table gives an
empty result. Extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalflow.llm.common import table
from evalflow.staging import stage

K = 20
QUERY_STEP = 20
#: Vectors of a shard and queries of a block, about.
SHARD_ROWS = 4096
BLOCK_ROWS = 2048
LEAF = 64
#: Exact search. Larger factors save little on vectors without clusters and lose neighbours on those of low dimension;
#: see the README for the measurement.
RELAX = 1.0
_SLACK = 1e-9


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise products, every row summed in the same order."""
    return (a * b).sum(axis=1)


def _scaled(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows over powers of two that bring their largest component near 1, those powers, and the rows' lengths then.

    Dividing by a power of two is exact, so vectors of any magnitude are measured alike.
    """
    _, powers = np.frexp(np.abs(points).max(axis=1, initial=0.0))
    small = np.ldexp(points, -powers[:, None])
    return small, powers, np.sqrt((small * small).sum(axis=1))


class Tree:
    """Points in tree order. A node over [lo, hi) has its vantage point at lo; inner half, then outer half, behind it.

    Distances are those of the points over the longest one, with a component more that brings them all to length 1, to
    queries of length 1. Only they decide what is visited; hits are compared by the exact products of the original vectors.
    """

    def __init__(self, ids: np.ndarray, points: np.ndarray, ranges: np.ndarray):
        self.ids, self.points, self.ranges = ids, points, ranges
        self.unit, self.power, self.longest = self._unit(points)
        self.visited = 0

    @staticmethod
    def _unit(points: np.ndarray) -> tuple[np.ndarray, int, float]:
        _, power = np.frexp(np.abs(points).max(initial=0.0))
        small = np.ldexp(points, -power)
        longest = float(np.sqrt((small * small).sum(axis=1).max(initial=0.0))) or 1.0
        return small / longest, int(power), longest

    @staticmethod
    def nodes(n: int) -> Iterator[tuple[int, int, int]]:
        """(lo, mid, hi) of every inner node, parents first."""
        todo = [(0, n)]
        while todo:
            lo, hi = todo.pop()
            if hi - lo > LEAF:
                mid = lo + 1 + (hi - lo - 1) // 2
                yield lo, mid, hi
                todo += [(lo + 1, mid), (mid, hi)]

    @classmethod
    def build(cls, ids: np.ndarray, points: np.ndarray) -> Tree:
        order = np.argsort(ids, kind="stable")
        unit = cls._unit(points)[0]
        full = np.column_stack([unit, np.sqrt(np.maximum(1.0 - (unit * unit).sum(axis=1), 0.0))])
        ranges = {}
        for lo, mid, hi in cls.nodes(len(ids)):
            here = order[lo:hi]
            # The vantage point: of a few candidates, the one farthest from the middle of the node.
            some = here[:: max(1, len(here) // 16)]
            centre = full[here].mean(axis=0)
            pick = int(np.argmax(((full[some] - centre) ** 2).sum(axis=1))) * max(1, len(here) // 16)
            here[[0, pick]] = here[[pick, 0]]
            d = np.sqrt(((full[here[1:]] - full[here[0]]) ** 2).sum(axis=1))
            by = np.argsort(d, kind="stable")
            order[lo], order[lo + 1 : hi] = here[0], here[1:][by]
            d = d[by]
            half = mid - lo - 1
            ranges[lo] = (d[0], d[half - 1], d[half], d[-1])
        kept = np.array([ranges[lo] for lo, _, _ in cls.nodes(len(ids))], dtype=np.float64).reshape(-1, 4)
        return cls(ids[order], np.ascontiguousarray(points[order]), kept)

    def search(
        self, ids: np.ndarray, queries: np.ndarray, limit: np.ndarray, k: int, relax: float
    ) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the k best points for each query (-1: none) and their inner products.

        Only points of at least ``limit`` are returned; the query's own id is left out. Below a vantage point that is
        the query itself the search is not relaxed: its bound there is exact and the nearest points lie on both sides.
        """
        best = np.full((len(queries), k), -np.inf)
        place = np.full((len(queries), k), -1, dtype=np.int64)
        lowest, limit = limit, limit.copy()
        small, powers, lengths = _scaled(queries)
        unit = small / np.where(lengths > 0, lengths, 1.0)[:, None]

        def bar(rows: np.ndarray) -> np.ndarray:
            """What a product of unit vectors has to reach, a little less for rounding."""
            with np.errstate(over="ignore"):
                scaled = np.ldexp(limit[rows], -(powers[rows] + self.power))
            return scaled / np.where(lengths[rows] > 0, lengths[rows] * self.longest, 1.0) - _SLACK

        def offer(rows: np.ndarray, lo: int, hi: int, products: np.ndarray) -> None:
            open_ = (products >= bar(rows)[:, None]) & (self.ids[None, lo:hi] != ids[rows, None])
            some = open_.any(axis=1)
            if not some.any():
                return
            rows, open_ = rows[some], open_[some]
            x, y = np.nonzero(open_)
            exact = np.full(open_.shape, -np.inf)
            for part in range(0, len(x), 1 << 16):
                i, j = x[part : part + (1 << 16)], y[part : part + (1 << 16)]
                exact[i, j] = _dot(queries[rows[i]], self.points[lo + j])
            at = np.broadcast_to(np.arange(lo, hi), exact.shape)
            values = np.concatenate([best[rows], exact], axis=1)
            places = np.concatenate([place[rows], at], axis=1)
            order = np.lexsort((np.where(places < 0, 0, self.ids[places]), -values), axis=1)[:, :k]
            best[rows] = np.take_along_axis(values, order, axis=1)
            place[rows] = np.where(np.isneginf(best[rows]), -1, np.take_along_axis(places, order, axis=1))
            limit[rows] = np.maximum(limit[rows], best[rows, -1])

        def distance(products: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(2.0 - 2.0 * products, 0.0))

        at = {lo: i for i, (lo, _, _) in enumerate(self.nodes(len(self.ids)))}

        def measured(rows: np.ndarray, lo: int, hi: int) -> np.ndarray:
            self.visited += len(rows) * (hi - lo)
            products = unit[rows] @ self.unit[lo:hi].T
            offer(rows, lo, hi, products)
            return products

        # First down to one leaf, always to the nearer side: the k-th best there limits the search from its start.
        # These hits stay; the search leaves out that leaf and the vantage points above it.
        leaf = np.zeros(len(queries), dtype=np.int64)
        todo = [(0, len(self.ids), np.arange(len(queries)))]
        while todo:
            lo, hi, rows = todo.pop()
            if lo not in at or hi - lo <= LEAF:
                leaf[rows] = lo
                measured(rows, lo, hi)
                continue
            mid = lo + 1 + (hi - lo - 1) // 2
            d = distance(measured(rows, lo, lo + 1)[:, 0])
            inner = d <= self.ranges[at[lo], 1:3].mean()
            todo += [(*side, rows[some]) for side, some in (((lo + 1, mid), inner), ((mid, hi), ~inner)) if some.any()]

        todo = [(0, len(self.ids), np.arange(len(queries)), np.zeros(len(queries)))]
        while todo:
            lo, hi, rows, bound = todo.pop()
            rows = rows[bound <= distance(bar(rows)) + _SLACK]
            if not len(rows):
                continue
            done = (lo <= leaf[rows]) & (leaf[rows] < hi)  # measured on the way down
            if lo not in at or hi - lo <= LEAF:
                if not done.all():
                    measured(rows[~done], lo, hi)
                continue
            mid = lo + 1 + (hi - lo - 1) // 2
            if not done.all():
                measured(rows[~done], lo, lo + 1)
            d = distance(unit[rows] @ self.unit[lo])
            factor = np.where(self.ids[lo] == ids[rows], 1.0, relax)
            near, edge, far_edge, far = self.ranges[at[lo]]
            todo.append((mid, hi, rows, factor * np.maximum(far_edge - d, d - far)))
            todo.append((lo + 1, mid, rows, factor * np.maximum(near - d, d - edge)))
        place[best < lowest[:, None]] = -1
        return place, best


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """`id`, `dim` and `vector` of the rows that take part."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    kept = vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(embedding).cast("array<double>").alias("vector"))
    kept = kept.where(F.col("id").isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))
    return kept.select("id", F.size("vector").alias("dim"), "vector")


_TREE = "shard long, dim int, ids binary, points binary, ranges binary"


def index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard: its tree."""
    shards = max(1, -(-vectors.count() // shard_rows))
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        points = np.array(group["vector"].tolist(), dtype=np.float64)
        ids = group["id"].to_numpy(dtype=np.int64)
        order = np.lexsort((*points.T[::-1], ids))
        order = order[np.append(True, np.diff(ids[order]) != 0)]  # one vector for each id
        tree = Tree.build(ids[order], points[order])
        row = (group["shard"].iloc[0], group["dim"].iloc[0], tree.ids.tobytes(), tree.points.tobytes(), tree.ranges.tobytes())
        return pd.DataFrame([row], columns=["shard", "dim", "ids", "points", "ranges"])

    return stage(dealt.groupBy("shard", "dim").applyInPandas(build, _TREE), "vector-trees")


def _tree(row) -> Tree:
    ids = np.frombuffer(row["ids"], dtype=np.int64)
    points = np.frombuffer(row["points"], dtype=np.float64).reshape(len(ids), -1)
    return Tree(ids, points, np.frombuffer(row["ranges"], dtype=np.float64).reshape(-1, 4))


_FOUND = "query_id long, ids array<long>, scores array<double>"


def _answers(tree: Tree, ids: np.ndarray, queries: np.ndarray, limit: np.ndarray, k: int, relax: float) -> list[tuple]:
    out = []
    for query_id, query, places in zip(ids, queries, tree.search(ids, queries, limit, k, relax)[0], strict=True):
        places = places[places >= 0]
        if len(places):
            points = tree.points[places]
            out.append((int(query_id), tree.ids[places].tolist(), _dot(np.broadcast_to(query, points.shape), points).tolist()))
    return out


def nearest(
    vectors: DataFrame,
    k: int = K,
    query_step: int = QUERY_STEP,
    relax: float = RELAX,
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """`query_id`, `rank`, `vec_id`, `score`: the k nearest rows of every row whose id ``query_step`` divides.

    ``vectors`` has the columns of `usable`.
    """
    trees = index(vectors, shard_rows)

    def at_home(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in groups:
            for _, row in group.iterrows():
                tree = _tree(row)
                own = tree.ids % query_step == 0
                ids, queries = tree.ids[own], tree.points[own]
                found = {a[0]: a for a in _answers(tree, ids, queries, np.full(len(ids), -np.inf), k, relax)}
                for query_id, query in zip(ids.tolist(), queries, strict=True):
                    _, near, scores = found.get(query_id, (0, [], []))
                    limit = min(scores) if len(scores) == k else -np.inf
                    yield pd.DataFrame(
                        [(query_id, row["dim"], row["shard"], query.tobytes(), limit, near, scores)],
                        columns=["query_id", "dim", "home", "query", "low", "ids", "scores"],
                    )

    kind = "query_id long, dim int, home long, query binary, low double, ids array<long>, scores array<double>"
    # A row is one tree: small Arrow batches keep the memory of a task to a few trees.
    home = stage(_few_rows(trees).mapInPandas(at_home, kind), "vector-queries")
    blocks = max(1, -(-home.count() // block_rows))
    packed = home.withColumn("block", F.pmod(F.xxhash64(F.lit(2), "query_id"), F.lit(blocks))).groupBy("dim", "block").agg(
        F.collect_list(F.struct("query_id", "home", "query", "low")).alias("queries")
    )
    packed = stage(packed, "vector-blocks")
    named = packed.select(F.col("dim").alias("q_dim"), F.col("block").alias("q_block"), "queries")
    shards = trees.select(F.col("shard").alias("q_shard"), F.col("dim").alias("s_dim"))
    asked = named.join(shards, F.col("q_dim") == F.col("s_dim"))
    offered = trees.join(packed.select(F.col("dim").alias("b_dim"), "block"), F.col("dim") == F.col("b_dim"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            tree, shard = _tree(left.iloc[0]), int(left["shard"].iloc[0])
            away = [q for q in right["queries"].iloc[0] if q["home"] != shard]
            if away:
                ids = np.array([q["query_id"] for q in away], dtype=np.int64)
                queries = np.array([np.frombuffer(q["query"], dtype=np.float64) for q in away])
                out = _answers(tree, ids, queries, np.array([q["low"] for q in away]), k, relax)
        return pd.DataFrame(out, columns=["query_id", "ids", "scores"])

    trees_of = offered.groupBy("dim", "shard", "block")
    abroad = trees_of.cogroup(asked.groupBy("q_dim", "q_shard", "q_block")).applyInPandas(search, _FOUND)
    every = home.select("query_id", "ids", "scores").unionByName(abroad)
    rows = every.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x"))
    rows = rows.select("query_id", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _few_rows(df: DataFrame) -> DataFrame:
    """The rows spread one by one over the tasks."""
    return df.repartition(max(1, df.count()), "shard")


def op3_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest(usable(table(spark, sf_dir, "embeddings")))
