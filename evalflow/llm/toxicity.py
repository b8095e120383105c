"""Toxicity by a classifier chain: one linear model per category, each fed with the categories before it.

The first model sees words, every later one also the probabilities of the earlier categories. In training
those are out-of-fold: a row's probability comes from models that never saw the row, as it will be for
unseen documents. Features are the presence of informative words and word beginnings, found by how far the share of labelled
documents with the word differs between the classes; presence, not frequency, so a long document does not
thin out an insult. The models are fitted by Newton's method on the driver, on a bounded sample.

Bounds: at most about MAX_ROWS labelled rows are used for fitting (picked by the hash of the id) and
at most WORDS_PER_CATEGORY words for each category. Every document is scored, over its whole text.

Defined results: a NULL or empty text has no words and scores as such. Labels that are NULL in one of the
categories, or that have no document, are not used for fitting. With no usable label, or only one class, a category's
probability is its smoothed share and nothing is rejected. Extra columns do not matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalflow.llm.common import fresh, table
from evalflow.staging import stage

MAX_ROWS = 20_000
WORDS_PER_CATEGORY = 128
MIN_ROWS = 5
FOLDS = 5
RIDGE = 0.3
#: Rows that the fit takes as numbers at a time.
FIT_ROWS = 2048
#: Lengths of word beginnings that are features beside the words themselves.
BEGINNINGS = (3, 5, 7)
CATEGORIES = ("quality", "toxic")

_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    """The distinct words; marked by a star, beginnings of them, and by two stars, beginnings of several of them."""
    if not text:
        return set()
    words = set(_LETTERS.findall(text.lower()))
    found = set(words)
    for n in BEGINNINGS:
        starts = Counter([w[:n] for w in words if len(w) >= n])
        found.update([f"{w}*" for w in starts], [f"{w}**" for w, times in starts.items() if times > 1])
    return found


@dataclass
class Chain:
    """Word positions, and for each category an intercept, word weights and weights of earlier categories."""

    words: dict[str, int]
    categories: tuple[str, ...]
    weights: list[np.ndarray]
    thresholds: list[float]

    def probabilities(self, texts: Sequence[str | None]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.words) + 1))
        x[:, 0] = 1.0
        known = self.words.keys()
        for row, text in enumerate(texts):
            for word in words_of(text) & known:
                x[row, 1 + self.words[word]] = 1.0
        out: list[np.ndarray] = []
        for w in self.weights:
            out.append(_sigmoid(np.column_stack([x, *out]) @ w))
        return np.column_stack(out) if len(texts) else np.zeros((0, len(self.weights)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _blocks(columns: Sequence[np.ndarray], rows: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """The chosen rows of tables side by side as double numbers, FIT_ROWS at a time, and where they stand among the chosen."""
    for at in range(0, len(rows), FIT_ROWS):
        here = slice(at, at + FIT_ROWS)
        yield here, np.column_stack([c[rows[here]] for c in columns]).astype(np.float64, copy=False)


def _predicted(columns: Sequence[np.ndarray], rows: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0), *[_sigmoid(some @ w) for _, some in _blocks(columns, rows)]])


def fit_linear(
    x: np.ndarray | Sequence[np.ndarray], y: np.ndarray, ridge: float = RIDGE, steps: int = 15, rows: np.ndarray | None = None
) -> np.ndarray:
    """Logistic regression with an unpenalised intercept in column 0. ``x``: a table or several side by side, of any numbers;
    ``rows``: those of it that ``y`` belongs to, all if not given."""
    columns = [x] if isinstance(x, np.ndarray) else list(x)
    rows = np.arange(len(y)) if rows is None else rows
    width = sum(c.shape[1] for c in columns)
    w = np.zeros(width)
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    w[0] = np.log(share / (1 - share))
    if len(y) == 0 or y.min() == y.max():
        return w
    penalty = np.full(width, ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        gradient, curved = penalty * w, np.diag(penalty)
        for here, some in _blocks(columns, rows):
            p = _sigmoid(some @ w)
            gradient += some.T @ (p - y[here])
            curved += (some * (p * (1 - p))[:, None]).T @ some
        step = np.linalg.solve(curved, gradient)
        w = w - step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Middle of the gap below the best F1 on out-of-fold probabilities; above 1 (reject nothing) without positives."""
    if not len(y) or y.min() == y.max():
        return 1.1
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    ends = np.append(np.diff(p[order]) != 0, True)  # equal probabilities are taken together
    best = int(np.argmax(np.where(ends, f1, -1.0)))
    below = p[order][best + 1] if best + 1 < len(y) else 0.0
    return float((p[order][best] + below) / 2)


def fit_chain(x: np.ndarray, labels: np.ndarray, folds: np.ndarray) -> tuple[list[np.ndarray], list[float]]:
    """``x`` with an intercept column, of any numbers; ``labels`` one column per category in chain order."""
    weights, thresholds, columns = [], [], [x]
    for k in range(labels.shape[1]):
        y = labels[:, k]
        held = np.zeros(len(y))
        for fold in np.unique(folds):
            out, rest = np.flatnonzero(folds == fold), np.flatnonzero(folds != fold)
            held[out] = _predicted(columns, out, fit_linear(columns, y[rest], rows=rest))
        weights.append(fit_linear(columns, y))
        thresholds.append(best_threshold(held, y))
        columns.append(held[:, None])
    return weights, thresholds


def train(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = CATEGORIES, max_rows: int = MAX_ROWS) -> Chain:
    """Fit the chain on labelled documents; both tables carry doc_id."""
    labels = labels.select("doc_id", *[F.col(c).cast("double").alias(f"y{i}") for i, c in enumerate(categories)]).dropna()
    share = min(1.0, max_rows / max(1, labels.count()))
    # About max_rows rows of three numbers: a bounded table, so the texts need not be shuffled to meet it.
    sample = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).join(F.broadcast(sample), "doc_id")
    ys = [f"y{i}" for i in range(len(categories))]

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["doc_id", "text_key", *ys]].assign(words=[sorted(words_of(t)) for t in batch["text"]])

    kind = "doc_id long, text_key long, " + ", ".join(f"{y} double" for y in ys) + ", words array<string>"
    rows = stage(texts.mapInPandas(split, kind), "toxicity-sample")
    sums = [F.count("*").alias("n"), *[F.sum(y).alias(y) for y in ys]]
    total = rows.agg(*sums).first()
    counted = rows.select(F.explode("words").alias("word"), *ys).groupBy("word").agg(*sums).where(F.col("n") >= MIN_ROWS)
    words: dict[str, int] = {}
    for y in ys:
        if total["n"] and 0 < total[y] < total["n"]:
            a, b = F.col(y) / total[y], (F.col("n") - F.col(y)) / (total["n"] - total[y])
            apart = (a - b) * (a - b) / (a + b)
            for r in counted.orderBy(apart.desc(), "word").limit(WORDS_PER_CATEGORY).collect():
                words.setdefault(r["word"], len(words))
    known = F.array(*[F.lit(w) for w in words]).cast("array<string>")
    slim = rows.select("doc_id", "text_key", *ys, F.array_intersect("words", known).alias("words"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            present = np.zeros((batch.num_rows, len(words)), dtype=bool)
            for row, found in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                present[row, [words[w] for w in found]] = True
            bits = pa.array([r.tobytes() for r in np.packbits(present, axis=1)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], bits], names=["doc_id", "text_key", *ys, "bits"])

    # A bit for each word is what the driver gets of a row, and a byte what it keeps.
    kind = "doc_id long, text_key long, " + ", ".join(f"{y} double" for y in ys) + ", bits binary"
    fitted = slim.mapInArrow(packed, kind).toArrow()
    fitted = fitted.take(np.argsort(fitted["doc_id"].to_numpy(), kind="stable"))
    bits = np.frombuffer(b"".join(fitted["bits"].to_pylist()), dtype=np.uint8).reshape(len(fitted), -(-len(words) // 8))
    x = np.ones((len(fitted), len(words) + 1), dtype=np.uint8)
    x[:, 1:] = np.unpackbits(bits, axis=1)[:, : len(words)]
    # By the text, so that no copy of a row teaches what is predicted for it.
    folds = fitted["text_key"].to_numpy() % FOLDS
    weights, thresholds = fit_chain(x, np.column_stack([fitted[y].to_numpy() for y in ys]), folds)
    return Chain(words, tuple(categories), weights, thresholds)


def score(docs: DataFrame, chain: Chain, prefix: str = "p_") -> DataFrame:
    """All columns of the documents and one probability per category."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(chain.probabilities([t if isinstance(t, str) else None for t in texts])))

    # Not deterministic for the optimizer only: it would otherwise score once for each use of the result.
    held = fresh(docs, "probabilities")
    scored = docs.withColumn(held, run.asNondeterministic()("text"))
    return scored.withColumns({f"{prefix}{c}": F.get(held, k) for k, c in enumerate(chain.categories)}).drop(held)


def flag(docs: DataFrame, labels: DataFrame, category: str = "toxic", **options) -> DataFrame:
    """`doc_id`, the text's hash, a probability per category, and whether the last category is above its threshold."""
    chain = train(docs, labels, **options)
    limit = chain.thresholds[chain.categories.index(category)]
    slim = score(docs.select("doc_id", "text"), chain).withColumn("text_key", F.xxhash64("text")).drop("text")
    return slim.withColumn(category, F.col(f"p_{category}") >= F.lit(limit))


def without_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    chain = train(docs, labels, **options)
    limit = chain.thresholds[-1]

    @F.pandas_udf("boolean")
    def rejected(texts: pd.Series) -> pd.Series:
        return pd.Series(chain.probabilities([t if isinstance(t, str) else None for t in texts])[:, -1] >= limit, dtype=bool)

    return docs.where(~rejected("text"))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """The rejected documents with their probabilities."""
    flagged = flag(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return flagged.where("toxic").drop("text_key")
