import random
import tracemalloc

import numpy as np
import pytest

from evalflow.llm import toxicity as T

from .conftest import words


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(1500):
        low, bad = rng.random() < 0.3, rng.random() < 0.15
        text = words(i, rng.randrange(5, 80), 300) + ["zzz"] * (3 if low else 0)
        if bad:
            text.insert(rng.randrange(len(text)), rng.choice(["Vile!", "rotten,", "nasty"]))
        docs.append((i, " ".join(text), "extra", 1.0))
        if i < 1000:
            labels.append((i, int(not low), int(bad), "other"))
    schema = "doc_id long, text string, toxic string, p_toxic double"
    return spark.createDataFrame(docs, schema), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string"), docs


def test_held_out_documents(labelled):
    docs, labels, rows = labelled
    flagged = {r["doc_id"] for r in T.flag(docs, labels).where("toxic").collect()}
    truth = {i for i, text, *_ in rows if any(w in text.lower() for w in ("vile", "rotten", "nasty"))}
    held = set(range(1000, 1500))
    assert len(flagged & truth & held) >= 0.97 * len(truth & held)
    assert len(flagged - truth) <= 0.01 * len(rows)


def test_kept_documents_have_their_columns(labelled):
    docs, labels, _ = labelled
    kept = T.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() + T.flag(docs, labels).where("toxic").count() == docs.count()


def test_later_models_learn_from_out_of_fold_probabilities():
    rng = np.random.default_rng(3)
    x = np.column_stack([np.ones(600), rng.integers(0, 2, (600, 5))])
    first = (rng.random(600) < 0.2 + 0.6 * x[:, 1]).astype(float)
    second = (rng.random(600) < 0.1 + 0.8 * first).astype(float)
    folds = np.arange(600) % 5
    weights, thresholds = T.fit_chain(x, np.column_stack([first, second]), folds)
    assert len(weights[0]) == 6 and len(weights[1]) == 7 and len(thresholds) == 2
    # The out-of-fold feature of a row does not see its own label: pure noise gains nothing by it.
    noise = (rng.random(600) < 0.5).astype(float)
    held = np.zeros(600)
    for f in range(5):
        held[folds == f] = T._sigmoid(x[folds == f] @ T.fit_linear(x[folds != f], noise[folds != f]))
    assert abs(np.corrcoef(held, noise)[0, 1]) < 0.15


def test_presence_does_not_fade_in_long_texts(labelled):
    docs, labels, _ = labelled
    chain = T.train(docs, labels)
    short, long = chain.probabilities(["w1 w2 nasty w3", " ".join(words(9, 5000, 300)) + " nasty"])[:, -1]
    assert min(short, long) >= chain.thresholds[-1]


def test_fitting_uses_a_bounded_sample(labelled):
    docs, labels, _ = labelled
    chain = T.train(docs, labels, max_rows=300)
    assert len(chain.words) <= 2 * T.WORDS_PER_CATEGORY and np.isfinite(chain.weights[1]).all()


def test_awkward_tables(spark, awkward, no_documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, None, 1), (2, 1, None), (None, 1, 1), (3, 1, 0), (3, 1, 0), (999, 0, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        assert T.without_toxic(awkward, labels).count() == awkward.count()
        assert T.flag(awkward, labels).where("toxic").count() == 0
    assert T.without_toxic(no_documents, some).count() == 0


def test_threshold():
    assert T.best_threshold(np.array([0.9, 0.8, 0.2, 0.1]), np.array([1, 1, 0, 0.0])) == pytest.approx(0.5)
    assert T.best_threshold(np.zeros(3), np.zeros(3)) > 1


def test_fit_takes_little_of_the_drivers_memory():
    rng = np.random.default_rng(5)
    x = (rng.random((T.MAX_ROWS, 1 + 2 * T.WORDS_PER_CATEGORY)) < 0.1).astype(np.uint8)
    x[:, 0] = 1
    labels = np.column_stack([x[:, 1] | x[:, 2], x[:, 3]]).astype(float)
    tracemalloc.start()
    try:
        weights, _ = T.fit_chain(x, labels, np.arange(len(x)) % T.FOLDS)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 20e6
    assert weights[0][1:3].min() > 2 and weights[1][3] > 2


def test_fit_in_blocks_is_the_fit_of_the_whole(monkeypatch):
    rng = np.random.default_rng(6)
    x = np.column_stack([np.ones(500), rng.integers(0, 2, (500, 4))])
    y = (rng.random(500) < 0.2 + 0.5 * x[:, 2]).astype(float)
    whole = T.fit_linear(x, y)
    monkeypatch.setattr(T, "FIT_ROWS", 7)
    assert np.allclose(T.fit_linear([x[:, :3].astype(np.uint8), x[:, 3:]], y), whole)
    some = np.flatnonzero(x[:, 1] > 0)
    assert np.allclose(T.fit_linear(x, y[some], rows=some), T.fit_linear(x[some], y[some]))
