"""Small tables with the awkward cases every operator has to define."""

import random

import pytest
from pyspark import cloudpickle

import evalflow

cloudpickle.register_pickle_by_value(evalflow)

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, key string, spans string"


def words(seed, n, vocabulary=4000):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def rows_of(texts, ids=None):
    """Rows with extra columns whose names clash with those the operators use."""
    ids = range(len(texts)) if ids is None else ids
    return [(i, t, "en", f"s{k % 3}" if k % 5 else None, None, k, "x", "y", "z") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]


@pytest.fixture(scope="session")
def awkward_texts():
    base = words(1, 300)
    near = list(base)
    near[150] = "other"
    passage = words(2, 60)
    return [
        None, "", "   \t\n ", "one", "two words", "a b c d", " ".join(base), " ".join(base), " ".join(near), " ".join(near[:-1]),
        " ".join(words(3, 40) + passage + words(4, 40)), " ".join(words(5, 30) + passage), "the same word " * 400,
        " ".join(words(6, 20_000)), "x" * 50_000, "Straße ÄÖÜ   \x1c naïve café 数学 \U0001f600 " * 3, "1 2 3 4", "a\x0bb\x0cc d e",
    ]


@pytest.fixture(scope="session")
def awkward(spark, awkward_texts):
    """NULLs, empty, blank, long and repeated texts, a NULL id, equal rows, and clashing extra columns."""
    rows = rows_of(awkward_texts)
    rows += [(None, awkward_texts[6], None, None, None, None, None, None, None)]
    rows += [(100, "tie tie tie tie tie", "de", "s9", 1, 1, "x", "y", "z")] * 2
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)
