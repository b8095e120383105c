import random

import numpy as np
import pytest

from evalflow.llm import substrings as S
from evalflow.llm.fm_index import Bits, Index, Wavelet


def brute(rows, window=20):
    """Result per (id, text): words covered by a window that was seen before, in the order of ids and text hashes."""
    seen, out = set(), {}
    for key, text in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            content = tuple(words[i : i + window])
            if content in seen:
                gone[i : i + window] = [True] * window
            seen.add(content)
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out[key] = (len(words), len(words) - len(kept), b" ".join(kept).decode())
    return out


def test_rank_structures():
    rng = np.random.default_rng(1)
    symbols = rng.integers(0, 37, 1000)
    bits = Bits((symbols & 1).astype(np.uint8))
    places = np.arange(1001)
    assert bits.ones(places).tolist() == np.concatenate([[0], np.cumsum(symbols & 1)]).tolist()
    wavelet = Wavelet(symbols.copy(), 6)
    for symbol in (0, 5, 36):
        at = np.full(1001, symbol)
        occurrences = wavelet.follow(at, places) - wavelet.follow(at, np.zeros(1001, dtype=np.int64))
        assert occurrences.tolist() == [int((symbols[:p] == symbol).sum()) for p in places]


@pytest.mark.parametrize("symbols,window", [(2, 4), (3, 7), (30, 20), (400, 5)])
def test_index_finds_exactly_the_repeated_windows(symbols, window):
    rng = np.random.default_rng(symbols)
    for _ in range(10):
        sequences = [rng.integers(1, symbols + 1, rng.integers(1, 120)) for _ in range(12)]
        sequences += [s[3:60] for s in sequences[:5]]
        text = np.concatenate([np.append(s, 0) for s in sequences])
        starts = np.cumsum([0, *[len(s) + 1 for s in sequences]])[:-1]
        ends = starts + [len(s) for s in sequences]
        order = np.arange(len(text))
        at, earliest = Index(text, order, window).repeated(text, starts, ends)
        first, count = {}, {}
        for s, e in zip(starts, ends, strict=True):
            for p in range(s, e - window + 1):
                key = tuple(text[p : p + window])
                first.setdefault(key, p)
                count[key] = count.get(key, 0) + 1
        want = {p: first[tuple(text[p : p + window])] for s, e in zip(starts, ends, strict=True) for p in range(s, e - window + 1) if count[tuple(text[p : p + window])] > 1}
        assert dict(zip(at.tolist(), earliest.tolist(), strict=True)) == want


@pytest.mark.parametrize("shard_words", [S.SHARD_WORDS, 200])
def test_equals_brute_force(spark, shard_words):
    rng = random.Random(11)
    passages = [[f"p{rng.randrange(900)}" for _ in range(rng.randrange(15, 80))] for _ in range(6)]
    texts = []
    for _ in range(150):
        words = []
        for _ in range(rng.randrange(1, 5)):
            words += rng.choice(passages) if rng.random() < 0.5 else [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(1, 40))]
        texts.append(" ".join(words))
    texts += ["loop " * 90, "ab cd ef " * 40, "ab cd ef " * 40, texts[3], texts[3], None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in S.deduplicated(df, shard_words=shard_words).collect()}
    assert got == brute(list(enumerate(texts)))


def test_awkward_rows(spark, awkward, no_documents):
    from pyspark.sql import functions as F

    got = S.deduplicated(awkward).collect()
    order = awkward.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).select("doc_id", "text").dropDuplicates().collect()
    order.sort(key=lambda r: (r[0] is not None, r[0]))
    want = brute([(r[0], r[1]) for r in order])
    assert len(got) == awkward.count() and all((r["n_words"], r["n_removed"], r["kept"]) == want[r["doc_id"]] for r in got)
    assert want[6][1] == 300  # its text also stands under the NULL id, which comes first
    assert S.deduplicated(no_documents).count() == 0
