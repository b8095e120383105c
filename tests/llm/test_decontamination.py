import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evalflow.llm import decontamination as D

from .conftest import DOCUMENTS, rows_of, words

_WORD = re.compile(r"[^\W_]+")


def brute(docs, items, least=0.8):
    """Every aligned window of every item compared with every document."""
    found = {}
    for d, text in docs:
        w = _WORD.findall((text or "").lower())
        for i, item in items:
            v = _WORD.findall((item or "").lower())
            if not v:
                continue
            k = min(5, len(v))
            bag = Counter(tuple(v[j : j + k]) for j in range(len(v) - k + 1))
            shingles = [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]
            m = len(v) - k + 1
            for p in range(max(1, len(shingles) - m + 1)):
                mine = Counter(shingles[p : p + m])
                common = sum((bag & mine).values())
                share = common / (m + sum(mine.values()) - common)
                if share >= least:
                    found[(d, i)] = max(found.get((d, i), 0), share)
    return found


@pytest.fixture(scope="module")
def case(spark, awkward_texts):
    items = [" ".join(words(50 + k, 14 + 9 * k)) for k in range(6)] + [None, "", "three short words", awkward_texts[7][:200]]
    dropped = items[5].split()
    dropped[3] = "changed"
    texts = [
        *awkward_texts,
        " ".join(words(60, 200)) + " " + items[0].upper().replace(" ", ", ") + ". " + " ".join(words(61, 30)),
        items[3],
        "before " + " ".join(dropped) + " after",
        " ".join(items[4].split()[:15]),
        "these three short words and no more",
        items[1] + " and " + items[2] + " and " + items[1],
    ]
    docs = spark.createDataFrame(rows_of(texts), DOCUMENTS)
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id long, text string, doc_id int")
    return docs, bench, list(enumerate(texts)), list(enumerate(items))


def test_leaks_equal_brute_force(case):
    docs, bench, texts, items = case
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in D.leaks(docs, bench).collect()}
    want = brute(texts, items)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert len(got) >= 6


def test_clean_documents_stay_with_all_columns(case):
    docs, bench, texts, items = case
    kept = D.decontaminated(docs, bench)
    assert kept.columns == docs.columns
    assert {r[0] for r in kept.select("doc_id").collect()} == {d for d, _ in texts} - {d for d, _ in brute(texts, items)}


def test_blocks_find_every_pair_within_the_radius(spark):
    near = spark.range(300).select(F.col("id").alias("a"), F.xxhash64("id").alias("fingerprint"))
    flips = F.lit(0).cast("long")
    for k in range(15):  # up to 15 distinct bits
        flips = flips.bitwiseOR(F.when(F.col("id") % 16 > k, F.shiftleft(F.lit(1).cast("long"), (k * 17 + 3) % 64)).otherwise(0))
    items = spark.range(40).select(F.col("id").alias("b"), F.xxhash64("id").bitwiseXOR(flips).alias("fingerprint"))
    got = {tuple(r) for r in D.within_radius(near, items, 15).select("a", "b").collect()}
    x, y = ({r[0]: r[1] for r in df.collect()} for df in (near, items))
    want = {(a, b) for a in x for b in y if ((x[a] ^ y[b]) & (1 << 64) - 1).bit_count() <= 15}
    assert got == want and len(want) >= 40


def test_repeated_rows_and_ids(spark, awkward, case):
    _, bench, _, items = case
    extra = spark.createDataFrame([(100, items[4][1]), (None, items[4][1])] * 2, "doc_id long, text string")
    found = D.leaks(awkward.select("doc_id", "text").union(extra), bench).where("item_id = 4")
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in found.collect()) == [(False, 100), (True, None)]


def test_items_of_one_id_or_none(spark):
    items = [(1, " ".join(words(80 + k, 30))) for k in range(3)] + [(None, " ".join(words(90, 30)))]
    texts = [" ".join(words(95 + k, 20)) + " " + item for k, (_, item) in enumerate(items)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in D.leaks(docs, bench).collect()}
    assert got == {(0, 1): 1.0, (1, 1): 1.0, (2, 1): 1.0, (3, None): 1.0}
    assert D.decontaminated(docs, bench).count() == 0


def test_empty_tables(spark, awkward, no_documents, case):
    bench = case[1]
    assert D.leaks(no_documents, bench).count() == 0
    assert D.leaks(awkward, bench.limit(0)).count() == 0
    assert D.decontaminated(awkward, bench.limit(0)).count() == awkward.count()
