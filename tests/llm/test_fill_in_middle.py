import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from evalflow.llm import fill_in_middle as M

from .conftest import rows_of

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def brute(doc_id, text):
    """By the list of tokens, without any lanes."""
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    digest = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(t) for t in (tokens[:low], tokens[low:high], tokens[high:]))
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_awkward_rows_equal_brute_force_and_come_back(spark, awkward, no_documents):
    extra = ["a <P> b", "x<", "S>y", "<", "<<S", "\U0001f600ab́ " * 9, "<M", "P>" * 5, "A" * 70_000 + " 1" * 70_000]
    docs = awkward.unionByName(spark.createDataFrame(rows_of(extra, range(200, 200 + len(extra))), awkward.schema))
    docs = docs.withColumn("fim", F.lit("old")).withColumn("form", F.lit("kept"))
    got = M.fill_in_middle(docs)
    assert set(got.columns) == set(docs.columns) and got.select("form").distinct().collect()[0][0] == "kept"
    back = got.withColumn("back", M.restored(F.col("fim.output"), F.col("fim.form")))
    rows = back.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert tuple(r["fim"]) == brute(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")
    assert {r["fim"]["form"] for r in rows} == {"plain", "psm", "spm"}
    assert M.fill_in_middle(no_documents).count() == 0


def test_descents_reach_every_rank(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aB .é\U0001f600") for _ in range(n)) for n in (1, 2, 7, 64, 900, 3)]
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
    lengths = np.array([len(t) for t in texts])
    firsts = np.cumsum(lengths) - lengths
    starts = M.token_starts(points, firsts)
    for spread in (2, 8):
        towers = M.SkipList(starts, len(points), np.searchsorted(starts, firsts), spread)
        assert len(towers.lanes) > 2
        for k, text in enumerate(texts):
            tokens = TOKEN.findall(text)
            assert [towers.reach(k, r) for r in range(len(tokens) + 1)] == [len("".join(tokens[:r])) for r in range(len(tokens) + 1)]


def test_a_descent_takes_few_steps():
    """The lanes hold fewer and fewer towers, so a rank in a long text is not reached token by token."""
    n = 200_000
    towers = M.SkipList(np.arange(n), n, np.array([0]))
    sizes = [len(units) for units, _, _ in towers.lanes]
    assert sizes[-1] == n and sizes[0] < 60 and all(a * 4 < b for a, b in zip(sizes, sizes[1:], strict=False) if a > 200)
    assert towers.reach(0, n - 1) == n - 1 and towers.reach(0, n) == n
