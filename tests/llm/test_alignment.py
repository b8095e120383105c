import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from evalflow.llm import alignment as A
from evalflow.llm import segment_ids as S
from evalflow.llm import sparse

from .conftest import words

A_PATH, B_PATH = public_tokenizers.path(A.BYTE_LEVEL), public_tokenizers.path(A.SENTENCE_PIECES)
TEXTS = [
    " a  b ", "\n\nx\t y", " ", "   ", "a ", "▁x", "naïve café 数学 \U0001f600\U0001f600 ﬁ", "<s> hi <|endoftext|> <0x41>", "don't we'll",
    "x" * 300, " " * 200 + "y", "\x00\x1c a\xa0b　c", "12345 678,90.00 -- ##", "a\r\n\r\n b", "it's\n   so   \n", "é ​‍",
]


def brute_tokens(text):
    """Ids and bytes of both sides by the libraries, whole texts."""
    if not text:
        return [], [], [], []
    a = tokenizers.Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [x for x in range(256) if x not in printable]
    chars = {chr(x): x for x in printable} | {chr(256 + k): x for k, x in enumerate(other)}
    a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    a_raw = [bytes(chars[c] for c in a.id_to_token(i)) for i in a_ids]
    b_raw = [
        bytes([int(p[3:5], 16)]) if len(p := b.id_to_piece(i)) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
        for i in b_ids
    ]
    if not b"".join(a_raw) == b"".join(b_raw) == (" " + text).encode():
        return [], [], [], []
    return a_ids, b_ids, np.cumsum([len(x) for x in a_raw]).tolist(), np.cumsum([len(x) for x in b_raw]).tolist()


def brute(rows):
    tokens = {i: brute_tokens(t) for i, t in rows}
    links = {i: [(x, y) for x, e in zip(a, ea) for y, f in zip(b, eb) if e == f] for i, (a, b, ea, eb) in tokens.items()}
    counts = Counter(p for ls in links.values() for p in ls)
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(n, best.get(y, 0))
    out = {}
    for i, (a, b, ea, eb) in tokens.items():
        cuts = sorted(set(ea) & set(eb))
        groups, low = [], 0
        for cut in cuts:
            sides = [",".join(str(x) for x, e in zip(ids, ends) if low < e <= cut) for ids, ends in ((a, ea), (b, eb))]
            groups.append("|".join(sides))
            low = cut
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        pairs = links[i]
        out[i] = (len(a), len(b), len(cuts), len(pairs), sum(counts[p] == best[p[1]] for p in pairs), sum(counts[p] for p in pairs), sha)
    return out


def test_figures_equal_brute_force(spark, awkward, no_documents, monkeypatch):
    monkeypatch.setattr(A, "RUN_BYTES", 3000)
    awkward = awkward.where("doc_id is null or doc_id <> 13").select("doc_id", "text")  # 20,000 words: too slow by brute force
    docs = awkward.unionByName(spark.createDataFrame(list(enumerate(TEXTS, 300)), "doc_id long, text string"))
    rows = [tuple(r) for r in docs.collect()]
    # Equal rows count twice in the corpus: brute force by place, not by id.
    want = brute(list(enumerate(t for _, t in rows)))
    want = sorted((repr(rows[k][0]), *w) for k, w in want.items())
    got = A.alignment_figures(docs, A_PATH, B_PATH)
    assert sorted((repr(r[0]), *tuple(r)[1:]) for r in got.collect()) == want
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert A.alignment_figures(no_documents, A_PATH, B_PATH).count() == 0
    assert A.alignment_figures(docs.where("text is null or text = ''"), A_PATH, B_PATH).agg(F.sum("n_links")).first()[0] == 0


@pytest.mark.parametrize("kind", A.KINDS)
def test_links_of_every_kind(spark, kind):
    docs = spark.createDataFrame(list(enumerate([*TEXTS, None, "", " ".join(words(1, 60))])), "doc_id long, text string")
    for r in A.alignments(docs, A_PATH, B_PATH, kind).collect():
        text = dict(enumerate([*TEXTS, None, "", " ".join(words(1, 60))]))[r["doc_id"]]
        a, b, ea, eb = brute_tokens(text)
        assert (r["a_ids"], r["b_ids"]) == (a, b)
        assert (sum(r["group_a"]), sum(r["group_b"]), len(r["group_a"])) == (len(a), len(b), len(set(ea) & set(eb)))
        cuts = sorted(set(ea) & set(eb))
        want = []
        for i, (s, e) in enumerate(zip([0, *ea[:-1]], ea)):
            for j, (t, f) in enumerate(zip([0, *eb[:-1]], eb)):
                shared = min(e, f) - max(s, t)
                one_group = sum(c < e for c in cuts) == sum(c < f for c in cuts)
                if kind == "bytes" and shared > 0:
                    want.append((i, j, shared))
                elif (kind == "ends" and e == f) or (kind == "groups" and one_group):
                    want.append((i, j, 1))
        assert [tuple(x) for x in r["links"]] == want
    with pytest.raises(ValueError):
        A.alignments(docs, A_PATH, B_PATH, "words")


def test_products_equal_dense_ones():
    rng = np.random.default_rng(1)

    def matrix(rows, cols):
        dense = rng.integers(0, 4, (rows, cols)) * (rng.random((rows, cols)) < 0.3)
        starts = np.append(0, np.cumsum((dense != 0).sum(axis=1)))
        return dense, sparse.Csr(starts, np.nonzero(dense)[1], dense[dense != 0], cols)

    for rows, inner, cols in ((1, 1, 1), (7, 5, 9), (30, 40, 20), (3, 60, 2), (4, 1, 4)):
        (x, a), (y, b) = matrix(rows, inner), matrix(inner, cols)
        for most in (1, 50, 10**6):
            got = np.zeros((rows, cols), dtype=np.int64)
            for r, c, v in sparse.product_rows(a, b, most):
                got[r, c] += v
            assert (got == x @ y).all()
        r, c, v = sparse.product(a, b).triples()
        assert (np.lexsort((c, r)) == np.arange(len(r))).all() and v.sum() == (x @ y).sum()
        r, c, v = a.transposed().triples()
        assert (x.T[r, c] == v).all() and len(v) == (x != 0).sum()


def test_segments_give_the_ids_of_whole_texts():
    rng = random.Random(5)
    alphabet = ["a", "b", "the", "'s", " ", "  ", "\n", "\t", ".", "1", "é", "\U0001f600", "数", "▁", "\xa0", "ing", "<s>", " caf", " été", "ñ ", "\u2003", "\x85"]
    texts = [" " + "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40))) for _ in range(600)]
    a = tokenizers.Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    for coder, whole in ((S.byte_level(A_PATH), lambda t: a.encode(t, add_special_tokens=False).ids), (S.sentence_pieces(B_PATH), lambda t: b.encode(t[1:]))):
        assert coder.breaks is not None
        coder.kept = 50  # starts anew in between
        assert max(map(len, coder.shown)) > 4
        for at in range(0, 600, 100):
            ids, counts, good = coder([t.encode() for t in texts[at : at + 100]])
            want = [whole(t) for t in texts[at : at + 100]]
            assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]


def test_other_layouts_get_whole_texts(tmp_path):
    import json

    layout = json.load(open(A_PATH))
    layout["normalizer"] = {"type": "Lowercase"}
    other = tmp_path / "other.json"
    other.write_text(json.dumps(layout))
    coder = S.byte_level(str(other))
    assert coder.breaks is None
    ids, counts, good = coder([b" Some Text", b"", b" more"])
    assert good.tolist() == [False, True, True]
    want = tokenizers.Tokenizer.from_file(str(other)).encode_batch([" Some Text", "", " more"], add_special_tokens=False)
    assert ids.tolist() == [i for w in want for i in w.ids] and counts.tolist() == [len(w.ids) for w in want]
