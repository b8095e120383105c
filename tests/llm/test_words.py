import numpy as np
import pyarrow as pa
import pytest

from evalflow.llm import words


@pytest.mark.parametrize("slice_bytes", [1 << 20, 50, 3])
def test_word_hashes_follow_bytes_split(awkward_texts, monkeypatch, slice_bytes):
    texts = awkward_texts if slice_bytes > 3 else awkward_texts[:12]
    monkeypatch.setattr(words, "SLICE", slice_bytes)
    for fold in (False, True):
        hashes, bounds = words.word_hashes(pa.array(texts, pa.string()), fold)
        split = [(t or "").encode() for t in texts]
        split = [(s.lower() if fold else s).split() for s in split]
        assert np.diff(bounds).tolist() == [len(s) for s in split]
        seen = {}
        for word, found in zip([w for s in split for w in s], hashes.tolist(), strict=True):
            assert seen.setdefault(word, found) == found
        assert len(set(seen.values())) == len(seen)


def test_shingle_sets(awkward_texts):
    hashes, bounds = words.word_hashes(pa.array(awkward_texts, pa.string()))
    sets = list(words.shingle_sets(hashes, bounds, 4))
    for text, found in zip(awkward_texts, sets, strict=True):
        split = (text or "").encode().split()
        want = {tuple(split[i : i + 4]) for i in range(len(split) - 3)} or ({tuple(split)} if split else set())
        assert len(found) == len(want)


def test_pieces_cover_the_batch(awkward_texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(awkward_texts))), pa.array(awkward_texts, pa.string())], names=["i", "text"])
    parts = list(words.pieces(batch.slice(2), most=100))
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(2, len(awkward_texts)))
