import json
import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from evalflow.llm import pieces as P
from evalflow.llm import range_coder as R
from evalflow.llm import token_files as T
from evalflow.llm.pieces import token_counter, token_ids
from evalflow.staging import stage_path

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.mark.parametrize("n,vocabulary", [(0, 10), (1, 1), (5, 49408), (4096, 49408), (10_000, 300), (3000, 131_072), (2000, 1)])
@pytest.mark.parametrize("block", [4096, 100])
def test_round_trip(n, vocabulary, block):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n) - 1, vocabulary - 1).astype(np.uint32)
    blocks = R.encode(ids, vocabulary, block)
    assert len(blocks) == -(-n // block) and (R.decode(b"".join(blocks)) == ids).all()
    # Every block stands alone.
    for k in range(0, len(blocks), 7):
        assert (R.decode(blocks[k]) == ids[k * block : (k + 1) * block]).all()


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 999), max_size=400))
def test_any_ids_come_back(values):
    ids = np.array(values, dtype=np.uint32)
    assert (R.decode(b"".join(R.encode(ids, 1000, 64))) == ids).all()


def test_predictable_ids_take_little_room():
    ids = np.tile(np.arange(50, dtype=np.uint32), 200)
    assert len(b"".join(R.encode(ids, 49408))) < 0.25 * ids.nbytes


def test_damage_is_noticed():
    data = b"".join(R.encode(np.arange(3000, dtype=np.uint32), 49408, 1000))
    for at in (0, 5, 14, 30, len(data) // 2, len(data) - 1):
        with pytest.raises(R.BlockError):
            R.decode(data[:at] + bytes([data[at] ^ 0x55]) + data[at + 1 :])
    with pytest.raises(R.BlockError):
        R.decode(data[:-3])
    with pytest.raises(ValueError):
        R.encode(np.array([9], dtype=np.uint32), 9)


TEXTS = [
    "Hello, world. It's 5 o'clock... can't you?", "a  b   c\n\n d\t\te ", "\n", " ", "  lead", "trail  ", "x y z 　 w", "foo\x1cbar \x1f baz",
    "ÀÉ naïve ẞ straße ΑΣ σας", "數學 \U0001f600 é ́x", "see <|endoftext|> here", "UPPER Case. Dot., end.,", "a<|startoftext|>b  <|endoftext|>", "1,2.3 4..5 ...", "don't. 'tis, 'S.",
]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB.,'s \n\t \x1céΣσ1<|endoftx>-", max_size=40))
def test_ids_are_those_of_the_library(text):
    _same(text)


@pytest.mark.parametrize("text", TEXTS)
def test_ids_of_chosen_texts(text):
    _same(text)


_LIBRARY = {p: tokenizers.Tokenizer.from_file(p) for p in (BYTES, WORDS)}


def _same(text):
    assert token_counter(BYTES)(text) == len(_LIBRARY[BYTES].encode(text, add_special_tokens=False).ids)
    assert np.frombuffer(token_ids(WORDS)(text), "<u4").tolist() == _LIBRARY[WORDS].encode(text, add_special_tokens=False).ids


def test_files(spark, awkward, no_documents):
    path = stage_path(spark, "token-test")
    T.write_tokens(awkward, path, WORDS, run_ids=700)
    got = T.read_tokens(spark, path).collect()
    rows = sorted(awkward.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0]))
    assert len(got) == len(rows)
    start = 0
    for r, (doc_id, text) in zip(sorted(got, key=lambda r: r["start"]), rows, strict=True):
        ids = np.array([*_LIBRARY[WORDS].encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (doc_id, start, len(ids))
        assert bytes(r["ids"]) == ids.tobytes() and r["ids_crc32"] == zlib.crc32(ids.tobytes())
        start += len(ids)
    empty = stage_path(spark, "token-test")
    T.write_tokens(no_documents, empty, WORDS)
    assert T.read_tokens(spark, empty).count() == 0


def test_every_letter_of_latin_1_has_the_ids_of_the_library():
    library, find = tokenizers.Tokenizer.from_file(WORDS), token_ids(WORDS)
    letters = [chr(c) for c in range(0xC0, 0x100)]
    for word in (*letters, *[f"a{x}b{x}'s1" for x in letters], "".join(letters), "àíß", "ÀÍẞ"):
        expected = np.array(library.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert find(word) == expected, word


def test_quotients_of_the_decoder_are_exact():
    rng = np.random.default_rng(8)
    by = rng.integers(1, 1 << 11, 200_000).astype(np.int32)
    whole = rng.integers(0, (1 << 29) // by)
    for more in (0, 1, by - 1):  # at and beside whole multiples
        of = (whole * by + np.minimum(more, by - 1)).astype(np.int32)
        assert ((of / by).astype(np.int32) == of // by).all()


def test_new_parts_are_merged_by_few_calls():
    class Counted:
        def __init__(self, library):
            self.library, self.calls = library, 0

        def encode_batch_fast(self, *args, **more):
            self.calls += 1
            return self.library.encode_batch_fast(*args, **more)

    finder = P._Ids(WORDS)
    finder.merger, finder.by_part = Counted(finder.merger), None
    texts = [" ".join(f"{a}q{b}x, {a}É{b}'s" for b in "abcdefghij") for a in ("ka", "lo", "mü", "n")]
    for _ in range(2):  # the second time nothing is new
        _all_same(finder, texts)
        assert finder.merger.calls == 1


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(alphabet="aBrevlLtS.,'  \n\t\x1c\x85 éÉ×÷ß̱Hσ1<|>\x00", max_size=30), max_size=12))
def test_ids_of_texts_together(texts, monkeypatch):
    """With few parts kept, few texts at a time and few parts in a call."""
    for name, value in (("CACHE", 6), ("STALE", 15), ("TOGETHER", 40), ("MERGED", 3)):
        monkeypatch.setattr(P, name, value)
    finder = P._Ids(WORDS) if not _FINDERS else _FINDERS[0]
    _FINDERS[:] = [finder]
    _all_same(finder, [*texts, *TEXTS, *texts])
    assert len(finder) <= 6


_FINDERS = []


def _all_same(finder, texts):
    for text, ids in zip(texts, finder.of_texts([t.encode() for t in texts]), strict=True):
        assert ids.tolist() == _LIBRARY[WORDS].encode(text, add_special_tokens=False).ids, text


def test_carries_run_through_settled_digits():
    digits, none = np.zeros(12, dtype=np.uint32), np.zeros((3, 2), dtype=bool)
    tops = np.array([[0xFFFF0001, 0x00050006], [0xFFFF0002, 0x00070008], [0x00030004, 0x0009000A]], dtype=np.uint64)
    place = R._write_digits(digits, np.array([1, 7]), tops, none, np.array([[1, 2], [2, 0], [0, 1]], dtype=np.int8))
    assert digits.tolist() == [0, 0xFFFF, 0xFFFF, 2, 0, 0, 0, 5, 6, 9, 0, 0] and place.tolist() == [4, 10]
    carries = np.array([[True, False], [True, False], [False, True]])
    place = R._write_digits(digits, place, tops, carries, np.array([[0, 0], [1, 0], [0, 1]], dtype=np.int8))
    assert digits.tolist() == [0, 0xFFFF, 0xFFFF, 4, 0xFFFF, 0, 0, 5, 6, 10, 9, 0] and place.tolist() == [5, 11]


def test_blocks_are_coded_as_before():
    """Written files stay readable: the sum is that of the coder's first blocks."""
    ids = np.minimum(np.random.default_rng(5).zipf(1.2, 60_000) - 1, 49_407).astype(np.uint32)
    assert zlib.crc32(b"".join(R.encode(np.concatenate([ids, ids[:20_000]]), 49_408, 700))) == 1837614438


@pytest.mark.parametrize("where,value", [("normalizer", None), ("pre_tokenizer", {"type": "WhitespaceSplit"})])
def test_texts_of_another_layout_go_whole_to_the_library(tmp_path, where, value):
    with open(WORDS, encoding="utf-8") as file:
        layout = json.load(file)
    layout[where] = value
    path = tmp_path / "changed.json"
    path.write_text(json.dumps(layout), encoding="utf-8")
    library, finder = tokenizers.Tokenizer.from_file(str(path)), P._Ids(str(path))
    for text, ids in zip(TEXTS, finder.of_texts([t.encode() for t in TEXTS]), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text
    assert not finder


def test_parts_without_an_end_mark_are_merged_one_by_one():
    finder = P._Ids(WORDS)
    finder.last = finder.last[:0]
    _all_same(finder, [*TEXTS, "word, wörd's wordword 12"])
