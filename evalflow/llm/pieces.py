"""Token ids by the tokenizers library, one call per distinct piece of text.

Two layouts of a tokenizer's file are known to split a text at white space before any merge, so that the ids of a text are
the ids of its pieces one after the other. A piece is looked up in a cache that lives as long as the Python
worker; only pieces that are not in it go to the library. A text that holds one of the special strings goes to
the library as a whole, since those are cut out before anything else, and so do all texts if the file has another layout.

With the layout that lowers case, words of visible ASCII characters and Latin letters are lowered and parted here as its
pattern does, by array operations over the bytes of many texts. Arrow numbers the parts, so only distinct ones are looked up,
and the library's model merges the new ones in one call, parted again after each id that ends a word. Words with
any other character go to the library one by one.
"""

from __future__ import annotations

import json
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import tokenizers

from evalflow.llm.sparse import spans

# The characters of Unicode's White_Space property, at which the libraries' patterns split.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"

#: A word with the one blank before it; all but the last of several white space characters; a single one.
_SPACED = re.compile(f" ?[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]")
_BARE = re.compile(f"[^{WHITE_SPACE}]+")
#: Letters, then full stops and commas: two pieces for either vocabulary.
_STOPPED = re.compile(r"(.*[A-Za-z])([.,]+)\Z", re.S)

# The normalizer and the pre-tokenizer of the two known layouts.
_KEEPS_BLANKS = (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True})
_LOWERS = (
    {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)

# Plain characters: visible ASCII and the letters of Latin-1 from U+00C0 on. None of the letters changes when normalised, all of
# them are letters to the pattern of _LOWERS, and each is 0xC3 and one byte more.
_PLAIN_BYTES = re.compile(rb"(?:[!-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch
_WHITE, _LETTER, _DIGIT, _SIGN, _ODD = range(5)
_BLANKS = b"\t\n\x0b\x0c\r "


def _kind(byte: int) -> int:
    if byte in _BLANKS:
        return _WHITE
    if bytes([byte]).isalpha() or byte == 0xC3 or 0x80 <= byte < 0xC0:
        return _LETTER
    if bytes([byte]).isdigit():
        return _DIGIT
    return _SIGN if 0x20 < byte < 0x7F else _ODD


#: The kind of every byte; one that goes on a character is of the kind of its first.
_KINDS = bytes(map(_kind, range(256)))

#: Pieces kept by a worker. The first ones are the frequent ones, so a full cache stays as it is; it starts anew
#: when texts have changed so much that STALE pieces were not in it.
CACHE = 1_200_000
STALE = 8_000_000
#: Bytes of texts that are parted together, and new parts that the library merges in one call.
TOGETHER = 8_000_000
MERGED = 20_000


def _as_bytes(text: str) -> str:
    """One character, of the same number, for each byte."""
    return text.encode().decode("latin-1")


class _Pieces(dict):
    """Pieces and their ids. ``known``: the layout under which texts are cut at white space."""

    known: tuple

    def __init__(self, path: str):
        super().__init__()
        self.library = tokenizers.Tokenizer.from_file(path)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as file:
            layout = json.load(file)
        self.cut = (layout.get("normalizer"), layout.get("pre_tokenizer")) == self.known
        self.missed = 0

    def whole(self, text: str) -> bool:
        return not self.cut or any(s in text for s in self.specials)

    def __missing__(self, piece: str):
        ids = self.find(piece)
        if len(self) < CACHE:
            self[piece] = ids
        else:
            self.missed += 1
            if self.missed >= STALE:
                self.clear()
                self.missed = 0
        return ids


class _Counts(_Pieces):
    known = _KEEPS_BLANKS

    def encode(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def find(self, piece: str) -> int:
        if stopped := _STOPPED.match(piece):
            return self[stopped[1]] + self[stopped[2]]
        return self.encode(piece)


class _Ids(_Pieces):
    """Parts and odd words, numbered, with their ids in one array after the other."""

    known = _LOWERS

    def __init__(self, path: str):
        super().__init__(path)
        self.by_part = self.library.model.tokenize
        self.merger = tokenizers.Tokenizer(self.library.model)
        self.merger.pre_tokenizer = tokenizers.pre_tokenizers.CharDelimiterSplit(" ")
        self.last = np.zeros(0, dtype=bool)  # ids that end a part
        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        if self.cut and suffix:
            vocab = self.library.get_vocab(with_added_tokens=False)
            self.last = np.zeros(1 + max(vocab.values()), dtype=bool)
            self.last[[i for piece, i in vocab.items() if piece.endswith(suffix)]] = True
        # A byte stands for itself in the library, but for these of the bytes of letters in lower case.
        self.others: dict[str, str] = {}
        for letter in [chr(c) for c in range(0xC0, 0x100) if self.cut and chr(c).isalpha() and chr(c).islower()]:
            own = self.library.pre_tokenizer.pre_tokenize_str(letter)[0][0]
            self.others |= {x: y for x, y in zip(_as_bytes(letter), own, strict=True) if x != y}
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.missed = 0
        self.ids, self.ends = np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def merged(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts of plain characters in lower case, and where those of each end."""
        joined = b" ".join(parts).decode("latin-1")
        if not joined.isascii():
            for x, y in self.others.items():
                joined = joined.replace(x, y)
        if len(self.last):
            ids = np.array(self.merger.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(parts):
                return ids, ends
        each = [[t.id for t in self.by_part(part)] for part in joined.split(" ")]
        return np.array([i for ids in each for i in ids], dtype="<u4"), np.cumsum([len(ids) for ids in each])

    def learn(self, segments: np.ndarray, all_plain: bool) -> np.ndarray:
        """Enter new segments; returns their numbers."""
        plain = np.full(len(segments), all_plain)
        if not all_plain:
            plain[:] = [_PLAIN_BYTES(s) is not None for s in segments]
        numbers = np.empty(len(segments), dtype=np.int64)
        parts, odd = segments[plain].tolist(), segments[~plain].tolist()
        numbers[plain] = np.arange(len(self), len(self) + len(parts))
        for at in range(0, len(parts), MERGED):
            some = parts[at : at + MERGED]
            self.enter(some, *self.merged(some))
        numbers[~plain] = np.arange(len(self), len(self) + len(odd))
        if odd:
            found = [np.concatenate([self.encode(w) for w in _BARE.findall(s.decode())] or [self.ids[:0]]) for s in odd]
            self.enter(odd, np.concatenate(found), np.cumsum([len(ids) for ids in found]))
        return numbers

    def enter(self, segments: list[bytes], ids: np.ndarray, ends: np.ndarray) -> None:
        self.update(zip(segments, range(len(self), len(self) + len(segments)), strict=True))
        self.ids, self.ends = np.append(self.ids, ids), np.append(self.ends, self.ends[-1] + ends)

    def forget(self) -> None:
        """Back to CACHE segments, or none at all if there was much to forget."""
        more = len(self) - CACHE
        if more > 0:
            for _ in range(more):
                self.popitem()
            self.ends = self.ends[: CACHE + 1]
            self.ids = self.ids[: self.ends[-1]]
            self.missed += more
            if self.missed >= STALE:
                self.clear()

    def of_segments(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each of them has."""
        segments, numbers, all_plain = _segments(raw)
        coded = segments.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False)
        which = np.fromiter(map(self.get, distinct.tolist(), repeat(-1)), dtype=np.int64, count=len(distinct))
        new = np.flatnonzero(which < 0)
        if len(new):
            which[new] = self.learn(distinct[new], all_plain)
        # The ids of the distinct ones side by side are few enough to stay at hand.
        begin, width = self.ends[which], self.ends[which + 1] - self.ends[which]
        near, begin = self.ids[spans(begin, width)], np.cumsum(width) - width
        self.forget()
        at = coded.indices.to_numpy()
        width = width[at]
        ids = near[spans(begin[at], width)]
        return ids, np.diff(np.append(0, np.cumsum(width))[numbers])

    def of_texts(self, raw: list[bytes]) -> list[np.ndarray]:
        specials = [s.encode() for s in self.specials]
        found: list[np.ndarray] = [self.ids[:0]] * len(raw)
        parted, held = [], 0
        for k, own in enumerate(raw):
            if not self.cut or any(s in own for s in specials):
                found[k] = self.encode(own.decode())
                continue
            parted.append(k)
            held += len(own)
            if held >= TOGETHER:
                self._fill(found, raw, parted)
                parted, held = [], 0
        if parted:
            self._fill(found, raw, parted)
        return found

    def _fill(self, found: list[np.ndarray], raw: list[bytes], places: list[int]) -> None:
        ids, counts = self.of_segments([raw[k] for k in places])
        ends = np.cumsum(counts)
        for k, end, n in zip(places, ends.tolist(), counts.tolist(), strict=True):
            found[k] = ids[end - n : end]


def _segments(raw: list[bytes]) -> tuple[pa.BinaryArray, np.ndarray, bool]:
    """The parts of plain words in lower case and the odd words of all texts, the number of them before each text and in all,
    and whether no word is odd. A word is odd if it holds a byte that is none of a plain character."""
    # Three bytes of white space behind the last text: contractions look ahead.
    joined = b"\n".join([b"", *raw, b"\n\n"])
    data, kinds = np.frombuffer(joined, dtype=np.uint8), np.frombuffer(joined.translate(_KINDS), dtype=np.uint8)
    lower = np.frombuffer(bytearray(joined.lower()), dtype=np.uint8)  # bytes.lower() changes A-Z alone
    seconds = np.flatnonzero(data == 0xC3) + 1
    at = seconds[(data[seconds] < 0x9F) & (data[seconds] != 0x97)]
    lower[at] += 0x20
    shown = kinds != _WHITE
    begins = np.zeros(len(data), dtype=bool)
    np.not_equal(kinds[1:], kinds[:-1], out=begins[1:])
    begins |= kinds == _DIGIT
    begins &= shown
    # An apostrophe that begins signs and a contraction behind it are one part.
    at = np.flatnonzero((data == 0x27) & begins)
    if len(at):
        one, two = lower[at + 1], lower[at + 2]
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        short = (one == ord("s")) | (one == ord("t")) | (one == ord("m")) | (one == ord("d"))
        at, behind = at[long | short], (at + 2 + long)[long | short]
        begins[at + 1] = False
        begins[behind] |= kinds[behind] == _LETTER
    odd = np.append(np.flatnonzero(kinds == _ODD), seconds[(data[seconds] == 0x97) | (data[seconds] == 0xB7)])
    if len(odd):
        blanks = np.flatnonzero(~shown)
        after = np.unique(np.searchsorted(blanks, odd))
        first, ends = blanks[after - 1] + 1, blanks[after]
        inside = spans(first, ends - first)
        begins[inside] = False
        begins[first] = True
        lower[inside] = data[inside]
    bounds = np.cumsum([1] + [len(r) + 1 for r in raw])
    starts = np.flatnonzero(begins)
    numbers = np.searchsorted(starts, bounds)
    # White space is left out: a part ends before it, or where the next one begins.
    begins |= ~shown
    lengths = np.flatnonzero(begins[1:] & shown[:-1]) + 1 - starts
    kept = lower.tobytes().translate(None, _BLANKS)
    offsets = pa.py_buffer(np.append(0, np.cumsum(lengths)).astype(np.int32))
    return pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, offsets, pa.py_buffer(kept)]), numbers, not len(odd)


def _of_worker(kind: type, path: str) -> _Pieces:
    # Functions shipped with a task get new globals each time; the library's module stays.
    kept = tokenizers.__dict__.setdefault("_evalflow_pieces", {})
    key = (kind.__name__, path)
    if key not in kept:
        kept[key] = kind(path)
    return kept[key]


def token_counter(path: str):
    """A function from a text to its number of tokens; quick for a byte-level vocabulary that keeps blanks."""
    pieces = _of_worker(_Counts, path)
    look = pieces.__getitem__

    def count(text: str) -> int:
        if pieces.whole(text):
            return pieces.encode(text)
        return sum(map(look, _SPACED.findall(text)))

    return count


def ids_of_texts(path: str):
    """A function from texts in UTF-8 to the ids of each, as little-endian 32-bit numbers; quick for a vocabulary that lowers case
    and drops white space."""
    return _of_worker(_Ids, path).of_texts


def token_ids(path: str):
    """The same from one text to the bytes of its ids."""
    find = ids_of_texts(path)
    return lambda text: find([text.encode()])[0].tobytes()
