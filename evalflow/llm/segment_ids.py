"""Ids of many texts at once, put together from the ids of their segments.

Where a tokenizer never merges across certain places, the ids of a text are those of its segments one after the other, and a
segment is encoded once per task. Segments are found by array operations over the bytes of a run of texts and numbered
by Arrow, so only distinct ones are handled one by one. Whether there are such places is read from the
tokenizer's own file; a file of any other layout gets whole texts.

* A byte-level vocabulary of the tokenizers library whose pre-tokenizer is the usual byte-level pattern, without a
  normalizer: its pattern parts a text before a single blank between two visible characters.
* A sentencepiece vocabulary none of whose pieces has the blank's sign after another character: it parts a text before a
  blank that follows another character.

Fewer places than there are only make segments longer, so a place counts where the bytes beside the blank tell it for certain.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa

from evalflow.llm.sparse import spans

#: Segments that a task keeps; it starts anew beyond that, before a new run of texts.
KEPT = 250_000

_BLANK = "▁"


def _visible(data: np.ndarray) -> np.ndarray:
    """Bytes of visible ASCII characters."""
    return (data > 0x20) & (data < 0x7F)


def _lead(data: np.ndarray) -> np.ndarray:
    """First bytes of two-byte characters from U+00C0 on, none of which is white space."""
    return (data >= 0xC3) & (data < 0xE0)


def single_blanks(data: np.ndarray) -> np.ndarray:
    """Blanks with a visible character on either side."""
    found = np.zeros(len(data), dtype=bool)
    if len(data) > 2:
        after = _visible(data[:-2])
        after[1:] |= _lead(data[:-3])
        found[1:-1] = (data[1:-1] == 0x20) & after & (_visible(data[2:]) | _lead(data[2:]))
    return found


def first_blanks(data: np.ndarray) -> np.ndarray:
    """Blanks after a character that is neither a blank nor, by its last byte, perhaps the blank's sign."""
    found = np.zeros(len(data), dtype=bool)
    found[1:] = (data[1:] == 0x20) & (data[:-1] != 0x20) & (data[:-1] != _BLANK.encode()[-1])
    return found


class SegmentIds:
    """``breaks`` marks the bytes that begin a segment (None: whole texts), ``encode`` gives the ids of segments,
    ``shown`` has the bytes of every id."""

    def __init__(
        self,
        breaks: Callable[[np.ndarray], np.ndarray] | None,
        encode: Callable[[list[str]], list[list[int]]],
        shown: list[bytes],
        kept: int = KEPT,
    ):
        self.breaks, self.encode, self.shown, self.kept = breaks, encode, shown, kept
        self.widths = np.array([len(b) for b in shown], dtype=np.int32)
        self._clear()

    def _clear(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.ids = np.zeros(0, dtype=np.int32)
        self.ends = np.zeros(1, dtype=np.int64)
        self.good = np.zeros(0, dtype=bool)

    def _learn(self, segments: list[bytes]) -> None:
        found = self.encode([s.decode() for s in segments])
        at = len(self.good)
        self.numbers.update(zip(segments, range(at, at + len(segments)), strict=True))
        self.ids = np.append(self.ids, np.fromiter((i for ids in found for i in ids), dtype=np.int32))
        self.ends = np.append(self.ends, self.ends[-1] + np.cumsum([len(ids) for ids in found]))
        same = [b"".join([self.shown[i] for i in ids]) == s for ids, s in zip(found, segments, strict=True)]
        self.good = np.append(self.good, same)

    def __call__(self, raw: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, how many each text has, and whether they give back its bytes."""
        if self.breaks is None or len(self.numbers) > self.kept:
            self._clear()
        joined = b"".join(raw)
        lengths = np.array([len(r) for r in raw], dtype=np.int64)
        data = np.frombuffer(joined, dtype=np.uint8)
        begins = np.zeros(len(data), dtype=bool) if self.breaks is None else self.breaks(data)
        first = (np.cumsum(lengths) - lengths)[lengths > 0]
        begins[first] = True
        starts = np.flatnonzero(begins)
        offsets = pa.py_buffer(np.append(starts, len(data)).astype(np.int32).tobytes())
        segments = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, offsets, pa.py_buffer(joined)])
        coded = segments.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        missing = [s for s in distinct if s not in self.numbers]
        if missing:
            self._learn(missing)
        numbers = np.array([self.numbers[s] for s in distinct], dtype=np.int64)[coded.indices.to_numpy()]
        begin, width = self.ends[numbers], self.ends[numbers + 1] - self.ends[numbers]
        # Segments per text, then sums over them.
        bounds = np.searchsorted(starts, np.append(0, np.cumsum(lengths)))
        tokens, bad = (np.append(0, np.cumsum(x))[bounds] for x in (width, ~self.good[numbers]))
        return self.ids[spans(begin, width)], np.diff(tokens), np.diff(bad) == 0


def byte_level(path: str) -> SegmentIds:
    """Ids by a file of the tokenizers library, special strings being plain text."""
    import tokenizers

    with open(path, encoding="utf-8") as file:
        layout = json.load(file)
    library = tokenizers.Tokenizer.from_file(path)
    library.encode_special_tokens = True
    before = layout.get("pre_tokenizer") or {}
    usual = (
        before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        and not layout.get("normalizer") and all(t["special"] for t in layout.get("added_tokens", []))
    )

    def encode(segments: list[str]) -> list[list[int]]:
        return [library.encode(s, add_special_tokens=False).ids for s in segments]

    # The byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    value = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    table = [b""] * library.get_vocab_size()
    for piece, i in library.get_vocab().items():
        known = all(c in value for c in piece)
        table[i] = bytes(value[c] for c in piece) if known else piece.encode()
    return SegmentIds(single_blanks if usual else None, encode, table)


def sentence_pieces(path: str) -> SegmentIds:
    """Ids by a sentencepiece file of texts that begin with the one blank it adds itself."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [library.id_to_piece(i) for i in range(library.get_piece_size())]
    table = [
        bytes([int(n[3:5], 16)]) if library.is_byte(i) else n.replace(_BLANK, " ").encode() for i, n in enumerate(names)
    ]
    separable = not any(_BLANK in n.lstrip(_BLANK) for n in names)
    probe = "a  b \n c."
    plain = "".join(names[i] for i in library.encode(probe) if not library.is_byte(i)) == _BLANK + "a  b  c.".replace(" ", _BLANK)

    def encode(texts: list[str]) -> list[list[int]]:
        # A lone blank is the text's last character; the library would take it for an empty text.
        found = library.encode([t[1:] for t in texts], num_threads=1)
        return [[library.piece_to_id(_BLANK)] if t == " " else ids for t, ids in zip(texts, found, strict=True)]

    return SegmentIds(first_blanks if separable and plain else None, encode, table)
