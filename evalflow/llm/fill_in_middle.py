"""Fill-in-the-middle rows: prefix, middle and suffix of a text, cut at ranks of its tokens, in one of two orders.

The tokens of a batch are the towers of an indexable skip list. Its lowest lane holds every token; a tower reaches one
lane higher with probability 1 / SPREAD, drawn from a hash of its place, and the first token of a text reaches all
lanes, so each text is a list of its own. Every lane carries, for each tower, the width to the next one in units
(tokens) and in code points. To find where the unit of a given rank begins, a descent goes along the top lane as long
as the accumulated units do not pass the rank, then one lane down, and so on: the accumulated code points
are the exact place of the cut, after some SPREAD steps per lane, whatever the length of the text. Lanes are built
over runs of rows with about 8 MB of text by array operations; a text never leaves its row.

Defined results: a NULL text is an empty one. A NULL id draws like the text ``null``. Equal rows give equal results. Texts that
hold a marker stay plain, so that every output can be taken apart again. A column of the input named like the result
column is replaced, all other columns come back. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalflow.llm.common import table
from evalflow.llm.words import mix, pieces

#: Markers of prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
#: Of 100 texts, so many are cut; of 100 that are cut, so many begin with the suffix.
CUT, SUFFIX_FIRST = 90, 20
SPREAD = 8

_RESULT = "n long, form string, prefix_chars long, middle_chars long, output string"
_FIELDS = pa.struct(
    [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]
)


def token_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where the tokens `[A-Za-z]+|[^A-Za-z]` of joined texts begin; a new text always begins a token."""
    letter = ((points | np.uint32(32)) - np.uint32(97)) < 26
    starts = ~letter
    starts[1:] |= ~letter[:-1]
    starts[text_starts] = True
    return np.flatnonzero(starts)


class SkipList:
    """Skip lists over the tokens of joined texts, one for each text that has tokens.

    ``starts``: where tokens begin; ``end``: the number of all code points; ``heads``: the first token of each text.
    """

    def __init__(self, starts: np.ndarray, end: int, heads: np.ndarray, spread: int = SPREAD):
        draw = mix(np.arange(1, len(starts) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        longest = int(np.diff(np.append(heads, len(starts))).max(initial=1))
        levels = np.zeros(len(starts), dtype=np.int8)
        top, reach = 0, 1
        while reach < longest:
            top, reach = top + 1, reach * spread
            levels += draw < np.uint64((1 << 64) // reach)
        levels[heads] = top
        self.lanes: list[tuple[np.ndarray, np.ndarray, np.ndarray | None]] = []
        below = None
        for level in range(top + 1):
            towers = np.flatnonzero(levels >= level)
            units = np.diff(np.append(towers, len(starts)))
            widths = np.diff(np.append(starts[towers], end))
            down = None if below is None else np.searchsorted(below, towers)
            self.lanes.append((units, widths, down))
            below = towers
        self.lanes.reverse()
        #: The place of each text's head in the top lane.
        self.heads = np.searchsorted(below, heads)

    def reach(self, text: int, rank: int) -> int:
        """Code points of the text's first ``rank`` units."""
        at, passed, points = int(self.heads[text]), 0, 0
        for units, widths, down in self.lanes:
            while passed < rank and passed + units[at] <= rank:
                passed += int(units[at])
                points += int(widths[at])
                at += 1
            if passed == rank:
                return points
            if down is not None:
                at = int(down[at])
        raise IndexError(f"rank {rank} is beyond the text")


def draws(doc_id: int | None, salt: str = "1") -> list[int]:
    """Four repeatable 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{salt}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def _rows(ids: Sequence, texts: Sequence[str], markers: Sequence[str], cut: int, suffix_first: int, salt: str) -> list[dict]:
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(lengths)
    filled = np.flatnonzero(lengths)
    starts = token_starts(points, (ends - lengths)[filled])
    heads = np.searchsorted(starts, (ends - lengths)[filled])
    counts = np.zeros(len(texts), dtype=np.int64)
    counts[filled] = np.diff(np.append(heads, len(starts)))
    place = np.zeros(len(texts), dtype=np.int64)
    place[filled] = np.arange(len(filled))
    towers = SkipList(starts, len(points), heads)
    p_mark, s_mark, m_mark = markers
    out = []
    for k, (doc_id, text, n) in enumerate(zip(ids, texts, counts.tolist(), strict=True)):
        h = draws(doc_id, salt)
        if not text or h[2] % 100 >= cut or any(m in text for m in markers):
            out.append({"n": n, "form": "plain", "prefix_chars": None, "middle_chars": None, "output": text})
            continue
        low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        a, b = (towers.reach(place[k], rank) for rank in (low, high))
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if h[3] % 100 < suffix_first:
            form, output = "spm", f"{s_mark}{suffix}{p_mark}{prefix}{m_mark}{middle}"
        else:
            form, output = "psm", f"{p_mark}{prefix}{s_mark}{suffix}{m_mark}{middle}"
        out.append({"n": n, "form": form, "prefix_chars": a, "middle_chars": b - a, "output": output})
    return out


def fill_in_middle(
    docs: DataFrame,
    into: str = "fim",
    markers: Sequence[str] = MARKERS,
    cut: int = CUT,
    suffix_first: int = SUFFIX_FIRST,
    salt: str = "1",
) -> DataFrame:
    """All columns, with the struct ``into``: `n` tokens, `form` (plain, psm, spm), `prefix_chars`, `middle_chars`, `output`.

    A document is cut at two ranks drawn from its id; ``cut`` and ``suffix_first`` are percentages.
    """

    def run(ids: pa.Array, texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([ids, texts], names=["id", "text"])
        found = []
        for part in pieces(batch):
            whole = [t or "" for t in part.column(1).to_pylist()]
            found += _rows(part.column(0).to_pylist(), whole, markers, cut, suffix_first, salt)
        return pa.array(found, _FIELDS)

    return docs.withColumn(into, F.arrow_udf(run, _RESULT)("doc_id", "text"))


def restored(output: Column, form: Column, markers: Sequence[str] = MARKERS) -> Column:
    """The text that an output was made of. Built-in functions: nothing but the output and its form is needed."""
    p_mark, s_mark, m_mark = markers

    def between(left: str, right: str) -> Column:
        return F.substring_index(F.substring_index(output, left, -1), right, 1)

    middle = F.substring_index(output, m_mark, -1)
    psm = F.concat(between(p_mark, s_mark), middle, between(s_mark, m_mark))
    spm = F.concat(between(p_mark, m_mark), middle, between(s_mark, p_mark))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    cut = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    output, form = F.col("fim.output"), F.col("fim.form")
    return cut.select(
        "doc_id",
        "fim.n",
        form.alias("form"),
        "fim.prefix_chars",
        "fim.middle_chars",
        F.sha2(output, 256).alias("output_sha256"),
        F.sha2(restored(output, form), 256).alias("restored_sha256"),
    )
