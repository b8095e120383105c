"""Substring dedup: words covered by a window of WINDOW words that also starts earlier are removed.

1. Anchors. The anchor of a window is the smallest hash of its runs of GRAM words; equal windows have equal
   anchors. Consecutive windows with the same anchor are one segment. Anchors of one segment are done, unless the
   segment repeats runs within itself: their windows cannot repeat. Segments of equal content under an anchor are one class, whose earliest segment leads; in
   the others every window starts earlier.
2. Index. The leading segments of anchors with several contents are dealt by anchor to shards of bounded size. Each
   shard builds an FM-index (see fm_index) over its segments and streams them through it: backward search gives the
   matching statistic at every place, and where it reaches the window, the earliest start in the interval.
3. An anchor with more words than a shard may hold is split by content into several shards. What is earliest in
   its shard is then compared over the shards by the hash of the window.
4. The intervals of a document are gathered, and its words outside of them are kept.

Windows are judged on the input. All shuffles carry hashes and positions; texts move to the intervals of their own
document only.

Defined results: a NULL text has no words; a NULL id is smaller than all others (as the smallest long). Rows are
ordered by id, then by the hash of their text; equal rows are one document and have the same result. Texts shorter than
a window keep all words. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalflow.llm.common import table
from evalflow.llm.fm_index import Index
from evalflow.llm.words import _BASE, _table, mix, pieces, shingle_hashes, word_hashes
from evalflow.staging import stage

WINDOW = 20
GRAM = 5
SHARD_WORDS = 200_000

_U = np.uint64
_LEAST = -(1 << 63)


def _rolling_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    reach = 1
    while reach * 2 <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _run_hashes(words: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the runs of words [first, last) from running sums."""
    sums = np.concatenate([np.zeros(1, dtype=_U), np.cumsum(words * _table(_BASE, len(words))[: len(words)], dtype=_U)])
    back = _table(pow(_BASE, -1, 1 << 64), len(words))
    return mix((sums[last] - sums[first]) * back[first] + (last - first).astype(_U) * _U(_BASE))


def segments_of(words: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Text number, first word, windows, anchor and content hash of every segment, and whether it may repeat itself."""
    n = len(words) - window + 1
    none = np.zeros(0, dtype=np.int64)
    if n <= 0:
        return none, none, none, none.view(_U), none.view(_U), none.astype(bool)
    grams = shingle_hashes(words, gram)
    anchors = _rolling_least(grams, window - gram + 1)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    places = np.flatnonzero(text[:n] == text[window - 1 : window - 1 + n])
    if not len(places):
        return none, none, none, none.view(_U), none.view(_U), none.astype(bool)
    fresh = np.append(True, (np.diff(places) != 1) | (anchors[places[1:]] != anchors[places[:-1]]) | (text[places[1:]] != text[places[:-1]]))
    begin = places[fresh]
    count = np.diff(np.append(np.flatnonzero(fresh), len(places)))
    content = _run_hashes(words, begin, begin + count + window - 1)
    # Equal windows of one segment are nearer than the anchor's reach, and then so are their equal grams, or the
    # segment is longer than one occurrence of its anchor allows.
    reach = window - gram + 1
    again = np.zeros(len(grams) + 1, dtype=np.int64)
    for apart in range(1, min(reach, len(grams))):
        again[: len(grams) - apart] |= grams[apart:] == grams[:-apart]
    again = np.concatenate([[0], np.cumsum(again)])
    loops = (count > reach) | (again[begin + count + window - gram] > again[begin])
    return text[begin], begin - bounds[text[begin]], count, anchors[begin], content, loops & (count > 1)


_SEGMENT = "rid long, text_key long, start int, n int, anchor long, content long, loops boolean"


def segments(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """One row per segment. ``docs`` has rid, text_key and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                words, bounds = word_hashes(part.column(2))
                text, start, n, anchor, content, loops = segments_of(words, bounds, window, gram)
                at = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(at), part.column(1).take(at), pa.array(start.astype(np.int32)),
                        pa.array(n.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)),
                        pa.array(loops),
                    ],
                    names=["rid", "text_key", "start", "n", "anchor", "content", "loops"],
                )

    return docs.select("rid", "text_key", "text").mapInArrow(run, _SEGMENT)


def _cut(texts: DataFrame, window: int) -> DataFrame:
    """The word hashes of the wanted segments: ``texts`` has rid, text_key, wanted and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                words, bounds = word_hashes(part.column(3))
                rids, keys = part.column(0).to_pylist(), part.column(1).to_pylist()
                out = []
                for row, wanted in enumerate(part.column(2).to_pylist()):
                    for w in wanted:
                        first = int(bounds[row]) + w["start"]
                        cut = words[first : first + w["n"] + window - 1]
                        out.append((w["shard"], w["part"], rids[row], keys[row], w["start"], cut.tobytes()))
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip(_CUT_NAMES, o, strict=True)) for o in out], schema=_CUT_SCHEMA)

    return texts.mapInArrow(run, "shard long, part int, rid long, text_key long, start int, words binary")


_CUT_NAMES = ["shard", "part", "rid", "text_key", "start", "words"]
_CUT_SCHEMA = pa.schema(
    [("shard", pa.int64()), ("part", pa.int32()), ("rid", pa.int64()), ("text_key", pa.int64()), ("start", pa.int32()), ("words", pa.binary())]
)

_SEARCHED = "rid long, text_key long, start int, stop int, w1 long, w2 long"


def search_shard(group: pd.DataFrame, window: int) -> pd.DataFrame:
    """Removed intervals of the shard's segments (w1 NULL), and for a part of a split anchor its earliest windows."""
    cuts = [np.frombuffer(w, dtype=_U) for w in group["words"]]
    lengths = np.array([len(c) for c in cuts])
    flat = np.concatenate(cuts)
    _, symbols = np.unique(flat, return_inverse=True)
    # Every sequence is followed by the symbol 0.
    owner = np.repeat(np.arange(len(cuts)), lengths)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    offset = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    text = np.zeros(int((lengths + 1).sum()), dtype=np.int64)
    place = starts[owner] + offset
    text[place] = symbols + 1
    rid, key, begin = (group[c].to_numpy(dtype=np.int64) for c in ("rid", "text_key", "start"))
    order = np.full(len(text), len(text), dtype=np.int64)
    order[place[np.lexsort((begin[owner] + offset, key[owner], rid[owner]))]] = np.arange(len(flat))
    at, earliest = Index(text, order, window).repeated(text, starts, starts + lengths)
    later = at[earliest < order[at]]
    row = np.searchsorted(starts, later, "right") - 1
    # Neighbouring windows become one interval.
    sort = np.argsort(later, kind="stable")
    later, row = later[sort], row[sort]
    fresh = np.append(True, (np.diff(later) != 1) | (np.diff(row) != 0)) if len(later) else np.zeros(0, dtype=bool)
    ends = np.append(fresh[1:], True) if len(later) else fresh
    r, first, last = row[fresh], later[fresh] - starts[row[fresh]], later[ends] - starts[row[ends]]
    out = pd.DataFrame(
        {"rid": rid[r], "text_key": key[r], "start": begin[r] + first, "stop": begin[r] + last + window, "w1": None, "w2": None}
    )
    if group["part"].iloc[0] < 0:
        return out
    kept = np.zeros(len(text), dtype=bool)
    kept[place[offset + window <= lengths[owner]]] = True
    kept[later] = False
    windows = np.flatnonzero(kept)
    r = np.searchsorted(starts, windows, "right") - 1
    source = windows - r  # without the closing symbols
    first = begin[r] + windows - starts[r]
    more = pd.DataFrame(
        {
            "rid": rid[r], "text_key": key[r], "start": first, "stop": first + window,
            "w1": _run_hashes(flat, source, source + window).view(np.int64),
            "w2": mix(_run_hashes(flat ^ _U(_BASE), source, source + window)).view(np.int64),
        }
    )
    return pd.concat([out, more], ignore_index=True) if len(out) else more


def removed_intervals(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_words: int = SHARD_WORDS) -> DataFrame:
    """`rid`, `text_key` and `cuts` (start, stop in words) of documents that lose words."""
    cut = stage(segments(docs, window, gram), "substring-segments")
    several = cut.groupBy("anchor").agg(F.count("*").alias("times"), F.max("loops").alias("loops"))
    several = several.where("times > 1 or loops").select("anchor")
    repeated = stage(cut.join(several, "anchor", "left_semi"), "substring-repeated")
    classes = repeated.groupBy("anchor", "content").agg(
        F.min(F.struct("rid", "text_key", "start", "n")).alias("lead"), F.count("*").alias("times"), F.max("loops").alias("loops")
    )
    classes = stage(classes, "substring-classes")

    led = classes.where("times > 1").select(
        F.col("anchor").alias("l_anchor"), F.col("content").alias("l_content"), F.struct("lead.rid", "lead.text_key", "lead.start").alias("lead")
    )
    copies = repeated.join(led, (F.col("anchor") == F.col("l_anchor")) & (F.col("content") == F.col("l_content")))
    copies = copies.where(F.struct("rid", "text_key", "start") != F.col("lead")).select(
        "rid", "text_key", "start", (F.col("start") + F.col("n") + window - 1).alias("stop")
    )

    held = (F.col("lead.n") + window - 1).cast("bigint")
    heads = classes.groupBy("anchor").agg(
        F.count("*").alias("contents"), F.sum(held).alias("words"), F.max("loops").alias("loops")
    ).where("contents > 1 or loops")
    heads = stage(heads, "substring-anchors")
    total = heads.agg(F.sum("words")).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    parts = F.ceil(F.col("words") / shard_words)
    dealt = classes.join(heads.select("anchor", "words"), "anchor").select(
        "lead.rid", "lead.text_key", "lead.start", "lead.n",
        F.when(parts > 1, F.col("anchor")).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(shards))).alias("shard"),
        F.when(parts > 1, F.pmod(F.xxhash64("content"), parts)).otherwise(F.lit(-1)).cast("int").alias("part"),
    )
    wanted = dealt.groupBy("rid", "text_key").agg(F.collect_list(F.struct("start", "n", "shard", "part")).alias("wanted"))
    wanted = stage(wanted, "substring-wanted").withColumnsRenamed({"rid": "w_rid", "text_key": "w_key"})
    texts = docs.join(wanted, (F.col("rid") == F.col("w_rid")) & (F.col("text_key") == F.col("w_key")))
    # Equal rows are one document: each of its segments counts once.
    cuts = _cut(texts.select("rid", "text_key", "wanted", "text"), window).dropDuplicates(["shard", "part", "rid", "text_key", "start"])
    searched = cuts.groupBy("shard", "part").applyInPandas(lambda g: search_shard(g, window), _SEARCHED)
    searched = stage(searched, "substring-searched")

    inside = searched.where("w1 is null").select("rid", "text_key", "start", "stop")
    parted = searched.where("w1 is not null")
    best = parted.groupBy("w1", "w2").agg(F.min(F.struct("rid", "text_key", "start")).alias("lead"), F.count("*").alias("times"))
    best = best.where("times > 1").select(F.col("w1").alias("b1"), F.col("w2").alias("b2"), "lead")
    across = parted.join(best, (F.col("w1") == F.col("b1")) & (F.col("w2") == F.col("b2")))
    across = across.where(F.struct("rid", "text_key", "start") != F.col("lead")).select("rid", "text_key", "start", "stop")
    gone = copies.unionByName(inside).unionByName(across)
    return stage(gone.groupBy("rid", "text_key").agg(F.collect_set(F.struct("start", "stop")).alias("cuts")), "substring-cuts")


def deduplicated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_words: int = SHARD_WORDS) -> DataFrame:
    """`doc_id`, `n_words`, `n_removed` and `kept`, the kept words joined by one blank, for every row."""
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit(_LEAST)).alias("rid"), F.xxhash64("text").alias("text_key"), "text")
    gone = removed_intervals(keyed, window, gram, shard_words).withColumnsRenamed({"rid": "g_rid", "text_key": "g_key"})
    both = keyed.join(gone, (F.col("rid") == F.col("g_rid")) & (F.col("text_key") == F.col("g_key")), "left")

    @F.pandas_udf("n_words long, n_removed long, kept string")
    def keep(texts: pd.Series, cuts: pd.Series) -> pd.DataFrame:
        out = []
        for text, intervals in zip(texts, cuts, strict=True):
            words = text.encode().split() if isinstance(text, str) else []
            n = len(words)
            if intervals is not None and len(intervals):
                gone = np.zeros(n + 1, dtype=np.int64)
                for x in intervals:
                    gone[x["start"]] += 1
                    gone[x["stop"]] -= 1
                words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:n]) == 0)]
            out.append((n, n - len(words), b" ".join(words).decode()))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])

    # Not deterministic for the optimizer only: it would otherwise run once for each use of the result.
    return both.withColumn("x", keep.asNondeterministic()("text", "cuts")).select("doc_id", "x.n_words", "x.n_removed", "x.kept")


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
