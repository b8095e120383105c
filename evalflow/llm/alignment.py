"""Alignment of two tokenizers over the same bytes, by products of sparse incidence matrices.

Both tokenizers cut a blank and the text into tokens that cover the same bytes. For a run of documents (about 1 MB of text) each
side is an incidence matrix in compressed rows, one row per token. Four kinds, the last three joined by a product A·Bᵀ
that is made row by row (Gustavson):

* ends: one column per byte, an entry at the token's last byte; the product has the pairs that end together;
* bytes: an entry for each byte of the token; the product has the pairs that overlap, its values are the bytes they share;
* groups: bytes at which tokens of both sides end cut the tokens into groups; one column per group; the product has the pairs
  that share a group.

`alignments` returns the tokens, groups and links of each document. `alignment_figures` adds counts over the corpus: a
run of documents keeps its distinct id pairs, which are counted by Spark; the counts come back as one short array
per run. So only distinct pairs of runs are exchanged, never links.

Defined results: a text that is NULL or empty, or that one of the tokenizers does not give back byte for byte, has no tokens. A
NULL id stays NULL, equal rows give equal results. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalflow.llm.common import table
from evalflow.llm.segment_ids import SegmentIds, byte_level, sentence_pieces
from evalflow.llm.sparse import Csr, product_rows, spans
from evalflow.llm.words import pieces
from evalflow.staging import stage

BYTE_LEVEL, SENTENCE_PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
KINDS = ("ends", "bytes", "groups")
#: Bytes of text of a run, about (a single longer text is one run). A task holds some fifty times as much.
RUN_BYTES = 1 << 20


@dataclass(frozen=True)
class Side:
    """The tokens of one tokenizer over the joined bytes of a run of documents: ids, last bytes and tokens per document."""

    ids: np.ndarray
    ends: np.ndarray
    counts: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.append(0, self.ends[:-1])[: len(self.ends)]


def _side(coder: SegmentIds, ids: np.ndarray, counts: np.ndarray, good: np.ndarray) -> Side:
    kept = ids[np.repeat(good, counts)]
    return Side(kept.astype(np.int64), np.cumsum(coder.widths[kept], dtype=np.int64), np.where(good, counts, 0))


def incidence(side: Side, columns: int, kind: str, cuts: np.ndarray) -> Csr:
    """Tokens by bytes, by their last byte, or by groups; ``cuts`` are the ends of the groups."""
    n = len(side.ids)
    if kind == "bytes":
        lengths = np.diff(np.append(0, side.ends))
        return Csr(np.append(0, side.ends), spans(side.starts, lengths), np.ones(columns, dtype=np.int64), columns)
    if kind == "ends":
        return Csr(np.arange(n + 1), side.ends - 1, np.ones(n, dtype=np.int64), columns)
    return Csr(np.arange(n + 1), np.searchsorted(cuts, side.ends), np.ones(n, dtype=np.int64), len(cuts))


class Run:
    """Two tokenizations of a run of documents, cut into groups."""

    def __init__(self, texts: list[str | None], a: SegmentIds, b: SegmentIds):
        raw = [f" {t}".encode() if t else b"" for t in texts]
        *of_a, good_a = a(raw)
        *of_b, good_b = b(raw)
        good = good_a & good_b
        self.a, self.b = _side(a, *of_a, good), _side(b, *of_b, good)
        self.bytes = int(self.a.ends[-1]) if len(self.a.ends) else 0
        marked = np.zeros(self.bytes + 1, dtype=bool)
        marked[self.a.ends] = True
        #: Bytes at which tokens of both sides end. The last byte of a document always is one.
        self.cuts = self.b.ends[marked[self.b.ends]]
        lengths = np.where(good, [len(r) for r in raw], 0)
        self.text_ends = np.cumsum(lengths)
        self.groups = np.diff(np.append(0, np.searchsorted(self.cuts, self.text_ends, "right")))

    def links(self, kind: str = "ends") -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """A token, B token and value of every link, ascending, in runs of bounded size."""
        a = incidence(self.a, self.bytes, kind, self.cuts)
        yield from product_rows(a, incidence(self.b, self.bytes, kind, self.cuts).transposed())

    def group_sizes(self, side: Side) -> np.ndarray:
        return np.diff(np.append(0, np.searchsorted(side.ends, self.cuts, "right")))

    def group_texts(self) -> list[bytes]:
        """For each document its groups as `a1,a2|b1;a3|b2,b3`."""
        ends_a, ends_b = (np.searchsorted(s.ends, self.cuts, "right") for s in (self.a, self.b))
        group_a, group_b = (np.searchsorted(self.cuts, s.ends) for s in (self.a, self.b))
        n_a, n_b = len(self.a.ids), len(self.b.ids)
        at_a = np.arange(n_a) + np.append(0, ends_b)[group_a]
        at_b = np.arange(n_b) + ends_a[group_b]
        ids = np.empty(n_a + n_b, dtype=np.int64)
        ids[at_a], ids[at_b] = self.a.ids, self.b.ids
        after = np.full(n_a + n_b, ord(","), dtype=np.uint8)
        after[at_a[ends_a - 1]], after[at_b[ends_b - 1]] = ord("|"), ord(";")
        largest = int(ids.max(initial=0))
        width = len(str(largest))
        digits = np.arange(largest + 1).astype(f"S{width}")
        sheet = np.zeros((len(ids), width + 1), dtype=np.uint8)
        sheet[:, :width] = digits.view(np.uint8).reshape(-1, width)[ids]
        sheet[np.arange(len(ids)), width] = after
        shown = sheet != 0
        ends = np.append(0, np.cumsum(shown.sum(axis=1)))[np.append(0, np.cumsum(self.a.counts + self.b.counts))]
        flat = sheet[shown].tobytes()
        return [flat[s : e - 1] for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _runs(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[tuple[pa.RecordBatch, Run]]:
    a, b = byte_level(a_path), sentence_pieces(b_path)
    for batch in batches:
        for part in pieces(batch, most=RUN_BYTES):
            yield part, Run(part.column(part.schema.get_field_index("text")).to_pylist(), a, b)


def _lists(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def alignments(docs: DataFrame, a_path: str, b_path: str, kind: str = "ends") -> DataFrame:
    """`doc_id`, `a_ids`, `b_ids`, `group_a`, `group_b` (tokens per group) and `links` of every document.

    A link is (a, b, weight): places of the tokens in the document and the value of the product of that ``kind``.
    Shared groups give all pairs of a group: for long groups that is much more than the tokens.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _runs(batches, a_path, b_path):
            parts = list(found.links(kind))
            a, b, weight = (np.concatenate([p[k] for p in parts] or [np.zeros(0, dtype=np.int64)]) for k in range(3))
            first_a, first_b = (np.cumsum(s.counts) - s.counts for s in (found.a, found.b))
            text = np.searchsorted(np.cumsum(found.a.counts), a, "right")
            places = [pa.array(x.astype(np.int32)) for x in (a - first_a[text], b - first_b[text], weight)]
            per_text = np.append(0, np.cumsum(np.bincount(text, minlength=part.num_rows))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    _lists(found.a.ids, found.a.counts, pa.int32()),
                    _lists(found.b.ids, found.b.counts, pa.int32()),
                    _lists(found.group_sizes(found.a), found.groups, pa.int32()),
                    _lists(found.group_sizes(found.b), found.groups, pa.int32()),
                    pa.ListArray.from_arrays(pa.array(per_text), pa.StructArray.from_arrays(places, ["a", "b", "weight"])),
                ],
                names=["doc_id", "a_ids", "b_ids", "group_a", "group_b", "links"],
            )

    kinds = "a_ids array<int>, b_ids array<int>, group_a array<int>, group_b array<int>, links array<struct<a int, b int, weight int>>"
    return docs.select("doc_id", "text").mapInArrow(run, f"{_kind_of(docs, 'doc_id')}, {kinds}")


def _kind_of(docs: DataFrame, name: str) -> str:
    return f"{name} {docs.schema[name].dataType.simpleString()}"


def _run_table(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per run of documents: figures of its documents, its distinct id pairs with their links, the pair of each link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for part, found in _runs(batches, a_path, b_path):
            keys, owners = [], []
            for a, b, _ in found.links("ends"):
                keys.append(found.a.ids[a] << 32 | found.b.ids[b])
                owners.append(a)
            links = np.concatenate(keys or [np.zeros(0, dtype=np.int64)])
            owner = np.concatenate(owners or [np.zeros(0, dtype=np.int64)])
            pairs, which, times = np.unique(links, return_inverse=True, return_counts=True)
            text = np.searchsorted(np.cumsum(found.a.counts), owner, "right")
            shas = [hashlib.sha256(t).hexdigest() if n else "" for t, n in zip(found.group_texts(), found.a.counts, strict=True)]
            width = np.uint16 if len(pairs) <= 1 << 16 else np.uint32
            figures = [found.a.counts, found.b.counts, found.groups, np.bincount(text, minlength=part.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number]),
                    pa.array([part.column("doc_id").to_pylist()], pa.list_(part.column("doc_id").type)),
                    *[pa.array([f.astype(np.int64)], pa.list_(pa.int64())) for f in figures],
                    pa.array([shas], pa.list_(pa.string())),
                    pa.array([pairs], pa.list_(pa.int64())),
                    pa.array([times.astype(np.int64)], pa.list_(pa.int64())),
                    pa.array([which.astype(width).tobytes()], pa.binary()),
                ],
                names=["run", "doc_ids", "n_a", "n_b", "n_groups", "n_links", "shas", "pairs", "times", "which"],
            )
            number += 1

    of_docs = "n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, shas array<string>"
    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"run long, doc_ids array<{ids}>, {of_docs}, pairs array<long>, times array<long>, which binary"
    )


def pair_counts(runs: DataFrame) -> DataFrame:
    """`pair` (the A id in the upper, the B id in the lower 32 bits), `links` and `is_best` over the whole corpus."""
    each = runs.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("p.pairs", "p.times")
    counts = stage(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("links")), "alignment-pairs")
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    best = counts.groupBy(b.alias("b")).agg(F.max("links").alias("most"))
    return counts.join(best, b == F.col("b")).select("pair", "links", (F.col("links") == F.col("most")).alias("is_best"))


def alignment_figures(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """`doc_id`, `n_a`, `n_b`, `n_groups`, `n_links`, `n_best`, `count_sum`, `groups_sha256` of every document.

    ``n_best`` counts the links whose id pair is linked as often as any pair of its B id; ``count_sum`` sums the corpus-wide
    numbers of links of the pairs of all links.
    """
    runs = stage(_run_table(docs, a_path, b_path), "alignment-runs")
    wanted = runs.select("run", F.explode("pairs").alias("pair"))
    scored = wanted.join(pair_counts(runs), "pair").groupBy(F.col("run").alias("of_run")).agg(
        F.array_sort(F.collect_list(F.struct("pair", "links", "is_best"))).alias("s")
    )
    arrays = scored.select("of_run", F.col("s.links").alias("links"), F.col("s.is_best").alias("best"))
    # A run without links has no scores.
    joined = runs.drop("pairs", "times").join(arrays, F.col("run") == F.col("of_run"), "left").drop("run", "of_run")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                cell = {name: batch.column(name)[k] for name in batch.schema.names}
                n_links = cell["n_links"].values.to_numpy()
                raw, total = cell["which"].as_py(), int(n_links.sum())
                links, best = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
                if total:
                    which = np.frombuffer(raw, dtype=np.uint16 if len(raw) == 2 * total else np.uint32)
                    links = cell["links"].values.to_numpy()[which]
                    best = cell["best"].values.to_numpy(zero_copy_only=False)[which].astype(np.int64)
                ends = np.cumsum(n_links)
                sums = [np.append(0, np.cumsum(x)) for x in (best, links)]
                yield pa.RecordBatch.from_arrays(
                    [
                        cell["doc_ids"].values,
                        *[cell[c].values for c in ("n_a", "n_b", "n_groups", "n_links")],
                        *[pa.array(s[ends] - s[ends - n_links], pa.int64()) for s in sums],
                        cell["shas"].values,
                    ],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
                )

    numbers = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return joined.mapInArrow(finish, f"{_kind_of(docs, 'doc_id')}, {numbers}")


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return alignment_figures(docs, public_tokenizers.path(BYTE_LEVEL), public_tokenizers.path(SENTENCE_PIECES))
