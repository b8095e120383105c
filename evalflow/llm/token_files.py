"""Token ids as files of coded blocks, in the order of the documents' ids, and back.

Writing: documents are dealt by ranges of (id, text hash) and sorted inside a range; each range is tokenised and coded in
one pass. A row of the written table is a run of consecutive documents: where it begins inside its range, the
documents' ids and lengths, and the coded blocks (see range_coder). Runs hold about RUN_IDS ids, so the
memory of a task does not follow the size of its range. The table is written by Spark, like any other.

Reading: every run is decoded on its own; the number of ids before it is that of the ranges before, from one row per
range, and of the runs before in its range, which it carries. A damaged block is an error, never a wrong id.

Defined results: a NULL or empty text is the end id alone. Documents with NULL ids come first. Documents with the same id are
ordered by the hash of their text, equal rows in any order. An empty table gives an empty table. Other columns
are not stored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalflow.llm.common import table
from evalflow.llm.pieces import TOGETHER, ids_of_texts
from evalflow.llm.range_coder import BLOCK_IDS, SIDE_BY_SIDE, decode, encode
from evalflow.staging import stage_path

TOKENIZER = "word_bpe_49k.json"
VOCABULARY = 49_408
END_ID = 2
RUN_IDS = BLOCK_IDS * SIDE_BY_SIDE

_RUN = "part int, before long, n_ids long, doc_ids array<long>, lengths array<long>, blocks binary"


def _run_row(part: int, before: int, docs: list[int | None], found: list[np.ndarray], end_id: int, vocabulary: int) -> pa.RecordBatch:
    ends = np.cumsum([len(f) for f in found])
    ids = np.insert(np.concatenate(found), ends, end_id)
    # Fewer ids are cut into shorter blocks, of which as many can be coded side by side.
    block = min(BLOCK_IDS, max(256, -(-len(ids) // SIDE_BY_SIDE)))
    row = {
        "part": part, "before": before, "n_ids": len(ids), "doc_ids": docs, "lengths": [len(f) + 1 for f in found],
        "blocks": b"".join(encode(ids, vocabulary, block)),
    }
    return pa.RecordBatch.from_pylist([row], schema=_RUN_SCHEMA)


def _some_rows(texts: pa.Array) -> Iterator[slice]:
    """Consecutive rows that hold about TOGETHER bytes; a longer text is alone or the last."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
    group = (np.cumsum(sizes, dtype=np.int64) - sizes) // TOGETHER
    bounds = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    return (slice(a, b) for a, b in pairwise(bounds) if a < b)


_RUN_SCHEMA = pa.schema(
    [
        ("part", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())), ("blocks", pa.binary()),
    ]
)


def write_tokens(
    docs: DataFrame, path: str, tokenizer_path: str, vocabulary: int = VOCABULARY, end_id: int = END_ID, run_ids: int = RUN_IDS
) -> None:
    """Tokenise, end every document with ``end_id``, code and write."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    keys = [F.col("doc_id").asc_nulls_first(), "text_key"]
    # Tokenising comes after the exchange: drawing its bounds reads the input once more.
    ranged = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, held = TaskContext.get().partitionId(), 0, 0
        docs, found = [], []
        tokenise = ids_of_texts(tokenizer_path)
        for batch in batches:
            # A batch holds any number of bytes; its texts are tokenised some at a time.
            for at in _some_rows(batch.column(1)):
                rows = batch.slice(at.start, at.stop - at.start)
                raw = [r or b"" for r in rows.column(1).cast(pa.binary()).to_pylist()]
                for doc_id, ids in zip(rows.column(0).to_pylist(), tokenise(raw), strict=True):
                    docs.append(doc_id)
                    found.append(ids)
                    held += len(ids) + 1
                    if held >= run_ids:
                        yield _run_row(part, before, docs, found, end_id, vocabulary)
                        before, held, docs, found = before + held, 0, [], []
        if docs:
            yield _run_row(part, before, docs, found, end_id, vocabulary)

    ranged.mapInArrow(run, _RUN).write.parquet(path)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The written runs, each with `first`: the number of ids before it in the whole table."""
    written = spark.read.schema(_RUN).parquet(path)
    parts = written.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    earlier = F.sum("ids").over(W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    starts = parts.select(F.col("part").alias("of_part"), F.coalesce(earlier, F.lit(0)).alias("base"))
    return written.join(starts, F.col("part") == F.col("of_part")).withColumn("first", F.col("base") + F.col("before"))


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """`doc_id`, `start`, `n_tokens`, `ids_crc32` and, if wanted, `ids` (little-endian 32-bit numbers) of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, docs, lengths, blocks in zip(batch["first"], batch["doc_ids"], batch["lengths"], batch["blocks"], strict=True):
                ids, lengths = decode(blocks), np.asarray(lengths, dtype=np.int64)
                ends = np.cumsum(lengths)
                raw = [ids[e - n : e].tobytes() for e, n in zip(ends, lengths, strict=True)]
                # A nullable type: ids may be NULL, and long ids do not fit a float.
                out = pd.DataFrame({"doc_id": pd.array([None if pd.isna(d) else int(d) for d in docs], dtype="Int64")})
                out["start"], out["n_tokens"] = first + ends - lengths, lengths
                out["ids_crc32"] = [zlib.crc32(r) for r in raw]
                if with_ids:
                    out["ids"] = raw
                yield out

    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return runs(spark, path).select("first", "doc_ids", "lengths", "blocks").mapInPandas(run, kind)


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = stage_path(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER))
    return read_tokens(spark, path, with_ids=False)
