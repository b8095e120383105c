"""Near-duplicates by SetSketch registers.

Each document is the set of hashes of its word shingles; equal sets are one class. Sets too small to be linked to any other
set take no further part. All else goes through the registers of the classes (see set_sketch):

1. Bands. Each class falls into BANDS buckets, one per run of its registers. At similarity 0.85 two classes miss each
   other in all of them with a probability of 2e-9.
2. Candidates. In every bucket each class is paired with the one of smallest name, and kept with it if the joint
   likelihood of their registers allows the similarity. The connected classes are clusters. Only buckets that hold several
   clusters then are compared member by member, in blocks inside tasks; a block gives only the pairs that
   connect its candidates. So a large group of copies gives about as many pairs as it has members.
3. Verification. Every two linked classes are in one cluster now. The whole sets of a cluster are compared exactly, in
   blocks, and give the links that connect what links connect.
4. Components of those links.

Defined results: texts without words (NULL, empty, blank) have an empty set, no links, their own id, and are kept. Equal rows
are one class; those of the smallest id are all kept. A NULL id is never a component's id unless its class has no other.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalflow.llm.common import table
from evalflow.llm.jaccard import components, forest, spanning_links
from evalflow.llm.set_sketch import REGISTERS, may_reach, sketches
from evalflow.llm.words import mix, pieces, shingle_sets, word_hashes
from evalflow.staging import hand_on, owned, stage

SIZE, PERCENT = 5, 85
BANDS = 42
#: How much less likely the similarity may be than the best estimate, in the logarithm.
SLACK = 18.0
#: Members of a block, and shingles of all its members, about.
BLOCK_MEMBERS, BLOCK_SHINGLES = 1000, 60_000

_SKETCH = "doc_id long, text_key long, n long, set_id binary, registers binary"


def least_size(percent: int) -> float:
    """The fewest shingles of a set that can be linked to a different one, which has one more at least."""
    return -(-percent // (100 - percent)) if percent < 100 else float("inf")


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for part in pieces(batch):
        words, bounds = word_hashes(part.column(part.schema.get_field_index("text")), fold=True)
        yield part, list(shingle_sets(words, bounds, size))


def _buckets(registers: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit hash of each band's registers and its number."""
    width = registers.shape[1] // bands
    cut = registers[:, : bands * width].astype(np.uint64).reshape(-1, bands, width)
    total = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), cut.shape[:2]).copy()
    for k in range(width):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + cut[:, :, k])
    return total


def signatures(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """`doc_id`, `text_key`, `n`, `set_id` (NULL for the empty set) and `registers` (NULL for too small sets)."""
    least = least_size(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in _sets(batch, size):
                rows = [k for k, s in enumerate(sets) if len(s) >= least]
                found = sketches([sets[k] for k in rows])
                place = dict(zip(rows, range(len(rows)), strict=True))
                names = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()),
                        part.column("text_key"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(names, pa.binary()),
                        pa.array([found[place[k]].tobytes() if k in place else None for k in range(len(sets))], pa.binary()),
                    ],
                    names=["doc_id", "text_key", "n", "set_id", "registers"],
                )

    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return keyed.mapInArrow(run, _SKETCH)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(len(column), -1)


def _allowed(x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray, percent: int) -> np.ndarray:
    """Which rows of registers may belong to linked sets."""
    larger, smaller = (x > y).sum(axis=1), (x < y).sum(axis=1)
    return may_reach(percent / 100, SLACK, n_x, n_y, larger, smaller, x.shape[1] - larger - smaller)


def bucket_cells(sketched: DataFrame) -> DataFrame:
    """`set_id` and `bucket` of every class and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 20_000):
                batch = whole.slice(at, 20_000)
                buckets = _buckets(_matrix(batch.column("registers")), BANDS).view(np.int64)
                owners = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
                yield pa.RecordBatch.from_arrays([batch.column("set_id").take(owners), pa.array(buckets.ravel())], names=["set_id", "bucket"])

    return sketched.select("set_id", "registers").mapInArrow(run, "set_id binary, bucket long")


def _with_head(cells: DataFrame, sketched: DataFrame, percent: int) -> DataFrame:
    """`a` and `b`: classes that may be linked to the class of smallest name (``head``) in a bucket of theirs."""
    pairs = cells.where(F.col("set_id") > F.col("head")).select(F.col("set_id").alias("a"), F.col("head").alias("b")).distinct()
    side = sketched.select("set_id", "n", "registers")
    for name in ("a", "b"):
        side_of = side.toDF(name, f"n_{name}", f"r_{name}")
        pairs = pairs.join(side_of, name)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 20_000):
                batch = whole.slice(at, 20_000)
                n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
                good = _allowed(_matrix(batch.column("r_a")), _matrix(batch.column("r_b")), n_a, n_b, percent)
                yield batch.select(["a", "b"]).filter(pa.array(good))

    return pairs.mapInArrow(judge, "a binary, b binary")


def _block_candidates(left: list[dict], right: list[dict] | None, percent: int) -> list[tuple[bytes, bytes]]:
    """Pairs that connect what may be linked among the members of a block (right is None) or across two.

    Members of one cluster (``root``, if they have one) are connected already and not compared.
    """
    members = left + (right or [])
    registers = np.frombuffer(b"".join(m["registers"] for m in members), dtype=np.uint16).reshape(len(members), -1)
    sizes = np.array([m["n"] for m in members], dtype=np.int64)
    cluster = np.unique([m.get("root", m["set_id"]).hex() for m in members], return_inverse=True)[1]
    # Across two blocks only the rectangle of left and right is counted.
    first = 0 if right is None else len(left)
    rows, columns = (np.ascontiguousarray(side.T) for side in (registers[: len(left)], registers[first:]))
    equal = np.zeros((len(left), len(members) - first), dtype=np.uint8 if len(rows) < 256 else np.int32)
    for mine, others in zip(rows, columns, strict=True):
        equal += mine[:, None] == others[None, :]
    # A link has percent of its registers equal on average; six and a half standard deviations below is out of reach.
    m, p = registers.shape[1], percent / 100
    near = equal >= m * p - 6.5 * np.sqrt(m * p * (1 - p))
    near &= cluster[: len(left), None] != cluster[None, first:]
    if right is None:
        near = np.triu(near, 1)
    x, y = np.nonzero(near)
    y += first
    linked = np.zeros((len(members), len(members)), dtype=bool)
    for at in range(0, len(x), 20_000):
        i, j = x[at : at + 20_000], y[at : at + 20_000]
        good = _allowed(registers[i], registers[j], sizes[i], sizes[j], percent)
        linked[i[good], j[good]] = linked[j[good], i[good]] = True
    return [(members[a]["set_id"], members[b]["set_id"]) for a, b in forest(linked)]


def _block_pairs(rows: DataFrame, group: str, member: str) -> DataFrame:
    """Blocks of the groups, each with itself (`right` is NULL) and with every later block of its group.

    ``rows`` has the group, ``set_id``, the struct ``member`` and ``blocks``, the number of blocks of its group.
    """
    packed = rows.withColumn("block", F.pmod(F.xxhash64("set_id"), "blocks")).groupBy(group, "block").agg(
        F.collect_list(member).alias("members")
    )
    packed = stage(packed, "sketch-blocks")
    alone = packed.select(F.col("members").alias("left"), F.lit(None).cast(packed.schema["members"].dataType).alias("right"))
    a = packed.select(group, F.col("block").alias("x"), F.col("members").alias("left"))
    b = packed.select(group, F.col("block").alias("y"), F.col("members").alias("right"))
    return alone.unionByName(a.join(b, group).where("x < y").select("left", "right"))


def _compared(pairs: DataFrame, compare) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = compare(*(batch.column(side)[k].as_py() for side in ("left", "right")))
                if found:
                    yield pa.RecordBatch.from_pydict(
                        {"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([y for _, y in found], pa.binary())}
                    )

    return pairs.mapInArrow(run, "a binary, b binary")


def _in_blocks(cells: DataFrame, sketched: DataFrame, clusters: DataFrame, percent: int) -> DataFrame:
    """`a` and `b` from the buckets of three classes or more in which several clusters meet."""
    named = clusters.select(F.col("node").alias("set_id"), "root")
    cells = cells.where("members > 2").select("set_id", "bucket")
    labelled = cells.join(named, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    mixed = labelled.groupBy("bucket").agg(
        F.count("*").alias("members"),
        F.min("root").alias("first"),
        F.max("root").alias("last"),
        F.bit_xor(F.xxhash64("set_id")).alias("sign"),
    )
    # Of the buckets with the same members one will do.
    mixed = mixed.where("first < last").groupBy("members", "sign").agg(F.min("bucket").alias("bucket"))
    blocks = mixed.select("bucket", F.ceil(F.col("members") / BLOCK_MEMBERS).alias("blocks"))
    rows = labelled.join(blocks, "bucket").join(sketched.select("set_id", "n", "registers"), "set_id")
    pairs = _block_pairs(rows.withColumn("member", F.struct("set_id", "root", "n", "registers")), "bucket", "member")
    return _compared(pairs, lambda left, right: _block_candidates(left, right, percent))


def candidate_clusters(sketched: DataFrame, percent: int) -> DataFrame:
    """`node` and `root`: every two linked classes have the same root. ``sketched`` has one row per class."""
    # One exchange by bucket serves both sides of the join; classes alone in their bucket go no further.
    cells = bucket_cells(sketched).repartition("bucket")
    heads = cells.groupBy("bucket").agg(F.min("set_id").alias("head"), F.count("*").alias("members")).where("members > 1")
    cells = stage(cells.join(heads, "bucket"), "sketch-cells")
    near = stage(_with_head(cells, sketched, percent), "sketch-candidates")
    clusters = components(near)
    further = _in_blocks(cells, sketched, clusters, percent)
    # What is connected already enters as stars, so only what joins them is left to settle.
    return components(clusters.toDF("a", "b").unionByName(further))


def links(docs: DataFrame, sketched: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """`a` and `b`, set ids of linked classes; connects every two classes that links connect."""
    clusters = stage(candidate_clusters(sketched, percent), "sketch-clusters")
    roots = clusters.select(F.col("root").alias("node"), "root").distinct()
    members = clusters.unionByName(roots).withColumnRenamed("node", "set_id")
    members = members.join(sketched.select("set_id", "doc_id", "text_key", "n"), "set_id")
    blocks = members.groupBy("root").agg(
        F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_MEMBERS)).alias("blocks")
    )
    wanted = members.join(blocks, "root").select(
        "set_id", "root", "blocks", F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key")
    )
    # One row stands for a class: copies of its text under other ids stay where they are. The wanted rows grow with the
    # table, so they are met by an exchange at every size.
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    texts = keyed.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key")))
    texts = texts.dropDuplicates(["set_id"]).select("set_id", "root", "blocks", "text")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in _sets(batch, size):
                kept = [part.column(c) for c in ("set_id", "root", "blocks")]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array([s.tobytes() for s in sets], pa.binary())], names=["set_id", "root", "blocks", "shingles"]
                )

    rows = texts.mapInArrow(whole, "set_id binary, root binary, blocks long, shingles binary")
    pairs = _block_pairs(rows.withColumn("member", F.struct("set_id", "shingles")), "root", "member")

    def compare(left: list[dict], right: list[dict] | None) -> list[tuple[bytes, bytes]]:
        sides = [s and [(m["set_id"], np.frombuffer(m["shingles"], dtype=np.uint64)) for m in s] for s in (left, right)]
        return spanning_links(*sides, percent)

    return stage(_compared(pairs, compare), "sketch-links")


def near_duplicates(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """`doc_id`, `text_key`, `n_shingles`, `component_id` and `kept` (of smallest id in its component) for every row."""
    with owned(docs.sparkSession) as tables:
        signed = stage(signatures(docs, size, percent), "sketch-signatures")
        # A class is its row of smallest id; copies are combined before the exchange.
        one = F.min(F.struct("doc_id", "text_key", "n", "registers")).alias("one")
        classes = signed.where("registers is not null").groupBy("set_id").agg(one)
        sketched = stage(classes.select("set_id", "one.*"), "sketch-classes")
        hand_on(tables)
        signed = stage(signed.select("doc_id", "text_key", "n", "set_id"), "sketch-names")
        hand_on(tables)
    roots = components(links(docs, sketched, size, percent))
    rows = signed.join(roots, F.col("set_id") == F.col("node"), "left")
    rows = stage(rows.select("doc_id", "text_key", "n", F.coalesce("root", "set_id").alias("root")), "sketch-rooted")
    named = rows.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id")).withColumnRenamed("root", "of_root")
    found = rows.join(named, F.col("root") == F.col("of_root"), "left")
    found = found.withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return found.select(
        "doc_id", "text_key", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def op12_sketch_duplicates(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")
