"""N-gram Jaccard join by a token-group matrix.

Each document is the set of hashes of its word shingles; equal sets are one class. Short sets, whose links can only
be to sets with one shingle more or less, are linked by equality: the set without one of its shingles is the other
one. They take no part in the steps below, which find the links between all others:

1. Order. All shingles have a global order by hash, the heaviest last (a bounded list, counted over all
   documents). In that order a class has a prefix of n - m + r shingles, m being the fewest shingles that a linked
   class must share and r = min(REPEATS, m): two linked classes share at least the smaller r within their prefixes.
2. Groups. Classes with the same smallest shingle hash form a group, which near copies mostly share; classes most of
   whose prefix is heavy form groups by the heaviest of it, so a large family of similar texts is in a few groups and not in
   one for each change. Groups are cut into blocks by hash where they have more shingles or members than a block may hold.
3. Matrix. For each group the union of its members' prefixes, with the range of their sizes and the most overlap that
   is still possible from the shingle's place in the order on: one row for each shingle and group. A self-join counts the
   shingles that two groups share; this bounds the overlap of any two members. Pairs of groups below the bound,
   or whose sizes cannot match, are not opened; rows from which on too little can be shared are not even
   joined, which leaves out a large group of texts that are alike, but not enough.
4. Opening. For each remaining pair the members' whole sets are compared, first with the other group's whole union,
   then member by member; exact counts decide. A pair of groups gives only the links that connect it (a
   spanning forest), so a large group of near copies does not give all its pairs.
5. Components by alternating large-star and small-star steps over the links, each step written to a table.

Every order is valid, so the bounded list of heavy shingles only saves work. Nothing is capped: blocks
of a large group are compared with each other like any two groups.

Defined results: texts without words (NULL, empty, blank) have an empty set, no links and their own id. Equal
rows are one class. A NULL id is never a component's id unless its class has no other. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalflow.llm.common import fresh, table
from evalflow.llm.words import pieces, shingle_sets, word_hashes
from evalflow.staging import hand_on, owned, stage

SIZE = 4
PERCENT = 85
REPEATS = 4
#: Shingles that are placed last in the order: those in more prefixes than HEAVY_FROM, the heaviest first.
HEAVY_FROM = 12
HEAVY_MOST = 200_000
#: Shingles of all members of a block, about.
BLOCK_SHINGLES = 60_000
#: Members of a block, about: comparing two blocks takes memory by the square of their members.
BLOCK_MEMBERS = 1000
#: Edges that a task of a round of `components` has, about.
EDGES_PER_TASK = 20_000
#: Sets up to this size may count as short; others of them go through the groups.
SHORT_MOST = 16

_SIGN = 1 << 63


def fewest(n: int, percent: int = PERCENT) -> int:
    """The fewest shingles that a set of n shares with a linked set."""
    return -(-n * percent // 100)


def short(percent: int = PERCENT) -> int:
    """The largest size of sets that differ in one shingle at most from every set they are linked to."""
    n = 0
    # A linked set differs in (100 - percent) % of the union at most, which has n * 100 / percent shingles at most.
    while n < SHORT_MOST and (100 - percent) * (100 * (n + 1) // percent) < 200:
        n += 1
    return n


def _name(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


@dataclass(frozen=True)
class Heavy:
    """Shingles that come last in the order, sorted, and in how many prefixes of the plain order they are."""

    shingles: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint64))
    times: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))

    def among(self, shingles: np.ndarray) -> np.ndarray:
        """How often each of the given shingles counts; 0 where it is not in the list."""
        if not len(self.shingles) or not len(shingles):
            return np.zeros(len(shingles), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.shingles, shingles), len(self.shingles) - 1)
        return np.where(self.shingles[at] == shingles, self.times[at], 0)


def _ordered(shingles: np.ndarray, heavy: Heavy) -> np.ndarray:
    late = heavy.among(shingles) > 0
    return np.concatenate([shingles[~late], shingles[late]]) if late.any() else shingles


def _head(shingles: np.ndarray, heavy: Heavy, percent: int) -> int:
    """The shingle that names the group: the heaviest of the plain prefix where most of that is heavy, else the smallest.

    In a large family of similar texts each has some of the same heavy shingles, so that a few groups hold them all,
    linked or not. A text that only shares a line or a passage with many others stays with its own.
    """
    times = heavy.among(_prefix(shingles, percent))
    at = int(times.argmax()) if 2 * (times > 0).sum() >= len(times) else 0
    return int(shingles[at].view(np.int64))


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for part in pieces(batch):
        words, bounds = word_hashes(part.column(part.schema.get_field_index("text")), fold=True)
        yield part, list(shingle_sets(words, bounds, size))


def _prefix(ordered: np.ndarray, percent: int) -> np.ndarray:
    n = len(ordered)
    return ordered[: n - fewest(n, percent) + min(REPEATS, fewest(n, percent))]


def signatures(docs: DataFrame, size: int, percent: int, heavy: Heavy) -> DataFrame:
    """`doc_id`, `text_key`, `n`, `set_id` (NULL for the empty set), `head` (see `_head`), `prefix` and `without`.

    ``without`` has the set ids that a set has without one of its shingles, where those may be short sets linked to it.
    """
    most = short(percent) + 1

    def without(s: np.ndarray) -> list[bytes]:
        near = len(s) <= most and 100 * (len(s) - 1) >= percent * len(s)
        return [_name(np.delete(s, k)) for k in range(len(s))] if near and len(s) > 1 else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in _sets(batch, size):
                prefixes = [_prefix(_ordered(s, heavy), percent).view(np.int64) for s in sets]
                lengths = np.cumsum([0, *[len(p) for p in prefixes]])
                flat = np.concatenate(prefixes) if prefixes else np.zeros(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()),
                        part.column("text_key"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_name(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([_head(s, heavy, percent) if len(s) else None for s in sets], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(flat, pa.int64())),
                        pa.array([without(s) for s in sets], pa.list_(pa.binary())),
                    ],
                    names=["doc_id", "text_key", "n", "set_id", "head", "prefix", "without"],
                )

    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return keyed.mapInArrow(run, "doc_id long, text_key long, n long, set_id binary, head long, prefix array<long>, without array<binary>")


def heavy_shingles(docs: DataFrame, size: int, percent: int) -> Heavy:
    """The shingles in most prefixes of the plain order, sorted; at most HEAVY_MOST."""
    none = Heavy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in _sets(batch, size):
                found = [_prefix(_ordered(s, none), percent) for s in sets]
                if found:
                    shingles, times = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shingles.view(np.int64)), pa.array(times.astype(np.int64))], names=["shingle", "times"]
                    )

    counted = docs.select("text").mapInArrow(run, "shingle long, times long").groupBy("shingle").agg(F.sum("times").alias("times"))
    heaviest = counted.where(F.col("times") > HEAVY_FROM).orderBy(F.col("times").desc(), "shingle").limit(HEAVY_MOST)
    found = heaviest.toArrow()  # as rows they would take ten times the memory of the driver
    shingles = found["shingle"].to_numpy().view(np.uint64)
    order = np.argsort(shingles)
    return Heavy(shingles[order], found["times"].to_numpy()[order])


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Shared values of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def _union(members: list[tuple[bytes, np.ndarray]]) -> np.ndarray:
    return members[0][1] if len(members) == 1 else np.unique(np.concatenate([s for _, s in members]))


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of a symmetric relation that connect what it connects."""
    out, seen = [], np.zeros(len(linked), dtype=bool)
    for root in range(len(linked)):
        if seen[root]:
            continue
        seen[root], frontier = True, [root]
        while frontier:
            at = frontier.pop()
            for to in np.flatnonzero(linked[at] & ~seen):
                seen[to] = True
                frontier.append(int(to))
                out.append((at, int(to)))
    return out


def spanning_links(left: list[tuple[bytes, np.ndarray]], right: list[tuple[bytes, np.ndarray]] | None, percent: int) -> list[tuple[bytes, bytes]]:
    """Links that connect what is connected among the members of one group (right is None) or between two."""
    both = left + (right or [])
    if right is not None:
        if len(left) == len(right) == 1:  # most groups have one member, which then is its own union
            (a, x), (b, y) = left[0], right[0]
            common = _common(x, y)
            return [(a, b)] if 100 * common >= percent * (len(x) + len(y) - common) else []
        # The group bound, with whole unions: a member that shares too little with the other group's union is left out.
        unions = [_union(side) for side in (left, right)]
        sides = [
            [m for m in side if _common(m[1], other) >= fewest(len(m[1]), percent)]
            for side, other in ((left, unions[1]), (right, unions[0]))
        ]
        if not all(sides):
            return []
        both, border = sides[0] + sides[1], len(sides[0])
    lengths = np.array([len(s) for _, s in both])
    _, column, times = np.unique(np.concatenate([s for _, s in both]), return_inverse=True, return_counts=True)
    shared = times[column] > 1  # a shingle of one member only is in no overlap
    owner = np.repeat(np.arange(len(both)), lengths)[shared]
    _, column = np.unique(column[shared], return_inverse=True)
    overlap = np.zeros((len(both), len(both)), dtype=np.float32)
    columns = int(column.max()) + 1 if len(column) else 0
    width = max(1, min(columns, 4_000_000 // len(both)))
    for at in range(0, columns, width):
        here = (column >= at) & (column < at + width)
        present = np.zeros((len(both), width), dtype=np.float32)
        present[owner[here], column[here] - at] = 1.0
        overlap += present @ present.T
    common = np.rint(overlap).astype(np.int64)
    linked = 100 * common >= percent * (lengths[:, None] + lengths[None, :] - common)
    if right is not None:
        linked[:border, :border] = linked[border:, border:] = False
    np.fill_diagonal(linked, False)
    return [(both[x][0], both[y][0]) for x, y in forest(linked)]


def _group_pairs(classes: DataFrame, percent: int) -> DataFrame:
    """`left` and `right` (left <= right): the groups to open. ``classes`` has set_id, n, prefix and group."""
    # One exchange by shingle serves the union of the groups and both sides of the self-join.
    cells = classes.select(F.posexplode("prefix").alias("place", "shingle"), "group", "n").repartition("shingle")
    # Before the t-th shared shingle, t - 1 are shared, so the overlap is t - 1 + n - place at most; a link needs
    # percent * (n + other n) / (100 + percent). What a member has beyond its own part of that is left for the other's.
    spare = (F.col("n") - F.col("place") + REPEATS - 1) * (100 + percent) - F.col("n") * percent
    matrix = cells.groupBy("shingle", "group").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.max(spare).alias("spare")
    )
    a, b = matrix.alias("a"), matrix.alias("b")
    fits = (F.col("a.high") * 100 >= F.col("b.low") * percent) & (F.col("b.high") * 100 >= F.col("a.low") * percent)
    fits &= (F.col("a.spare") >= F.col("b.low") * percent) & (F.col("b.spare") >= F.col("a.low") * percent)
    met = a.join(b, (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.group") < F.col("b.group")) & fits)
    least = F.least(F.ceil(F.least("a.low", "b.low") * percent / 100), F.lit(REPEATS)).cast("int")
    shared = met.groupBy(F.col("a.group").alias("left"), F.col("b.group").alias("right")).agg(
        F.count("*").alias("shared"), F.min(least).alias("least")
    )
    own = classes.groupBy("group").agg(F.count("*").alias("members")).where("members > 1")
    return shared.where("shared >= least").select("left", "right").unionByName(
        own.select(F.col("group").alias("left"), F.col("group").alias("right"))
    )


def grouped_classes(signed: DataFrame, percent: int) -> DataFrame:
    """One row for each class that is not short, with its `group`, a block of the classes of one head."""
    first = signed.where(F.col("n") > short(percent)).groupBy("set_id").agg(
        F.min(F.struct("doc_id", "text_key", "n", "head", "prefix")).alias("one")
    ).select("set_id", "one.doc_id", "one.text_key", "one.n", "one.head", "one.prefix")
    blocks = first.groupBy("head").agg(
        F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_MEMBERS)).alias("blocks")
    )
    grouped = first.join(blocks, "head").withColumn("group", F.xxhash64("head", F.pmod(F.xxhash64("set_id"), "blocks")))
    return grouped.select("set_id", "doc_id", "text_key", "n", "prefix", "group")


def links(docs: DataFrame, rows: DataFrame, classes: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """`a` and `b`, set ids of linked classes; connects every two classes that links connect."""
    fewer = rows.where(F.size("without") > 0).select(F.col("set_id").alias("a"), F.explode("without").alias("b")).distinct()
    shorts = rows.where((F.col("n") > 0) & (F.col("n") <= short(percent))).select(F.col("set_id").alias("b")).distinct()
    one_less = fewer.join(shorts, "b").select("a", "b")
    pairs = stage(_group_pairs(classes, percent), "jaccard-pairs")
    opened = pairs.select("left").union(pairs.select("right")).distinct().withColumnRenamed("left", "group")
    needed = classes.select("set_id", F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key"), "group")
    needed = needed.join(opened, "group", "left_semi")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in _sets(batch, size):
                yield pa.RecordBatch.from_arrays(
                    [part.column("set_id"), part.column("group"), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["set_id", "group", "shingles"],
                )

    # One row stands for a class: copies of its text under other ids stay where they are. The needed rows grow with the
    # table, so they are met by an exchange at every size.
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    texts = keyed.join(needed.hint("merge"), F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key")))
    members = texts.dropDuplicates(["set_id"]).select("set_id", "group", "text")
    packed = members.mapInArrow(whole, "set_id binary, group long, shingles binary").groupBy("group").agg(
        F.collect_list(F.struct("set_id", "shingles")).alias("members")
    )
    packed = stage(packed, "jaccard-groups")
    a = packed.select(F.col("group").alias("left"), F.col("members").alias("left_members"))
    b = packed.select(F.col("group").alias("right"), F.col("members").alias("right_members"))
    alone = pairs.where("left = right").join(a, "left").select(
        "left_members", F.lit(None).cast(b.schema["right_members"].dataType).alias("right_members")
    )
    two = pairs.where("left < right").join(a, "left").join(b, "right").select("left_members", "right_members")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets(members: list | None) -> list[tuple[bytes, np.ndarray]] | None:
            return members and [(m["set_id"], np.frombuffer(m["shingles"], dtype=np.uint64)) for m in members]

        for batch in batches:
            for row in range(batch.num_rows):  # one pair at a time: a pair holds two blocks of members
                left, right = (sets(batch.column(k)[row].as_py()) for k in (0, 1))
                found = spanning_links(left, right, percent)
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())],
                        names=["a", "b"],
                    )

    compared = alone.unionByName(two).mapInArrow(compare, "a binary, b binary")
    return stage(compared.unionByName(one_less), "jaccard-links")


def components(edges: DataFrame, node: str = "binary") -> DataFrame:
    """`node` and `root` for every node with an edge; the root is the smallest node of its component."""
    edges = stage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components"
    )
    before = None
    while True:
        sign = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if (sign["n"], sign["x"]) == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = (sign["n"], sign["x"])
        # A round has no more edges than it began with and a node each, so it takes tasks by their number.
        tasks = -(-sign["n"] // EDGES_PER_TASK) or 1
        # Large star: every larger neighbour is linked to the smallest neighbour.
        around = edges.union(edges.select("b", "a"))
        least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = around.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").coalesce(tasks)
        # Small star: every smaller neighbour, and the node itself, is linked to the smallest one.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = least.select("a", F.col("m").alias("b"))
        edges = stage(small.union(own).where("a <> b").coalesce(tasks).distinct().coalesce(tasks), "components")


def rooted(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """`doc_id`, `text_key`, `n` and `root`, a name of the component (NULL for the empty set), for every row."""
    heavy = heavy_shingles(docs, size, percent)
    # The signatures hold every prefix; they go once the classes have them.
    with owned(docs.sparkSession) as tables:
        signed = stage(signatures(docs, size, percent, heavy), "jaccard-signatures")
        rows = stage(signed.select("doc_id", "text_key", "n", "set_id", "without"), "jaccard-rows")
        hand_on(tables)
        classes = stage(grouped_classes(signed, percent), "jaccard-classes")
        hand_on(tables)
    roots = components(links(docs, rows, classes, size, percent))
    # A large class is spread by AQE's skew join; the other side has one row per class.
    found = rows.select("doc_id", "text_key", "n", "set_id").join(roots, F.col("set_id") == F.col("node"), "left")
    return stage(found.select("doc_id", "text_key", "n", F.coalesce("root", "set_id").alias("root")), "jaccard-rooted")


def near_duplicates(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """`doc_id`, `text_key`, `n_shingles`, `component_id` for every row; texts without words have no component but their own."""
    rows = rooted(docs, size, percent)
    named = rows.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.withColumnRenamed("root", "of_root")
    return rows.join(named, F.col("root") == F.col("of_root"), "left").select(
        "doc_id",
        "text_key",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of every component, that of smallest id (NULL last), then of smallest text hash; all columns.

    Documents without words all stay. Of equal rows that represent a component one stays.
    """
    rows = rooted(docs, size, percent).where("n > 0")
    key = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    groups = rows.groupBy("root").agg(F.min(key).alias("best"), F.count("*").alias("rows")).where("rows > 1")
    groups = groups.withColumnRenamed("root", "of_root")
    several = rows.join(groups, F.col("root") == F.col("of_root")).select(
        F.col("doc_id").alias("s_id"),
        F.col("text_key").alias("s_key"),
        (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_key") == F.col("best.text_key"))).alias("once"),
    )
    several = stage(several.distinct(), "jaccard-several")
    names = {c: fresh(docs, c) for c in ("s_id", "s_key", "once")}
    several = several.withColumnsRenamed(names)
    same = F.col("doc_id").eqNullSafe(F.col(names["s_id"])) & (F.xxhash64("text") == F.col(names["s_key"]))
    found = docs.join(several, same, "left")
    alone = found.where(F.col(names["once"]).isNull()).select(*docs.columns)
    # Equal rows have the same place; of each, the first one that Spark meets stays.
    first = docs.join(several.where(names["once"]), same).dropDuplicates([names["s_id"], names["s_key"]]).select(*docs.columns)
    return alone.unionByName(first)


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id")
