"""SimHash near-dedup for the pipeline: bit-sliced comparison, then exact likeness of sets of five-word shingles.

A text's SimHash is that of its set of shingles. At a Jaccard likeness of 0.8 two of them differ in about ten of 64 bits,
too many for op5_simhash's tables of shared blocks, so MinHash bands propose what may link: 32 bands of five minima, of
which a pair at 0.8 shares none once in 300,000 times and a closer pair still more seldom. Proposals join documents to
candidate components. Inside one, the bit-sliced comparison of op5_simhash gives up pairs that differ in over `radius`
bits (26, over four deviations from what 0.8 leaves to expect even for a handful of shingles), and the others are decided
on their whole shingle sets. Equal sets are one node, whatever their number. A component of over `block` nodes is compared
by pairs of blocks, each in a group of its own; a group returns a spanning forest of what it has linked.

A text of fewer words than a shingle has is one shingle; texts without words are one node. Rows with a null doc_id link
like any other; their component is null unless a document with an id links to them. Rows that repeat get the same row
each. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_group, deal, give_back, groups, looked_up, save, slices, small
from .components import components
from .op5_simhash import majority, pairs, shingles

BANDS, ROWS = 32, 5
FACTORS = np.random.default_rng(17).integers(0, 1 << 63, BANDS * ROWS, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str, words: int, seed: int) -> np.ndarray:
    return np.unique(shingles(text, words, seed))


def node_of(found: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(found.tobytes(), 1)


def minima(found: np.ndarray) -> np.ndarray:
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(found), 2048):
        np.minimum(least, (found[a : a + 2048, None] * FACTORS).min(axis=0), out=least)
    return least


def banded(words: int, seed: int):
    """(doc_id, text_hash, node, bands) of each row; no bands without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                sets = [shingle_set(x, words, seed) for x in pc.fill_null(batch.column("text"), "").to_pylist()]
                node = np.fromiter(map(node_of, sets), np.uint64, len(sets))
                some = [minima(x) for x in sets if len(x)]
                least = np.array(some, np.uint64).reshape(len(some), BANDS, ROWS)
                key = np.zeros((len(some), BANDS), np.uint64)
                for r in range(ROWS):
                    key = (key ^ least[:, :, r]) * MIX
                    key ^= key >> np.uint64(29)
                ends = np.cumsum([0, *(BANDS * bool(len(x)) for x in sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(node.view(np.int64)), pa.ListArray.from_arrays(ends, pa.array(key.ravel().view(np.int64)))], names=["doc_id", "text_hash", "node", "bands"])
        give_back()

    return run


def with_sets(words: int, seed: int):
    """(node, shingles) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                sets = [shingle_set(x, words, seed) for x in pc.fill_null(batch.column("text"), "").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.fromiter(map(node_of, sets), np.uint64, len(sets)).view(np.int64)), pa.array([x.tobytes() for x in sets], pa.binary())], names=["node", "shingles"])
        give_back()

    return run


def linked(sets: list[np.ndarray], side: np.ndarray, tenths: int, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of at least so many tenths of Jaccard likeness, between the sides where there are two. Rows come by side."""
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    fps = np.fromiter(map(majority, sets), np.uint64, len(sets))
    out = []
    for left, right in pairs(fps, np.zeros(len(sets), np.int64), side, radius):
        for i, j in zip(left.tolist(), right.tolist()):
            if (x := find(i)) == (y := find(j)):
                continue
            a, b = len(sets[i]), len(sets[j])
            if min(a, b) * 10 < max(a, b) * tenths:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both * 10 >= tenths * (a + b - both):
                root[y] = x
                out.append((i, j))
    return out


def linker(tenths: int, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "gid"):
            node = t["node"].to_numpy()
            found = linked([np.frombuffer(x, np.uint64) for x in t["shingles"].to_pylist()], t["side"].to_numpy(), tenths, radius)
            if found:
                left, right = node[np.array(found)].T
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(left, right)), pa.array(np.minimum(left, right))], names=["child", "parent"])

    return run


def row_key(doc: str, text_hash: Column) -> Column:
    """An id, null or not, and the hash of a text, as one value to join by."""
    return F.struct(F.coalesce(F.col(doc).cast("long"), F.lit(0)).alias("id"), F.col(doc).isNull().alias("none"), text_hash.alias("text"))


def near(spark: SparkSession, docs: DataFrame, rows: DataFrame, words: int, tenths: int, radius: int, seed: int, block: int) -> DataFrame:
    """(child, parent): what each node reaches by links; rows: banded() of docs."""
    keyed = rows.dropDuplicates(["node"]).select("node", F.posexplode("bands").alias("band", "key")).select("node", F.xxhash64("band", "key").alias("bucket"))
    keyed = save(spark, keyed, "bands")
    least = save(spark, keyed.groupBy("bucket").agg(F.min("node").alias("parent"), F.count("*").alias("n")).where("n > 1").select("bucket", "parent"), "band-minima")
    stars = looked_up(spark, keyed, least, ["bucket"]).where("node > parent").select(F.col("node").alias("child"), "parent")
    reach = save(spark, components(spark, stars), "candidates")
    members = save(spark, reach.select(F.col("child").alias("node"), F.col("parent").alias("bucket")).unionByName(reach.select(F.col("parent").alias("node"), F.col("parent").alias("bucket")).distinct()), "members")
    # one row of each candidate node gives its set; which one does not matter, since their sets are equal
    first = rows.join(small(members.select("node")), "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("at")).select("node", "at.*")
    first = first.select(row_key("doc_id", F.col("text_hash")).alias("key")).distinct()
    texts = docs.select(row_key("doc_id", F.xxhash64("text")).alias("key"), "text").join(small(first, 200_000), "key", "left_semi")
    sets = texts.select("text").mapInArrow(with_sets(words, seed), "node long, shingles binary")
    dealt = save(spark, sets.join(small(members), "node").dropDuplicates(["node"]).select("node", "bucket", "shingles"), "sets")
    links = by_group(deal(spark, dealt, "node", block), "gid", "side", "node").mapInArrow(linker(tenths, radius), "child long, parent long")
    return components(spark, links)


def classes(spark: SparkSession, docs: DataFrame, words: int = 5, tenths: int = 8, radius: int = 26, seed: int = 42, block: int = 512) -> DataFrame:
    """(doc_id, text_hash, component_id, root) for each row; root names the component also where no row has an id."""
    found = docs.select(F.col("doc_id").cast("long"), "text").withColumn("text_hash", F.xxhash64("text")).mapInArrow(banded(words, seed), "doc_id long, text_hash long, node long, bands array<long>")
    rows = save(spark, found, "near-copies")
    reach = near(spark, docs, rows, words, tenths, radius, seed, block)
    of = rows.groupBy("node").agg(F.min("doc_id").alias("first")).join(small(reach), F.col("node") == F.col("child"), "left").select("node", "first", F.coalesce("parent", "node").alias("root"))
    roots = save(spark, of, "roots")
    ids = save(spark, roots.groupBy("root").agg(F.min("first").alias("component_id")), "component-ids")
    named = save(spark, looked_up(spark, roots, ids, ["root"]).select("node", "root", "component_id"), "components")
    return looked_up(spark, rows.select("doc_id", "text_hash", "node"), named, ["node"]).select("doc_id", "text_hash", "component_id", "root")


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Of each group of near copies one row, with the columns of docs: that of the smallest (doc_id, hash of the text), a null id being the largest.

    Texts that are no near copies all stay, also where they share a doc_id; rows equal in id and text are one row.
    """
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    rows = save(spark, classes(spark, docs).groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n")), "dedup-rows")
    best = save(spark, rows.groupBy("root").agg(F.min(rank).alias("best")), "dedup-best")
    judged = looked_up(spark, rows, best, ["root"]).select("doc_id", "text_hash", "n", (rank == F.col("best")).alias("stays"))
    judged = save(spark, judged.where("not stays or n > 1"), "dedup-judged")
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), row_key("doc_id", F.xxhash64("text")).alias("key"))
    goes = judged.where("not stays").select(row_key("doc_id", F.col("text_hash")).alias("key"))
    named = looked_up(spark, named, goes, ["key"], "left_anti", few=200_000)
    twice = judged.where("stays").select(row_key("doc_id", F.col("text_hash")).alias("key"))
    if twice.limit(1).count():
        named = named.join(small(twice), "key", "left_anti").unionByName(named.join(small(twice), "key", "left_semi").dropDuplicates(["key"]))
    return named.select("row.*")
