"""SimHash near-dedup: equal blocks of bits give candidates, bit-sliced comparison with carry-save counters decides.

Fingerprint: 64 bits by majority over the XXH64 of all word shingles of the whole text. Two of them link if at most
`radius` bits differ. With the 64 bits cut into b blocks, two linked ones agree on at least b - radius blocks, so a
table for each choice of b - radius blocks finds every link: nothing is lost for any b. b follows the number of
different fingerprints, so that a bucket holds few that agree by chance. Equal fingerprints are one node, whatever
their number. A bucket of over `block` fingerprints is compared by pairs of blocks, each in a group of its own; a
group returns a spanning forest of what it has linked, never all pairs.

A null, empty or blank text has fingerprint zero and links like any other; a text of fewer words than a shingle has
is one shingle. Rows with a null doc_id are fingerprinted; their component is null unless a document with an id links
to them. Rows that repeat get the same row each. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_group, deal, forest, looked_up, many_groups, save, slices, small, table
from .components import components

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(text: str, words: int, seed: int) -> np.ndarray:
    """XXH64 of each run of so many words; a shorter text is one run, one without words none."""
    from xxhash import xxh64_intdigest

    parts = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: only A-Z change, only ASCII white space splits
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(words, len(parts)) - 1
    last = len(starts) - k
    return np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[:last].tolist(), ends[k:].tolist())), np.uint64, last)


def majority(hashes: np.ndarray) -> int:
    """64 bits, each 1 if set in over half the hashes."""
    last = len(hashes)
    if not last:
        return 0
    counts = np.zeros(64, np.int64)
    for a in range(0, last, 1 << 16):
        counts += np.unpackbits(hashes[a : a + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > last, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str, words: int = 4, seed: int = 42) -> int:
    return majority(shingles(text, words, seed))


def fingerprints(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 16 << 20):
                found = np.fromiter((fingerprint(x, words, seed) for x in pc.fill_null(batch.column("text"), "").to_pylist()), np.uint64, batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return run


def tables(n: int, radius: int, per_bucket: int = 64) -> list[int]:
    """Bit masks of which two fingerprints within the radius share the bits of one at least."""
    blocks = radius + 1
    while True:
        edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
        masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
        keys = [sum(c) for c in combinations(masks, blocks - radius)]
        if n / per_bucket <= 1 << min(k.bit_count() for k in keys) or blocks >= radius + 4:
            return keys
        blocks += 1


def planes(words: np.ndarray) -> np.ndarray:
    """Bit planes of rows of 64 fingerprints: word [b, w] has bit b of each of the 64."""
    bits = np.unpackbits(words.view(np.uint8), bitorder="little").reshape(-1, 64, 64)
    return np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")).view(np.uint64)[:, :, 0]


def within(query: np.ndarray, sliced: np.ndarray, at: np.ndarray, valid: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For cells (query, row of 64): the lanes within the radius, as (cell, lane) pairs.

    Carry-save counters add one bit of the distance of 64 pairs at a time; `over` keeps lanes whose count has passed
    the radius. Every eight planes cells without a lane left are given up.
    """
    top = (radius + 1).bit_length()
    cells = np.arange(len(query))
    count = [np.zeros(len(query), np.uint64) for _ in range(top)]
    live = valid.copy()
    for b in range(64):
        carry = sliced[b, at] ^ (np.uint64(0) - (query >> np.uint64(b) & np.uint64(1)))
        for k in range(top):
            count[k], carry = count[k] ^ carry, count[k] & carry
        live &= ~carry  # the counter ran over
        # lanes whose count equals radius + 1
        hit = np.full(len(query), ONES)
        for k in range(top):
            hit &= count[k] if (radius + 1) >> k & 1 else ~count[k]
        live &= ~hit
        if b % 8 == 7 and not (keep := live != 0).all():
            cells, query, at, live = cells[keep], query[keep], at[keep], live[keep]
            count = [c[keep] for c in count]
            if not len(cells):
                break
    bits = np.unpackbits(live.view(np.uint8), bitorder="little").reshape(-1, 64)
    rows, lanes = np.nonzero(bits)
    return cells[rows], lanes


def pairs(fps: np.ndarray, gid: np.ndarray, side: np.ndarray, radius: int, cells_at_once: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the fingerprints of a group within the radius, between its sides where it has two. Rows come by group, side and fingerprint."""
    n = len(fps)
    run = np.concatenate([[True], (gid[1:] != gid[:-1]) | (side[1:] != side[:-1])])
    first = np.flatnonzero(run)
    size = np.diff(np.append(first, n))
    words = -(-size // 64)
    word_at = np.concatenate([[0], np.cumsum(words)])
    # every run gets whole rows of 64 lanes
    run_of = np.cumsum(run) - 1
    lane_of = word_at[run_of] * 64 + np.arange(n) - first[run_of]
    lanes = np.zeros(word_at[-1] * 64, np.uint64)
    lanes[lane_of] = fps
    back = np.full(len(lanes), -1)
    back[lane_of] = np.arange(n)
    sliced = planes(lanes.reshape(-1, 64))
    used = np.packbits(back.reshape(-1, 64) >= 0, axis=1, bitorder="little").view(np.uint64)[:, 0]
    # side 0 is compared with side 1 where there is one, else with itself from its own row of lanes on
    paired = np.concatenate([(gid[first[1:]] == gid[first[:-1]]), [False]]) if len(first) > 1 else np.array([False])
    other = np.where(paired[run_of], run_of + 1, run_of)
    begin = np.where(paired[run_of], word_at[other], lane_of // 64)
    begin = np.where(side == 1, word_at[other + 1], begin)
    cells = word_at[other + 1] - begin
    if (alone := (side == 1) & ~np.concatenate([[False], paired[:-1]])[run_of]).any():  # the first block may be empty
        begin, cells = np.where(alone, lane_of // 64, begin), np.where(alone, word_at[run_of + 1] - lane_of // 64, cells)
    ends = np.cumsum(cells)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + cells_at_once, "right")))
        of = np.repeat(np.arange(a, b), cells[a:b])
        at = np.arange(len(of)) - np.repeat(ends[a:b] - cells[a:b] - (ends[a - 1] if a else 0), cells[a:b]) + begin[of]
        cell, lane = within(fps[of], sliced, at, used[at], radius)
        left, right = of[cell], back[at[cell] * 64 + lane]
        yield left[left != right], right[left != right]
        a = b


def linked(fps: np.ndarray, gid: np.ndarray, side: np.ndarray, radius: int) -> np.ndarray:
    """The smallest index that each fingerprint reaches inside its group."""
    n = len(fps)
    label = np.arange(n)
    lefts, rights = [], []
    for left, right in pairs(fps, gid, side, radius):
        lefts.append(left)
        rights.append(right)
        if sum(map(len, lefts)) > 1 << 22:
            label = forest(n, np.concatenate([*lefts, np.arange(n)]), np.concatenate([*rights, label]))
            lefts, rights = [], []
    return forest(n, np.concatenate([*lefts, np.arange(n)]), np.concatenate([*rights, label]))


def linker(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in many_groups(batches, "gid", 1 << 15):
            gid, side, fp = (t[c].to_numpy() for c in ("gid", "side", "fp"))
            label = linked(fp.astype(np.int64).view(np.uint64), gid, side, radius)
            child, parent = np.maximum(fp, fp[label]), np.minimum(fp, fp[label])
            keep = child != parent
            yield pa.RecordBatch.from_arrays([pa.array(child[keep]), pa.array(parent[keep])], names=["child", "parent"])

    return run


def near(spark: SparkSession, fps: DataFrame, radius: int = 4, block: int = 512) -> DataFrame:
    """(child, parent): what each different fp reaches, by links of at most `radius` bits."""
    nodes = save(spark, fps.select("fp").distinct(), "fingerprints")
    masks = tables(nodes.count(), radius)
    keys = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("key")) for t, m in enumerate(masks))))
    keyed = nodes.select("fp", keys.alias("k")).select("fp", F.xxhash64("k.t", "k.key").alias("bucket"))
    rows = deal(spark, keyed, "fp", block)
    links = by_group(rows, "gid", "side", "fp").mapInArrow(linker(radius), "child long, parent long")
    return components(spark, links)


def classes(spark: SparkSession, docs: DataFrame, words: int = 4, radius: int = 4, seed: int = 42, block: int = 512) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row."""
    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(fingerprints(words, seed), "doc_id long, fp long")
    fps = save(spark, found, "simhash")
    reach = near(spark, fps, radius, block)
    of = fps.groupBy("fp").agg(F.min("doc_id").alias("first")).join(small(reach), F.col("fp") == F.col("child"), "left").select("fp", "first", F.coalesce("parent", "fp").alias("root"))
    roots = save(spark, of, "roots")
    ids = save(spark, roots.groupBy("root").agg(F.min("first").alias("component_id")), "component-ids")
    named = save(spark, looked_up(spark, roots, ids, ["root"]).select("fp", "component_id"), "components")
    return looked_up(spark, fps, named, ["fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark, table(spark, sf_dir, "documents"))
