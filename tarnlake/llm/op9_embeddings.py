"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, rerank with the original vectors.

A rotation for balanced binary codes is learned (alternating sign codes and the orthogonal Procrustes solution) from
at most `sample` vectors, chosen by a seeded hash of the id; every vector gets a code. The code is cut into tables of
some bits; vectors that share a label and a table's bits meet by their codes alone. Of these, the ones with a partner
within the codes' Hamming distance are candidates; they fetch their vectors, and the cosine is computed in double
precision. A pair belongs to the first table in which it agrees, so that it is counted once without listing pairs, and a
vector is fetched for few of its tables: a group returns counts and a spanning forest. Equal vectors are one class with a weight. A hot
bucket is compared by pairs of blocks (see common.deal). The bits of a table follow the size of the largest label, so
that a bucket holds about `block` vectors that agree by chance, and the number of tables follows the bits, so that a pair
at the least cosine is found with a probability of `recall` at every size: 8 tables of 8 bits up to 65,536 vectors of a
label, 26 of 16 bits up to 16.7 million, 74 of 24 bits beyond that.

Vectors that are null, empty, zero or hold a null or non-finite component, and rows with a null label, link with
nothing; vectors of different lengths never link. Rows that repeat count each. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_group, deal, forest, groups, looked_up, save, table
from .components import components


def shape(n: int, least: float, recall: float, block: int) -> tuple[int, int]:
    """Bytes of a table's key and number of tables for n vectors that may be compared with each other.

    Two vectors at cosine c differ in a bit with a probability of about acos(c) / pi.
    """
    width = 1
    while width < 4 and n > block << 8 * width:
        width += 1
    agree = (1 - math.acos(least) / math.pi) ** (8 * width)
    return width, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree))) if agree < 1 else 1


def learn(x: np.ndarray, bits: int, rounds: int = 30, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection of unit vectors x; as many rotations side by side as the bits need."""
    mean = x.mean(axis=0)
    centred = x - mean
    _, vectors = np.linalg.eigh(centred.T @ centred)
    d = x.shape[1]
    out = []
    for k in range(-(-bits // d)):
        rng = np.random.default_rng(seed + k)
        principal = vectors[:, ::-1][:, : min(d, bits)]
        v = centred @ principal
        r = np.linalg.qr(rng.normal(size=(v.shape[1], v.shape[1])))[0]
        for _ in range(rounds):
            b = np.where(v @ r >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(b.T @ v)
            r = right.T @ left.T
        out.append(principal @ r)
    return mean, np.concatenate(out, axis=1)[:, :bits]


def unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def coder(shared, kind: str):
    """(cid, label, size, code): the bytes of the tables' bits, and the vector's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column("v")
            size = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
            ends = np.cumsum(size)
            codes: list[bytes] = [b""] * b.num_rows
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                mean, projection = shared.value.get(int(d)) or (np.zeros(d), np.eye(d))
                raw = [flat[ends[i] - d : ends[i]].tobytes() for i in at]
                positive = (unit(raw, kind) - mean) @ projection >= 0
                for i, c in zip(at, np.packbits(positive, axis=1)):
                    codes[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays([b.column("cid"), b.column("label"), pa.array(size.astype(np.int32)), pa.array(codes, pa.binary())], names=["cid", "label", "size", "code"])

    return run


def code_rows(codes: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)


def first_shared(x: np.ndarray, y: np.ndarray, close: np.ndarray, width: int, number: int) -> tuple[np.ndarray, np.ndarray]:
    """The close pairs (of rows of x and y) for which this is the first table in which the codes agree."""
    i, j = np.nonzero(close)
    same = (x[i] == y[j]).reshape(len(i), x.shape[1] // width, width).all(axis=2)
    first = (same.argmax(axis=1) == number) & same.any(axis=1)
    return i[first], j[first]


def sides(size: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """The rows of a group to compare with each other, by length of vector: one, but for a collision of bucket numbers."""
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        a, b = at[side[at] == 0], at[side[at] == 1]
        alone = not len(a) or not len(b)
        yield (at, at, True) if alone else (a, b, False)


def prefilter(width: int, least: float):
    """(gid, side, t, cid, code) of the vectors with a partner for which the group's table is the first in common and whose codes differ in at most so many bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "gid"):
            if len(t) < 2:
                continue
            side, size, number = (t[c].to_numpy() for c in ("side", "size", "t"))
            code = t["code"].to_pylist()
            live = np.zeros(len(t), bool)
            for a, b, alone in sides(size, side):
                x, y = code_rows([code[i] for i in a]), code_rows([code[i] for i in b])
                x8, y8 = (np.unpackbits(z, axis=1).astype(np.float32) for z in (x, y))
                apart = x8.sum(axis=1)[:, None] + y8.sum(axis=1)[None] - 2 * (x8 @ y8.T)
                close = apart <= most_apart(least, 8 * x.shape[1], int(size[a[0]]))
                i, j = first_shared(x, y, np.triu(close, 1) if alone else close, width, int(number[a[0]]))
                live[a[i]] = live[b[j]] = True
            if live.any():
                yield t.select(["gid", "side", "t", "cid", "code"]).filter(pa.array(live)).combine_chunks().to_batches()[0]

    return run


def comparer(kind: str, least: float, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "gid"):
            if len(t) < 2:
                continue
            cid, weight, side, number = (t[c].to_numpy() for c in ("cid", "weight", "side", "t"))
            lists = t["v"].combine_chunks()
            size = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
            raw = [flat[e - n : e].tobytes() for e, n in zip(np.cumsum(size), size)]
            code = t["code"].to_pylist()
            lefts, rights = [], []
            for a, b, alone in sides(size, side):
                close = unit([raw[i] for i in a], kind) @ unit([raw[i] for i in b], kind).T >= least
                i, j = first_shared(code_rows([code[i] for i in a]), code_rows([code[i] for i in b]), np.triu(close, 1) if alone else close, width, int(number[a[0]]))
                lefts.append(a[i])
                rights.append(b[j])
            i, j = np.concatenate(lefts), np.concatenate(rights)
            if not len(i):
                continue
            n = np.bincount(i, weight[j], len(t)) + np.bincount(j, weight[i], len(t))
            label = forest(len(t), i, j)
            on = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(cid[on]), pa.array(n[on].astype(np.int64)), pa.array(cid[label[on]])], names=["cid", "n", "root"])

    return run


def most_apart(least: float, bits: int, size: int) -> float:
    """Bits in which vectors at the least cosine differ at most: four deviations above what is expected.

    The bits of one rotation are as good as free; those of several over the same components depend on each other.
    """
    p = math.acos(max(-1.0, min(1.0, least))) / math.pi
    return bits * p + 4 * math.sqrt(bits * p * (1 - p)) * (1.0 if bits <= size else 1.5)


def near(spark: SparkSession, vectors: DataFrame, least: float = 0.93, recall: float = 0.97, tables: tuple[int, int] | None = None, sample: int = 10_000, block: int = 256, seed: int = 2) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of (vec_id, embedding, label). tables: bytes of a key and number of tables, if shape() shall not choose."""
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    v = F.transform("embedding", lambda e: e.cast("float" if kind == "<f4" else "double") + F.lit(0.0).cast("float" if kind == "<f4" else "double"))  # -0.0 becomes 0.0
    usable = F.col("label").isNotNull() & F.coalesce(F.size("embedding") > 0, F.lit(False)) & F.forall("embedding", lambda e: F.coalesce((F.abs(e) < float("inf")) & ~F.isnan(e), F.lit(False))) & F.exists("embedding", lambda e: e != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), "label", F.when(usable, v).alias("v")).select("*", F.when(F.col("v").isNotNull(), F.xxhash64("label", "v")).alias("h1"), F.xxhash64(F.lit(seed), "v", "label").alias("h2"))
    classes = save(spark, rows.where("v is not null").groupBy("h1", "h2", "label").agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("first")).withColumn("cid", F.xxhash64("h1", "h2")), "vectors")
    width, number = tables or shape(classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0, least, recall, block)
    bits = 8 * width * number
    chosen = classes.orderBy(F.xxhash64("cid", F.lit(seed))).select("v").limit(sample).toPandas()
    by_size: dict[int, list] = {}
    for x in chosen.v if len(chosen) else []:
        by_size.setdefault(len(x), []).append(np.asarray(x, kind).tobytes())
    shared = spark.sparkContext.broadcast({d: learn(unit(x, kind), bits) for d, x in by_size.items()})
    coded = classes.select("cid", "label", "v").mapInArrow(coder(shared, kind), f"cid long, label {classes.schema['label'].dataType.simpleString()}, size int, code binary")
    keyed = coded.select("cid", "size", "code", F.explode(F.sequence(F.lit(0), F.greatest(F.octet_length("code") / width, F.lit(1)).cast("int") - 1)).alias("t"), "label")
    keyed = keyed.withColumn("bucket", F.xxhash64("label", "size", "t", F.expr(f"substring(code, t * {width} + 1, {width})"))).drop("label")
    live = by_group(deal(spark, keyed, "cid", block), "gid", "side").mapInArrow(prefilter(width, least), "gid long, side int, t int, cid long, code binary")
    live = save(spark, live, "vector-candidates")
    met = live.join(classes.select("cid", "weight", "v"), "cid")  # both have each cid a bounded number of times
    found = save(spark, by_group(met, "gid", "side").mapInArrow(comparer(kind, least, width), "cid long, n long, root long"), "vector-links")
    reach = components(spark, found.where("cid <> root").select(F.greatest("cid", "root").alias("child"), F.least("cid", "root").alias("parent")))
    counts = found.groupBy("cid").agg(F.sum("n").alias("n"))
    named = classes.select("cid", "h1", "h2", "weight", "first").join(counts, "cid", "left").join(reach, F.col("cid") == F.col("child"), "left").select("h1", "h2", "first", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("parent", "cid").alias("root"))
    named = save(spark, named, "vector-roots")
    roots = save(spark, named.groupBy("root").agg(F.min("first").alias("component_id")), "vector-components")
    of = save(spark, looked_up(spark, named, roots, ["root"]).select("h1", "h2", "n_links", "component_id"), "vector-classes")
    out = looked_up(spark, rows.select("vec_id", "h1", F.when(F.col("h1").isNotNull(), F.col("h2")).alias("h2")), of, ["h1", "h2"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(spark, table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
