"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is that of its hash plus that of the hash of its first letters. Filters of several widths run over
the whole text, the largest response of each is kept, and a logistic layer gives the score. Buckets that fewer than
`common` learning documents hold have no embedding, so that a rare word says nothing by itself. Two components of an
embedding begin as the log odds of its bucket among toxic documents; all weights are then trained by Adam. Every labelled
document is learned from, whole, in each epoch, one row of each id. The threshold of each language (the cut with the best
F1; where a language has fewer than `least` toxic ones held back, the default) needs scores of documents that a net didn't
learn from: a net of four fifths of the ids, by a seeded hash, scores all of the last fifth. That net serves for nothing
else. The language only picks the threshold; it is no input of the score.

Learning is dealt over tasks: ids fall by a seeded hash into shards of about `sample` documents, and of about `most_bytes`
of text; a shard is stored in rows of about PART bytes, in pages of one or two rows, and READ rows are decoded at a time,
so that a task's buffers do not follow the size of its file. In an epoch each shard trains a copy of the weights by steps
of 64 documents; the mean of the copies, by documents, begins the next epoch, and Adam's moments begin anew. Only weights
and counts of buckets, whose number has a bound, reach the driver.

Null texts and texts without letters score what the model gives to no response at all. Labels that are null, or whose
document is missing, are not learned from. With no toxic or no other label every score is 0. Rows that repeat are
scored each. Further columns of the input play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from copy import copy
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LARGE_ROWS, by_group, few_rows_read, give_back, groups, letter_words, looked_up, row_columns, save, scored, slices, small, table

BUCKETS = 1 << 17
PREFIX = 5
WIDTHS = (1, 2, 3)
FILTERS = 12
SIZE = 12
CUT = 0.7
WORDS = 1 << 16  # about so many at a time, of whole texts
CHUNK = 1 << 16
PART = 1 << 20
READ = 4  # rows of about PART bytes that a task decodes at a time
BLOCK = "shard long, docs long, bad long, toxic binary, langs array<string>, lengths binary, tokens binary"


def buckets(words: list[str]) -> np.ndarray:
    """Two buckets for each word: of the word, and of its first letters."""
    coded = [w.encode("utf-8", "surrogatepass") for w in words]
    first = [w[:PREFIX].encode("utf-8", "surrogatepass") for w in words]
    return np.array([np.fromiter(map(zlib.crc32, coded), np.int64, len(words)) % BUCKETS, np.fromiter((zlib.crc32(x, 1) for x in first), np.int64, len(words)) % BUCKETS])


def learning_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label_id, toxic, lang, shard, fold, tokens): the buckets of the words, two int32 each."""
    kept = ["label_id", "toxic", "lang", "shard", "fold"]
    give_back()
    for whole in batches:
        for batch in slices(whole, "text"):
            which, words, bounds = letter_words(batch.column("text"))
            both = buckets(words).astype("<i4")[:, which]
            data = [np.ascontiguousarray(both[:, a:b]).tobytes() for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(data, pa.binary())], names=[*kept, "tokens"])


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of about PART bytes for each shard and fold: how many documents, how many toxic, and their labels, languages, numbers of words and tokens one after the other."""
    schema = pa.schema([("fold", pa.int32()), ("shard", pa.int64()), ("docs", pa.int64()), ("bad", pa.int64()), ("toxic", pa.binary()), ("langs", pa.list_(pa.string())), ("lengths", pa.binary()), ("tokens", pa.binary())])

    def row(key: tuple, docs: list[tuple]) -> pa.RecordBatch:
        toxic, langs, tokens = zip(*docs)
        lengths = np.array([len(x) // 8 for x in tokens], "<i8")
        own = {"fold": key[1], "shard": key[0], "docs": len(docs), "bad": sum(toxic), "toxic": bytes(toxic), "langs": langs, "lengths": lengths.tobytes(), "tokens": b"".join(tokens)}
        return pa.RecordBatch.from_pylist([own], schema)

    last, held, size = None, [], 0
    for batch in batches:
        keys = zip(batch.column("shard").to_pylist(), batch.column("fold").to_pylist())
        for key, toxic, lang, tokens in zip(keys, batch.column("toxic").to_pylist(), batch.column("lang").to_pylist(), batch.column("tokens")):
            tokens = tokens.as_py()
            if held and (key != last or size + len(tokens) > PART):
                yield row(last, held)
                held, size = [], 0
            last, size = key, size + len(tokens)
            held.append((toxic, lang, tokens))
    if held:
        yield row(last, held)


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, list, list[np.ndarray]]]:
    """(shard, toxic, langs, tokens of each document)"""
    for batch in batches:
        for k in range(batch.num_rows):
            shard, toxic, langs, lengths, tokens = (batch.column(c)[k] for c in ("shard", "toxic", "langs", "lengths", "tokens"))
            flat, ends = np.frombuffer(tokens.as_buffer(), "<i4"), 2 * np.cumsum(np.frombuffer(lengths.as_buffer(), "<i8"))
            yield shard.as_py(), np.frombuffer(toxic.as_buffer(), "u1") == 1, langs.as_py(), [x.reshape(2, -1) for x in np.split(flat, ends[:-1])]


def whole_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """(shard, toxic, tokens of each document), from a shard's rows one after the other"""
    for shard, rows in groupby(unpacked(batches), lambda row: row[0]):
        toxic, tokens = zip(*((y, t) for _, y, _, t in rows))
        yield shard, np.concatenate(toxic), [x for t in tokens for x in t]


def bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(which, bucket, clean, toxic): documents that have the bucket."""
    held = np.zeros((2, 2, BUCKETS), np.int64)
    for _, toxic, _, tokens in unpacked(batches):
        for t, y in zip(tokens, toxic):
            for i in range(2):
                held[i, int(y), np.unique(t[i])] += 1
    which, bucket = np.nonzero(held.sum(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(which.astype("i4")), pa.array(bucket.astype("i4")), pa.array(held[which, 0, bucket]), pa.array(held[which, 1, bucket])], names=["which", "bucket", "clean", "toxic"])


def some_texts(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of about WORDS words in all, one at least, so that memory does not follow the number of texts."""
    bounds, a = np.concatenate([[0], np.cumsum(lengths)]), 0
    while a < len(lengths):
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + WORDS, "right")) - 1)
        yield a, b
        a = b


class Net:
    """Weights, the known buckets, and scores of texts."""

    def __init__(self, known: list[np.ndarray], rng: np.random.Generator):
        self.id = [np.zeros(BUCKETS, np.int32) for _ in known]
        for table_, k in zip(self.id, known):
            table_[k] = np.arange(1, len(k) + 1)
        self.w = {f"e{i}": rng.normal(0, 0.05, (len(k) + 1, SIZE)).astype(np.float32) for i, k in enumerate(known)}
        for n in WIDTHS:
            self.w[f"f{n}"] = rng.normal(0, 0.15, (n, SIZE, FILTERS)).astype(np.float32)
            self.w[f"f{n}"][:, :2, :4] += 0.5 / n
            self.w[f"b{n}"] = np.zeros(FILTERS, np.float32)
        self.w["v"] = rng.normal(0.2, 0.1, FILTERS * len(WIDTHS)).astype(np.float32)
        self.w["c"] = np.full(1, -2, np.float32)

    def pooled(self, ids: np.ndarray, bounds: np.ndarray, at: bool = False):
        """The largest response of each filter for each text (0 if none), and where it was. ids: two rows, 0 for unknown."""
        n, gap = len(bounds) - 1, max(WIDTHS) - 1
        out, places = np.zeros((n, FILTERS * len(WIDTHS)), np.float32), np.full((n, FILTERS * len(WIDTHS)), -1)
        starts = bounds[:-1] + gap * np.arange(n)  # so many unknown words follow each text, so that no window reads the next
        wide = np.zeros((2, ids.shape[1] + gap * n), np.int32)
        wide[:, np.arange(ids.shape[1]) + np.repeat(starts - bounds[:-1], np.diff(bounds))] = ids
        x = self.w["e0"].take(wide[0], axis=0)
        x += self.w["e1"].take(wide[1], axis=0)
        full = np.flatnonzero(bounds[1:] > bounds[:-1])
        sides = np.stack([starts, starts + np.diff(bounds)], axis=1)[full]
        for k, width in enumerate(WIDTHS):
            y = x @ self.w[f"f{width}"][0]
            for j in range(1, width):
                y[:-j] += x[j:] @ self.w[f"f{width}"][j]
            y += self.w[f"b{width}"]
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            if len(full):
                out[full, cols] = np.maximum(np.maximum.reduceat(y, sides.ravel(), axis=0)[::2], 0)
                if at:
                    for d, (a, b) in zip(full, sides):
                        places[d, cols] = bounds[d] + y[a:b].argmax(axis=0)
        return (out, places, np.repeat(bounds[1:], np.diff(bounds))) if at else out

    def logits(self, pool: np.ndarray) -> np.ndarray:
        return pool @ self.w["v"] + self.w["c"][0]

    def step(self, ids: np.ndarray, bounds: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted log loss."""
        pool, places, ends = self.pooled(ids, bounds, True)
        p = 1 / (1 + np.exp(-self.logits(pool)))
        d = ((p - y) * weight / len(y)).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        g["v"], g["c"] = pool.T @ d, np.array([d.sum()], np.float32)
        back = d[:, None] * self.w["v"] * (pool > 0)
        x = [self.w[f"e{i}"] for i in range(2)]
        for k, width in enumerate(WIDTHS):
            for f in range(FILTERS):
                c = k * FILTERS + f
                on = np.flatnonzero(back[:, c])
                at, b = places[on, c], back[on, c]
                g[f"b{width}"][f] = b.sum()
                for j in range(width):
                    inside = at + j < ends[at]
                    i, bj = at[inside] + j, b[inside]
                    g[f"f{width}"][j, :, f] = (x[0][ids[0, i]] + x[1][ids[1, i]]).T @ bj
                    for e in range(2):
                        np.add.at(g[f"e{e}"], ids[e, i], bj[:, None] * self.w[f"f{width}"][j, :, f])
        for e in range(2):
            g[f"e{e}"][0] = 0
        return g

    def score(self, texts: pa.Array) -> np.ndarray:
        which, words, bounds = letter_words(texts)
        both = buckets(words)
        ids = np.array([self.id[i][both[i]] for i in range(2)])[:, which]
        return self.scores(ids, bounds)

    def scores(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        out = np.zeros(len(bounds) - 1)
        for a, b in some_texts(np.diff(bounds)):
            out[a:b] = self.logits(self.pooled(ids[:, bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]))
        return 1 / (1 + np.exp(-out))


def flat(net: Net) -> np.ndarray:
    return np.concatenate([v.ravel() for v in net.w.values()])


def load(net: Net, weights: np.ndarray) -> None:
    at = 0
    for k, v in net.w.items():
        net.w[k] = weights[at : at + v.size].reshape(v.shape).astype(np.float32)
        at += v.size


def learn(net: Net, tokens: list[np.ndarray], toxic: np.ndarray, lr: float, rng: np.random.Generator) -> None:
    """One epoch of Adam, by steps of 64 documents. Of embeddings a step moves those that the gradient reaches."""
    mean, square = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2))
    order = rng.permutation(len(tokens))
    for n, first in enumerate(range(0, len(order), 64), 1):
        part, g = order[first : first + 64], None
        for a, b in some_texts(np.array([tokens[i].shape[1] for i in part])):
            some = part[a:b]
            bounds = np.concatenate([[0], np.cumsum([tokens[i].shape[1] for i in some])])
            words = np.concatenate([tokens[i] for i in some], axis=1)
            more = net.step(np.array([net.id[i][words[i]] for i in range(2)]), bounds, toxic[some].astype(np.float32), np.full(len(some), len(some) / len(part), np.float32))
            g = more if g is None else {k: g[k] + more[k] for k in g}
        for k, v in net.w.items():
            on = np.flatnonzero(np.abs(g[k]) @ np.ones(SIZE, np.float32)) if k in ("e0", "e1") else slice(None)
            mean[k][on] += 0.1 * (g[k][on] - mean[k][on])
            square[k][on] += 0.001 * (g[k][on] ** 2 - square[k][on])
            v[on] -= lr * ((mean[k][on] / (1 - 0.9**n)) / (np.sqrt(square[k][on] / (1 - 0.999**n)) + 1e-7) + 1e-3 * v[on] * (k != "c"))


def averaged(blocks: DataFrame, net: Net, lr: float, seed: int) -> np.ndarray:
    """The mean of the weights, by documents, after each shard went over its own once."""
    shared = blocks.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, start = copy(shared.value), flat(shared.value)  # a worker's tasks share the net; its weights stay
        own.w, total, docs, first = dict(own.w), 0, 0, None
        for shard, toxic, tokens in whole_shards(batches):
            load(own, start)
            learn(own, tokens, toxic, lr, np.random.default_rng([seed, shard]))
            total, docs, first = total + (flat(own) - start) * np.float32(len(toxic)), docs + len(toxic), shard if first is None else first
        if docs:
            parts = [total[a : a + CHUNK].astype("<f4").tobytes() for a in range(0, len(total), CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int64()), pa.array([first] * len(parts), pa.int64()), pa.array([docs] * len(parts), pa.int64()), pa.array(parts, pa.binary())], names=["chunk", "first", "docs", "part"])

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "chunk"):
            total = sum(np.frombuffer(x.as_buffer(), "<f4").astype(np.float64) for x in t["part"])
            yield pa.RecordBatch.from_arrays([t["chunk"].combine_chunks()[:1], pa.array([(total / sum(t["docs"].to_pylist())).astype("<f4").tobytes()], pa.binary())], names=["chunk", "part"])

    moved = by_group(blocks.mapInArrow(run, "chunk long, first long, docs long, part binary"), "chunk", "first").mapInArrow(means, "chunk long, part binary").collect()
    shared.destroy()
    return flat(net) + np.concatenate([np.frombuffer(r.part, "<f4") for r in sorted(moved)])


def train(shards: list, blocks: DataFrame, epochs: int, common: int, rate: float, seed: int) -> Net:
    """The net learned from blocks; shards: (docs, bad) of each row."""
    held = blocks.mapInArrow(bucket_counts, "which int, bucket int, clean long, toxic long").groupBy("which", "bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    held = held.where(F.col("clean") + F.col("toxic") >= common).toArrow().to_pandas().sort_values(["which", "bucket"])
    held = [held[held.which == i] for i in range(2)]
    net = Net([h.bucket.to_numpy() for h in held], np.random.default_rng(seed))
    net.w["e0"][0] = net.w["e1"][0] = 0
    total = np.array([sum(r.docs - r.bad for r in shards), sum(r.bad for r in shards)])
    for i, h in enumerate(held):
        net.w[f"e{i}"][1:, i] = (np.log((h.toxic + 0.3) / (total[1] + 0.6)) - np.log((h.clean + 0.3) / (total[0] + 0.6))) / 4
    for epoch in range(epochs):
        load(net, averaged(blocks, net, rate * (1 - epoch / epochs), seed + epoch))
    return net


def calibrated(blocks: DataFrame, net: Net, least: int) -> dict[str, float]:
    """The cut with the best F1 for each language with enough toxic documents in blocks."""
    shared = blocks.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, toxic, langs, tokens in unpacked(batches):
            for a, b in some_texts(np.array([t.shape[1] for t in tokens])):
                flat, own = np.concatenate(tokens[a:b], axis=1), shared.value
                scores = own.scores(np.array([own.id[i][flat[i]] for i in range(2)]), np.concatenate([[0], np.cumsum([t.shape[1] for t in tokens[a:b]])]))
                yield pa.RecordBatch.from_arrays([pa.array(langs[a:b], pa.string()), pa.array(toxic[a:b]), pa.array(scores)], names=["lang", "toxic", "score"])

    tried = [float(c) for c in np.arange(0.3, 0.96, 0.05)]
    over = [F.count_if(F.col("score") >= c).alias(f"n{k}") for k, c in enumerate(tried)] + [F.count_if((F.col("score") >= c) & F.col("toxic")).alias(f"y{k}") for k, c in enumerate(tried)]
    found = blocks.mapInArrow(run, "lang string, toxic boolean, score double").groupBy(F.coalesce("lang", F.lit("")).alias("lang")).agg(F.count_if("toxic").alias("bad"), *over).where(F.col("bad") >= least).orderBy("lang").collect()
    shared.destroy()
    best = {r.lang: max((2 * r[f"y{k}"] / (r.bad + r[f"n{k}"]), -abs(c - CUT), c) for k, c in enumerate(tried)) for r in found}
    return {x: float(round(b[2], 2)) for x, b in best.items()}


def marked(spark: SparkSession, rows: DataFrame, ids: DataFrame, key: str, count: int) -> DataFrame:
    """rows whose key is among the `count` ids, and about one in 16 of the others: a table of 16 bits an id, so that few others move."""
    size = max(1, count // 4)
    spot = F.pmod(F.xxhash64(key), F.lit(64 * size))
    word, bit = F.floor(spot / 64).cast("int"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64({key}), {64 * size}L) % 64 as int))")
    bits = ids.select(word.alias("word"), bit.alias("bit")).unionByName(spark.range(size).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bit")))
    bits = bits.groupBy("word").agg(F.bit_or("bit").alias("bit")).agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bit"))), lambda x: x["bit"]).alias("bits"))
    return rows.join(F.broadcast(bits), F.col("bits")[word].bitwiseAND(bit) != 0, "left_semi")


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, learn_from, sample: int = 4000, most_bytes: int = 16 << 20, epochs: int = 6, common: int = 3, least: int = 10, rate: float = 0.01, seed: int = 3) -> tuple[Net | None, dict[str, float]]:
    """The net and the thresholds by language. learn_from: a condition on the labels' rows; sample, most_bytes: documents and bytes of text that a shard has about."""
    known = labels.where(learn_from & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max("toxic").alias("toxic"))
    known = save(spark, known, "toxicity-labels")
    if known.select("toxic").distinct().count() < 2:
        return None, {}
    # one row of each id, that of the smallest text hash
    texts = docs.select(F.col("doc_id").cast("long").alias("label_id"), F.xxhash64("text").alias("text_hash"), F.octet_length("text").cast("long").alias("size"))
    found = looked_up(spark, texts, known, ["label_id"]).groupBy("label_id", "toxic").agg(F.min(F.struct("text_hash", "size")).alias("t"))
    held = save(spark, found.select("label_id", "toxic", "t.size"), "toxicity-ids")
    count, size = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    n = max(1, -(-count // sample), -(-size // most_bytes))
    fold = (F.pmod(F.xxhash64("label_id", F.lit(seed + 1)), F.lit(5)) == 0).cast("int")  # 1: held back from the net that sets thresholds
    held = held.withColumn("shard", F.pmod(F.xxhash64("label_id", F.lit(seed + 2)), F.lit(n))).withColumn("fold", fold).drop("size")
    # one row of each id again, copies become one before they move; then its tokens
    texts = marked(spark, docs.select(F.col("doc_id").cast("long").alias("label_id"), F.col("lang").cast("string"), "text"), held, "label_id", count)
    rows = texts.groupBy("label_id").agg(F.min(F.struct(F.xxhash64("text").alias("text_hash"), "lang", "text")).alias("r")).select("label_id", "r.lang", "r.text").join(small(held), "label_id")
    rows = rows.mapInArrow(learning_rows, "label_id long, toxic int, lang string, shard long, fold int, tokens binary").where(F.octet_length("tokens") > 0).withColumn("place", F.xxhash64("label_id", F.lit(seed)))
    blocks = save(spark, by_group(rows, "shard", "fold", "place", "label_id").mapInArrow(blocks_of, f"fold int, {BLOCK}"), "toxicity-blocks", **LARGE_ROWS)
    shards = blocks.select("fold", "docs", "bad").collect()

    def learned(folds: tuple[int, ...]) -> Net | None:
        own = [r for r in shards if r.fold in folds]
        some = 0 < sum(r.bad for r in own) < sum(r.docs for r in own)
        return train(own, blocks.where(F.col("fold").isin(*folds)), epochs, common, rate, seed) if some else None

    with few_rows_read(spark, READ):
        net = learned((0,))
        cuts = calibrated(blocks.where("fold = 1"), net, least) if net else {}
        net = learned((0, 1))
    return (net, cuts) if net else (None, {})


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, learn_from=None, keep_text: bool = False, rows: DataFrame | None = None, **fitted) -> DataFrame:
    """(row, [text,] score, threshold) of each of rows (docs if not given)."""
    net, cuts = fit(spark, docs, labels, F.lit(True) if learn_from is None else learn_from, **fitted)
    rows = docs if rows is None else rows
    if net is None:
        out = scored(rows, None, {}, keep_text, {"score": F.lit(0.0)})
    else:
        shared = spark.sparkContext.broadcast(net)
        out = scored(rows, lambda texts: [pa.array(shared.value.score(texts))], {"score": "double"}, keep_text)
    lang = F.coalesce(F.col("row.lang").cast("string"), F.lit(""))
    cut = F.lit(CUT)
    for x, c in cuts.items():
        cut = F.when(lang == x, F.lit(c)).otherwise(cut)
    return out.withColumn("threshold", cut)


def clean(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that score below the threshold of their language, with the columns of docs."""
    return toxicity(spark, docs, labels, keep_text=True).where("score < threshold").select(*row_columns(docs))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    out = toxicity(spark, docs, table(spark, sf_dir, "labels"), fold != 1, rows=docs.select("doc_id", "lang", "text"))
    return out.select("row.doc_id", "score", "threshold").select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "threshold")
