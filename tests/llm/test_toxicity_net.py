"""The classifier's pooling, score and gradients against plain loops, and the bound of what it learns from."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tarnlake import ARROW, ship
from tarnlake.llm import op7_toxicity as op
from tarnlake.llm.common import READ_ROWS, give_back, held


def net():
    rng = np.random.default_rng(2)
    out = op.Net([np.arange(0, op.BUCKETS, 3), np.arange(0, op.BUCKETS, 2)], rng)
    out.w = {k: v.astype(np.float64) for k, v in out.w.items()}
    for k, v in out.w.items():
        out.w[k] = v + rng.normal(0, 0.3, v.shape)
    out.w["e0"][0] = out.w["e1"][0] = 0
    return out


def plain_pooled(w, ids):
    """The largest response of every filter over one text, window by window; windows end with the text."""
    out = []
    x = [w["e0"][a] + w["e1"][b] for a, b in ids.T]
    for width in op.WIDTHS:
        for f in range(op.FILTERS):
            best = 0.0
            for i in range(len(x)):
                y = w[f"b{width}"][f]
                for j in range(width):
                    if i + j < len(x):
                        y += sum(x[i + j][d] * w[f"f{width}"][j, d, f] for d in range(op.SIZE))
                best = max(best, y)
            out.append(best)
    return np.array(out)


def plain_score(w, ids):
    return 1 / (1 + np.exp(-(plain_pooled(w, ids) @ w["v"] + w["c"][0])))


def test_scores_of_whole_texts_equal_plain_loops():
    n = net()
    texts = ["alpha beta gamma", "", None, "zzq " * 9, "alpha " + "qq ww ee rr tt yy uu " * 3 + "beta", "one"]
    for i in (0, 1):  # most words are unknown
        n.id[i][:] = 0
        for word in ("alpha", "beta"):
            n.id[i][op.buckets([word])[i, 0]] = 5 + i
    for width in op.WIDTHS:
        n.w[f"b{width}"][:] = 0.7  # windows of unknown words respond too
    got = n.score(pa.array(texts))
    for text, score in zip(texts, got):
        both = op.buckets((text or "").split())
        ids = np.array([n.id[i][both[i]] for i in range(2)])
        assert abs(plain_score(n.w, ids) - score) < 1e-5


def test_gradients_equal_differences():
    n, rng = net(), np.random.default_rng(5)
    bounds = np.array([0, 6, 6, 11, 12])
    ids = rng.integers(1, 9, (2, 12))
    y, weight = np.array([1, 0, 0, 1.0]), np.array([1, 1, 0.5, 2.0])

    def loss():
        p = np.array([plain_score(n.w, ids[:, a:b]) for a, b in zip(bounds, bounds[1:])])
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / len(y)

    g = n.step(ids, bounds, y, weight)
    for k in n.w:
        places = [tuple(rng.integers(0, s) for s in n.w[k].shape) for _ in range(3)] if k[0] != "e" else [(int(ids[int(k[1]), i]), int(rng.integers(0, op.SIZE))) for i in (0, 7, 11)]
        for at in places:
            held = n.w[k][at]
            n.w[k][at] = held + 1e-5
            up = loss()
            n.w[k][at] = held - 1e-5
            down = loss()
            n.w[k][at] = held
            assert abs((up - down) / 2e-5 - g[k][at]) < 1e-4, k


def test_repeated_and_huge_rows_do_not_swell_the_sample(spark, monkeypatch):
    ship(spark)
    seen = []
    train = op.train
    monkeypatch.setattr(op, "train", lambda tokens, *a: seen.append(len(tokens)) or train(tokens, *a))
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.when(F.col("id") % 2 == 0, F.lit("bad words ")).otherwise(F.lit("good text ")), F.repeat(F.lit("filler "), 20)).alias("text"), F.lit("en").alias("lang"))
    copies = docs.where("doc_id < 4").crossJoin(spark.range(500).select()).unionByName(docs)
    huge = copies.unionByName(docs.where("doc_id = 5").withColumn("doc_id", F.lit(99).cast("long")).withColumn("text", F.repeat(F.lit("word "), 10_000)))
    labels = huge.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("toxic"))
    out = op.toxicity(spark, huge, labels, most_bytes=64 * 1000)
    assert out.count() == 60 + 2000 + 1 and seen[0] <= 60


def labelled(spark, n):
    """A toxic word that is only in documents 1500 to 1529 among others."""
    odd = F.col("id").between(1500, 1529)
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.when(odd, F.lit("rareword ")).when(F.col("id") % 3 == 0, F.lit("vile ")).otherwise(F.lit("kind ")), F.repeat(F.concat(F.translate(F.conv((F.col("id") % 50).cast("string"), 10, 26), "0123456789", "qrstuvwxyz"), F.lit(" ")), 8)).alias("text"), F.lit("en").alias("lang"))
    return docs, docs.select("doc_id", ((F.col("doc_id") % 3 == 0) | F.col("doc_id").between(1500, 1529)).cast("int").alias("toxic"))


def test_every_labelled_document_is_learned_from(spark, monkeypatch):
    ship(spark)
    seen, train = [], op.train
    monkeypatch.setattr(op, "train", lambda shards, *a: seen.append(shards) or train(shards, *a))
    docs, labels = labelled(spark, 2000)
    huge = docs.where("doc_id = 7").select(F.lit(5000).cast("long").alias("doc_id"), F.repeat(F.lit("kind word "), 1000).alias("text"), "lang")
    out = op.toxicity(spark, docs.unionByName(huge), labels.union(spark.createDataFrame([(5000, 0)], "doc_id long, toxic int")), sample=200, most_bytes=40_000).collect()
    held_back = spark.createDataFrame([(i,) for i in [*range(2000), 5000]], "i long").where(F.pmod(F.xxhash64("i", F.lit(4)), F.lit(5)) == 0).count()
    assert sum(r.docs for r in seen[0]) == 2001 - held_back and len(seen[0]) > 1
    assert max(r.docs for r in seen[0]) < 400
    assert sum((r.score >= 0.7) != (r.row.doc_id % 3 == 0 or 1500 <= r.row.doc_id < 1530) for r in out) <= 5


def test_the_mean_of_shards_is_that_of_plain_learners(spark):
    ship(spark)
    rng = np.random.default_rng(4)
    shards = [([rng.integers(0, 40, (2, int(rng.integers(1, 9)))).astype("<i4") for _ in range(n)], rng.integers(0, 2, n)) for n in (70, 130)]
    rows = [(k, len(t), int(y.sum()), bytearray(y.astype("u1").tobytes()), ["en"] * len(t), bytearray(np.array([x.shape[1] for x in t], "<i8").tobytes()), bytearray(b"".join(x.tobytes() for x in t))) for k, (t, y) in enumerate(shards)]
    net = op.Net([np.arange(40)] * 2, np.random.default_rng(1))
    start, blocks = op.flat(net), spark.createDataFrame(rows, op.BLOCK)
    got, want = op.averaged(blocks.coalesce(1), net, 0.01, 3), start.astype(np.float64)
    assert np.array_equal(op.flat(net), start) and np.allclose(got, op.averaged(blocks.repartition(2), net, 0.01, 3), atol=1e-6)
    for k, (t, y) in enumerate(shards):
        op.load(net, start)
        op.learn(net, t, y == 1, 0.01, np.random.default_rng([3, k]))
        want += (op.flat(net) - start) * len(t) / 200
    assert np.allclose(got, want, atol=1e-6) and np.abs(got - start).max() > 0.01


def test_the_net_that_scores_learned_from_all_labelled_documents(spark, monkeypatch):
    ship(spark)
    nets, train = [], op.train
    monkeypatch.setattr(op, "train", lambda shards, *a: nets.append((sum(r.docs for r in shards), train(shards, *a))) or nets[-1][1])
    docs, labels = labelled(spark, 600)
    net, cuts = op.fit(spark, docs, labels, F.lit(True), epochs=1)
    assert net is nets[-1][1] and nets[-1][0] == 600 and nets[0][0] < 600 and set(cuts) == {"en"}


def test_a_shard_in_several_rows_is_learned_as_one(spark, monkeypatch):
    rng = np.random.default_rng(6)
    tokens = [rng.integers(0, 40, (2, int(rng.integers(1, 9)))).astype("<i4") for _ in range(60)]
    rows = pa.table({"shard": [k // 30 for k in range(60)], "fold": [k // 20 % 2 for k in range(60)], "toxic": [k % 3 == 0 for k in range(60)], "lang": ["en"] * 60, "tokens": pa.array([x.tobytes() for x in tokens], pa.binary())})
    monkeypatch.setattr(op, "PART", 200)
    parts = list(op.blocks_of(rows.to_batches(max_chunksize=7)))
    assert len(parts) > 6 and all(len(p.column("tokens")[0].as_py()) <= 200 for p in parts)
    assert all(len(set(p.column("fold").to_pylist())) == 1 for p in parts)
    got = list(op.whole_shards(iter(parts)))
    assert [g[0] for g in got] == [0, 1] and [list(g[1]) for g in got] == [[k % 3 == 0 for k in range(a, a + 30)] for a in (0, 30)]
    assert all(np.array_equal(x, y) for x, y in zip(tokens, got[0][2] + got[1][2], strict=True))


def test_arrow_batches_hold_few_whole_texts(spark):
    rows, size = ARROW
    for name in ARROW:
        spark.conf.unset(name)
    ship(spark)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]})

    assert max(r.n for r in spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long, size long").collect()) <= 1000
    wide = spark.range(0, 24, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    assert max(r.size for r in wide.mapInArrow(sizes, "n long, size long").collect()) < 6 << 20
    spark.conf.set(rows, "77")  # a user's choice stays
    ship(spark)
    assert spark.conf.get(rows) == "77" and spark.conf.get(size) == "4m"
    spark.conf.unset(rows)


def page_sizes(spark, files, column):
    """Bytes a page, on average, of each row group's column."""
    hadoop, out = spark._jvm.org.apache.parquet.hadoop, []
    for f in files:
        reader = hadoop.ParquetFileReader.open(hadoop.util.HadoopInputFile.fromPath(spark._jvm.org.apache.hadoop.fs.Path(f), spark._jsc.hadoopConfiguration()))
        for group in reader.getFooter().getBlocks():
            out += [c.getTotalUncompressedSize() / reader.readOffsetIndex(c).getPageCount() for c in group.getColumns() if c.getPath().toDotString() == column]
        reader.close()
    return out


def test_large_rows_are_pages_and_few_are_read_at_a_time(spark, monkeypatch):
    ship(spark)
    before, seen, train = spark.conf.get(READ_ROWS), [], op.train
    monkeypatch.setattr(op, "train", lambda shards, blocks, *a: seen.append((len(shards), spark.conf.get(READ_ROWS), blocks.inputFiles())) or train(shards, blocks, *a))
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.when(F.col("id") % 2 == 0, F.lit("bad ")).otherwise(F.lit("good ")), F.repeat(F.lit("some filler "), 6000)).alias("text"), F.lit("en").alias("lang"))
    net, _ = op.fit(spark, docs, docs.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("toxic")), F.lit(True), epochs=1)
    sizes = page_sizes(spark, seen[-1][2], "tokens")
    assert net and seen[-1][0] >= 5 and sizes and max(sizes) < 2 * op.PART + 1000  # 5.8 MB were one page
    assert [x[1] for x in seen] == [str(op.READ)] * 2 and spark.conf.get(READ_ROWS) == before


def test_a_worker_keeps_what_one_operator_made():
    made = []
    make = lambda x: lambda: made.append(x) or x
    assert [held("a", make(1)), held("a", make(2)), held("b", make(3)), held("a", make(4))] == [1, 1, 3, 4] and made == [1, 3, 4]
    give_back()
    assert held("a", make(5)) == 5
    give_back()
