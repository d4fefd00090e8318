"""One text of over four megabytes (of one for the operators of the pipeline) and one of a single very long word, through every operator that reads texts."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnlake import ship
from tarnlake.llm import near_copies, op1_packing, op2_sharding, op3_order_minhash, op5_simhash, op6_mixing, op7_toxicity, op8_html, op10_language_id

N = 5 << 20


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(4)
    words = np.array([f"{c}{d}ing" for c in "abcdefghij" for d in "klmnopqr"])
    long = " ".join(rng.choice(words, N // 6))
    assert len(long) > 4 << 20
    return {1: long, 2: "x" * 20_000, 3: "short text of some words", 4: None, 5: long[: N // 2]}


@pytest.fixture(scope="module")
def docs(spark, texts):
    ship(spark)
    return spark.createDataFrame([(k, t, "en", "src1", len(t or "")) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").repartition(2)


def test_packing(spark, texts, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(op1_packing.TOKENIZER))
    got = op1_packing.pack(docs).toPandas().sort_values(["doc_id", "start"])
    for k, t in texts.items():
        ids = b"".join(got[got.doc_id == k].ids)
        assert ids == np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()


def test_shards_and_fingerprints(spark, texts, docs):
    assert {r.doc_id: r.bytes for r in op2_sharding.shards(spark, docs).collect()} == {k: len(t or "") for k, t in texts.items()}
    got = {r.doc_id: r for r in op3_order_minhash.fingerprints(spark, docs).collect()}
    cut = lambda t, n: t[: len(t) - len(t) // 3] + n[: len(t) // 3]
    assert got[2].edited_sha256 == hashlib.sha256(cut(texts[2], texts[1]).encode()).hexdigest()
    assert got[1].edited_sha256 == hashlib.sha256(cut(texts[1], texts[5]).encode()).hexdigest()
    assert got[5].n_chars == N // 2 and len(got[1].fingerprint) == 8 * op3_order_minhash.SKETCHES
    simhash = {r.doc_id: r.fingerprint for r in op5_simhash.classes(spark, docs).collect()}
    assert all(int(simhash[k], 16) == op5_simhash.fingerprint(t or "") for k, t in texts.items())


def test_pipeline_operators(spark, texts, docs):
    docs = docs.withColumn("text", F.when(F.col("doc_id") == 1, F.substring("text", 1, 1 << 20)).when(F.col("doc_id") == 5, F.substring("text", 1, 1 << 19)).otherwise(F.col("text")))
    texts = {k: t[: 1 << 20] if k == 1 else t for k, t in texts.items()}
    assert {r.doc_id for r in near_copies.keep_one(spark, docs).collect()} == set(texts)
    taken = {r["row"].doc_id: r.taken for r in op6_mixing.mix(spark, docs, budget=1.0, max_epochs=1).collect()}
    assert taken[1] == len(texts[1].split()) and taken[2] == 1
    labels = docs.select("doc_id", (F.col("doc_id") == 3).cast("int").alias("toxic"))
    assert op7_toxicity.toxicity(spark, docs, labels).count() == 5
    said = {r["row"].doc_id: r.lang_pred for r in op10_language_id.predict(spark, docs, docs).collect()}
    assert said == {1: "en", 2: "en", 3: "en", 4: "und", 5: "en"}
    page = "<body><nav><a href=x>Menu</a></nav><div>" + "".join(f"<p>{texts[1][i : i + 2000].strip()}</p>" for i in range(0, 1 << 20, 2000)) + "</div></body>"
    assert op8_html.main_text(page) == "\n".join(texts[1][i : i + 2000].strip() for i in range(0, 1 << 20, 2000))
