"""Fingerprints against a plain form that looks for the minimum of each order among all elements, and what they are sensitive to."""

import random
import struct

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tarnlake.llm import op3_order_minhash as op


def signed34(h):
    h &= (1 << 34) - 1
    return h - (1 << 34) if h >> 33 else h


def plain_elements(text):
    """(hash, place) of each occurrence-numbered run of three words."""
    words = text.split()
    out, seen = [], {}
    for i in range(len(words)):
        h = 42
        for w in words[i : i + 3]:
            h = xxh64_intdigest(w.encode(), h)
        h = signed34(h)
        seen[h] = seen.get(h, -1) + 1
        n = seen[h]
        out.append((h if not n else signed34(xxh64_intdigest(struct.pack("<i", n - 1), xxh64_intdigest(struct.pack("<q", h), 42))), i))
    return out


def plain_fingerprint(text):
    elements = plain_elements(text)
    if not elements:
        return ""
    ring = 1 << 34
    least = lambda point, xs: min(xs, key=lambda e: ((e[0] + ring // 2 - point * (ring // op.POINTS)) % ring, e[1]))
    out = []
    for n in range(op.SKETCHES):
        a = least(n, elements)
        b = least(op.PARTNERS[n], elements)
        if a == b:
            rest = sorted(elements, key=lambda e: ((e[0] - a[0]) % ring, e[1]))
            b = rest[1 % len(rest)]
        x, y = sorted((a, b), key=lambda e: e[1])
        out.append(xxh64_intdigest(struct.pack("<q", y[0]), xxh64_intdigest(struct.pack("<q", x[0]), 42)) & 0xFFFFFFFF)
    return "".join(f"{x:08x}" for x in out)


def test_fingerprints_equal_the_plain_form(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(40)] + ["é", "日本"]
    texts = ["", " \n", "one", "one two", "a a a a a a", "x y x y x y x y"] + [" ".join(rng.choices(words, k=k)) for k in (3, 4, 7, 20, 60, 200, 900)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.f for r in op.sketched(df, "text", "s").select("doc_id", op.written("s").alias("f")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_fingerprint(t), t[:30]


@pytest.mark.parametrize("n", [12, 40, 126, 400, 3000])
def test_swapped_halves_are_seen_at_any_length(spark, n):
    rows = []
    for k in range(40):
        w = [f"{k}v{i}" for i in range(n)]
        rows.append((k, " ".join(w), " ".join([*w[n // 2 :], *w[: n // 2]])))
    df = op.sketched(op.sketched(spark.createDataFrame(rows, "k long, a string, b string"), "a", "x"), "b", "y")
    near = df.select(F.avg(op.likeness("x", "y"))).first()[0]
    assert 0.03 < near < 0.6  # both of a pair stand in one half every other time at most


@pytest.mark.parametrize("per_range", [3, 10, 1000])
def test_next_documents_where_ids_repeat(spark, per_range):
    rng = random.Random(per_range)
    ids = [*range(0, 200, 3), *[50] * 40, *[51] * 25, *[None] * 30, (1 << 63) - 1, -(1 << 63)]
    rng.shuffle(ids)
    rows = [(d, f"{i} " + "text of it " * rng.randint(0, 5)) for i, d in enumerate(ids)]
    got = op.fingerprints(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), per_range).collect()
    assert len(got) == len(rows)
    import hashlib

    order = sorted(set(ids), key=lambda d: (d is None, -(d or 0)))
    by = {}
    for d, t in rows:
        by.setdefault(d, []).append(t)
    sha = lambda a, b: hashlib.sha256((a[: len(a) - len(a) // 3] + b[: len(a) // 3]).encode()).hexdigest()
    for r in got:  # the next is of the same id or of the next one
        after = order[(order.index(r.doc_id) + 1) % len(order)]
        assert any(r.edited_sha256 == sha(a, b) for a in by[r.doc_id] for b in [*by[r.doc_id], *by[after]])
