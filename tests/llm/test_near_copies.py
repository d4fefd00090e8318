"""The near-dedup stage against exact Jaccard likeness of five-word shingle sets, computed with plain Python sets."""

import random

import pytest

import corpus_pipeline
from tarnlake import ship
from tarnlake.llm import near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def likeness(a, b):
    sets = []
    for words in ((a or "").lower().split(), (b or "").lower().split()):
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


def smallest(rows):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for b in range(len(rows)):
        for a in range(b):
            if likeness(rows[a][1], rows[b][1]) >= 0.8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            ids[find(i)] = min(doc, ids.get(find(i), doc))
    return sorted((doc, ids.get(find(i))) for i, (doc, _) in enumerate(rows) if doc is not None)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    out = []
    for group in range(20):
        text = rng.choices(words, k=rng.choice([6, 12, 60, 300]))
        out.append(" ".join(text))
        for edits in (1, 2, 3, 4, 6, 8):
            t = list(text)
            for at in rng.sample(range(len(t)), min(edits * len(t) // 200 + 1, len(t))):
                t[at] = rng.choice(words)
            out.append(" ".join(t))
    big = rng.choices(words, k=200)
    out += [" ".join([*big[:i], "x", *big[i + 1 :]]) for i in range(40)]
    out += [None, "", " \n", "one", "ONE", "a b c d e", "a b c d e f", out[0], out[3].upper()]
    rng.shuffle(out)
    return [*enumerate(out), (5, out[5]), (None, out[7])]


@pytest.mark.parametrize("block", [512, 7])
def test_classes_are_those_of_exact_likeness(spark, rows, block):
    ship(spark)
    got = near_copies.classes(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), block=block).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == smallest(rows) and len(got) == len(rows)


def test_stage_drops_copies_with_a_few_edits(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted({c for _, c in smallest(rows)}) and not any(r.doc_id is None for r in kept)
    assert near_copies.keep_one(spark, docs.limit(0)).count() == 0


def test_no_text_is_lost_where_ids_repeat(spark):
    one, two, three = ("one two three four five six", "seven eight nine ten eleven twelve", "some other text of more than five words")
    rows = [(1, one), (1, two), (2, two), (2, two), (None, three), (None, three), (None, one), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).repartition(3)
    kept = sorted((r.doc_id or 0, r.text) for r in near_copies.keep_one(spark, docs).collect())
    assert kept == sorted([(1, one), (1, two), (0, three), (3, "")])


def test_hot_keys_are_looked_up_apart(spark, monkeypatch):
    """The same results without any broadcast for size alone."""
    from tarnlake.llm import common, components

    monkeypatch.setattr(common, "fits", lambda df, rows=0: False)
    rows = spark.createDataFrame([(1, i) for i in range(3000)] + [(2, 1), (3, 1), (None, 1)], "k long, x long")
    named = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], "k long, name string")
    for how in ("inner", "left", "left_anti"):
        got = common.looked_up(spark, rows, named, ["k"], how)
        want = rows.join(named, "k", how)
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    star = spark.createDataFrame([(i, 0) for i in range(1, 2500)] + [(5000, 2499)], "child long, parent long")
    assert {r.parent for r in components.components(spark, star).collect()} == {0}
