"""Sharding against a plain split bit by bit, with ids that repeat down to the last bit."""

import hashlib
import random
from collections import defaultdict

import pytest

from tarnlake.llm import op2_sharding as op


def plain_hash(doc):
    return int(hashlib.md5(("" if doc is None else str(doc)).encode()).hexdigest()[:15], 16)


def plain_split(rows, limit, depth=0, prefix=0):
    """{(depth, prefix): rows} of all buckets that fit, and of those of 60 bits that don't."""
    if sum(b for _, b in rows) <= limit or depth == op.WIDTH:
        return {(depth, prefix): rows}
    out = {}
    for bit in (0, 1):
        side = [r for r in rows if plain_hash(r[0]) >> (op.WIDTH - depth - 1) & 1 == bit]
        if side:
            out |= plain_split(side, limit, depth + 1, prefix * 2 + bit)
    return out


@pytest.mark.parametrize("limit", [1000, 333, 20_000])
def test_parts_hold_the_limit(spark, limit):
    rng = random.Random(limit)
    rows = [(i, "x" * rng.choice([0, 1, 90, 300, 600, 1100])) for i in range(120)]
    rows += [(7, c * n) for c, n in zip("abcdefgh", (600, 600, 600, 500, 501, 1, 1200, 0))] + [(8, "same")] * 900 + [(None, "y" * n) for n in range(60)] + [(None, None)] * 70
    rng.shuffle(rows)
    got = op.shards(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(5), limit).collect()
    sized = [(d, len(t or "")) for d, t in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = {k: sorted(v, key=key) for k, v in plain_split(sized, limit).items()}
    found, parts = defaultdict(list), defaultdict(list)
    for r in got:
        found[r.depth, r.prefix].append((r.doc_id, r.bytes))
        parts[r.depth, r.prefix, r.part].append(r)
    assert {k: sorted(v, key=key) for k, v in found.items()} == want
    for (depth, _, part), held in parts.items():
        total = sum(r.bytes for r in held)
        assert {r.shard_bytes for r in held} == {total} and (total <= limit or len(held) == 1 and depth == op.WIDTH)
        assert part == 0 or depth == op.WIDTH
    entries = op.directory(spark.createDataFrame(got)).collect()
    assert sorted((len(e.bits), int(e.bits or "0", 2), e.part, e.documents) for e in entries) == sorted((*k, len(v)) for k, v in parts.items())
