"""Recall at the least cosine for every shape of tables, and that none is found below it."""

import numpy as np
import pytest

from tarnlake import ship
from tarnlake.llm import op9_embeddings as op


def pairs(n, d, low, high, seed):
    """n pairs of unit vectors at cosines between low and high; different pairs are far apart."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=(n, d))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    c = rng.uniform(low, high, (n, 1))
    return x, c * x + np.sqrt(1 - c * c) * z


@pytest.mark.parametrize("size", [1 << 16, 1 << 20, 1 << 25])
@pytest.mark.parametrize("d", [32, 64])
def test_codes_find_pairs_at_the_least_cosine(size, d):
    """Codes and the Hamming filter alone, without Spark, for the shapes of 8, 26 and 74 tables."""
    width, number = op.shape(size, 0.93, 0.97, 256)
    bits = 8 * width * number
    x, y = pairs(2000, d, 0.93, 0.935, d)
    learn, _ = pairs(1500, d, 0, 0.1, 7)
    mean, projection = op.learn(learn, bits)
    a, b = ((np.packbits((v - mean) @ projection >= 0, axis=1)) for v in (x, y))
    shared = (a.reshape(len(x), number, width) == b.reshape(len(x), number, width)).all(axis=2).any(axis=1)
    apart = np.unpackbits(a ^ b, axis=1).sum(axis=1)
    found = shared & (apart <= op.most_apart(0.93, bits, d))
    assert found.mean() >= 0.95, found.mean()
    other = np.unpackbits(a ^ np.roll(b, 1, axis=0), axis=1).sum(axis=1)
    assert (other <= op.most_apart(0.93, bits, d)).mean() < 0.1


@pytest.mark.parametrize("tables", [(1, 8), (2, 26), (3, 74)])
def test_links_of_the_whole_operator(spark, tables):
    ship(spark)
    x, y = pairs(60, 48, 0.9, 0.96, 3)
    v = np.concatenate([x, y]).astype(np.float32)
    cos = (x.astype(np.float32).astype(float) * y.astype(np.float32).astype(float)).sum(axis=1) / np.linalg.norm(x.astype(np.float32).astype(float), axis=1) / np.linalg.norm(y.astype(np.float32).astype(float), axis=1)
    df = spark.createDataFrame([(i, u.astype(float).tolist(), 0) for i, u in enumerate(v)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in op.near(spark, df, tables=tables).collect()}
    linked = np.array([got[i].n_links == 1 and got[i + 60].component_id == i for i in range(60)])
    assert not linked[cos < 0.93].any() and linked[cos >= 0.93].mean() >= 0.95
