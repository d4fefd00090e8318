"""Sums over segmentations with the vocabulary's longest pieces and over words of any length, against plain loops."""

import math
import random

import numpy as np
import public_tokenizers
import pytest

from tarnlake.llm import op10_language_id as op


@pytest.fixture(scope="module")
def pieces():
    return op.vocabulary(public_tokenizers.path(op.VOCABULARY))


def test_all_lengths_are_in(pieces):
    assert pieces.longest == 16 and len(pieces.keys) == 22_240


def test_sums_match_plain_loops(pieces):
    rng = np.random.default_rng(3)
    n = len(pieces.keys)
    p = np.concatenate([rng.random((n, 2)) / n, np.full((1, 2), 1e-7), np.zeros((1, 2))])
    index = {int(k): i for i, k in enumerate(pieces.keys)}
    pick = random.Random(5)
    words = ["straightforward", "a", "日本語" * 60, "".join(pick.choices("abcdefg", k=300)), "representativestraightforward" * 9]
    for where, lattice in op.lattices(words, pieces):
        got = lattice.forward(p)
        counts = lattice.expected(p, np.zeros(len(where), int), np.ones(len(where)))
        for row, i in enumerate(where):
            w = op.MARK + words[i]
            for lang in range(2):
                log = [0.0]
                for j in range(1, len(w) + 1):
                    terms = []
                    for k in range(1, min(16, j) + 1):
                        at = index.get(int(op.hashes(np.array([[ord(c) for c in w[j - k : j]]], np.uint32))[0]), n if k == 1 else None)
                        if at is not None:
                            terms.append(log[j - k] + math.log(p[at, lang]))
                    log.append(max(terms) + math.log(sum(math.exp(t - max(terms)) for t in terms)))
                assert math.isclose(got[row, lang], log[-1], rel_tol=1e-9)
        lengths = sum(len(words[i]) + 1 for i in where)
        assert 0 < counts.sum() <= lengths + 1e-6 and counts[:, 1].sum() == 0


def test_expected_pieces_cover_every_letter(pieces):
    n = len(pieces.keys)
    p = np.concatenate([np.full((n, 1), 1 / n), [[1e-7]], [[0.0]]])
    for word in ["straightforward", "q" * 200, "日" * 150 + "understanding"]:
        lattice = op.Lattice([op.MARK + word, op.MARK], pieces)
        size = np.zeros(n + 2)
        for j in range(lattice.width):
            for k, _, piece in lattice.at(j):
                size[piece] = k
        assert math.isclose((lattice.expected(p, np.array([0, 0]), np.array([1, 0]))[:, 0] * size).sum(), len(word) + 1, rel_tol=1e-9)
