"""Scores of the trees against a walk of one document at a time, and statistics of odd texts."""

import math

import numpy as np

from tendermill.llm import quality_trees


def forest():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(800, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0)).astype(float)
    return x, y, quality_trees.fit(x, y, trees=25)


def test_the_flat_arrays_give_the_walk_of_each_tree():
    x, y, f = forest()
    for row, got in zip(x, f.score(x)):
        z = f.base
        for t in range(len(f.value)):
            node = 0
            for _ in range(quality_trees.DEPTH):
                node = 2 * node + (2 if row[f.feature[t, node]] > f.threshold[t, node] else 1)
            z += f.value[t, node - (2**quality_trees.DEPTH - 1)]
        assert abs(got - 1 / (1 + math.exp(-z))) < 1e-12
    assert ((f.score(x) >= 0.5) == y).mean() > 0.9


def test_statistics_of_odd_texts():
    for raw in (b"", b" \n\t ", b"\xff\xfe", b"x" * 100_000, b"a b c\n" * 20_000, b"\n".join([b"same line"] * 50)):
        s = quality_trees.statistics(raw)
        assert len(s) == quality_trees.N_STATISTICS and all(map(math.isfinite, s))
    assert quality_trees.statistics(b" ") == quality_trees.statistics(b"")
