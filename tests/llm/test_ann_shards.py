"""Recall over several shards, on vectors of unequal norms and in clusters of near copies."""

import numpy as np
import pytest

from tendermill.llm import ann


def made(kind, n=2400, d=32):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, d))
    if kind == "norms":
        return x / np.linalg.norm(x, axis=1)[:, None] * rng.lognormal(size=(n, 1))
    if kind.startswith("copies"):
        return rng.normal(size=(8, d))[rng.integers(0, 8, n)] + float(kind.split()[1]) * x
    return x


@pytest.mark.parametrize("kind", ["normal", "norms", "copies 1e-3", "copies 1e-6"])
def test_recall_of_several_shards(spark, kind):
    x = made(kind)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.neighbours(df, shard=700).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == set(range(0, len(x), 20))
    hits = 0
    for q, got in found.items():
        got.sort()
        score = x @ x[q]
        score[q] = -np.inf
        assert [g[0] for g in got] == list(range(1, 21)) and np.allclose([g[2] for g in got], [score[g[1]] for g in got])
        assert [g[1] for g in got] == sorted((g[1] for g in got), key=lambda i: (-dict((v, s) for _, v, s in got)[i], i))
        hits += len(set(np.lexsort((np.arange(len(x)), -score))[:20]) & {g[1] for g in got})
    assert hits / (20 * len(found)) >= 0.9


def test_ties_at_the_last_rank(spark):
    """Many different vectors with one score: the smallest ids win."""
    rows = [(0, [1.0, 0.0, 0.0])] + [(i, [0.5, float(np.cos(i)), float(np.sin(i))]) for i in range(1, 60)]
    got = sorted(ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard=25).where("query_id = 0").collect(), key=lambda r: r["rank"])
    assert [r.vec_id for r in got] == list(range(1, 21)) and {r.score for r in got} == {0.5}


@pytest.mark.parametrize("kind", ["normal", "unit"])
def test_beams_are_as_wide_as_the_vectors_ask_for(kind):
    """Plain normal vectors have unequal norms and so queries far from all points."""
    x = np.random.default_rng(7).normal(size=(3000, 64))
    x = x / np.linalg.norm(x, axis=1)[:, None] if kind == "unit" else x
    graph = ann.Graph.build(ann.lifted(x))
    ef = ann.calibrated(graph, x)
    q = x[:150]
    exact = np.argsort(-(q @ x.T), axis=1)[:, :20]
    found = graph.search(np.pad(q, ((0, 0), (0, 1))), 21, ef)
    shares = [np.isin(e, f).mean() for e, f in zip(exact, found)]
    assert np.mean(shares) >= 0.95 and (ef == ann.EF_SEARCH or kind == "normal")
