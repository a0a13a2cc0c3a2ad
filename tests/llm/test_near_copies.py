"""The near-dedup stage against all pairs by five-word Jaccard."""

import itertools

import numpy as np
import pytest

import corpus_pipeline
from tendermill.llm import near_copies
from test_llm import awkward, brute_components, SCHEMA


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def near_rows():
    """Texts with up to five changed words each, so that similarities lie on both sides of 0.8."""
    rng = np.random.default_rng(3)
    rows = []
    for base in range(12):
        words = [f"v{x}" for x in rng.integers(0, 5000, int(rng.integers(40, 400)))]
        for copy in range(8):
            changed = list(words)
            for at in rng.integers(0, len(words), int(rng.integers(0, 1 + len(words) // 40))):
                changed[at] = f"new{rng.integers(1 << 30)}"
            rows.append((100 + base * 10 + copy, " ".join(changed)))
    return rows


@pytest.mark.parametrize("block", [256, 4])
def test_near_copies_at_a_similarity_of_eight_tenths(spark, block):
    rows = near_rows()
    linked = [(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if jaccard(x, y) >= 0.8]
    between = sum(0.8 <= jaccard(x, y) < 0.95 for (_, x), (_, y) in itertools.combinations(rows, 2))
    assert between > 50
    kept = near_copies.drop(spark.createDataFrame(rows, "doc_id long, text string"), block)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute_components([i for i, _ in rows], linked).values()))


def test_the_stage_drops_near_copies_and_keeps_null_ids(spark):
    docs = spark.createDataFrame(awkward() + [(i, t, *[None] * 8) for i, t in near_rows()], SCHEMA)
    known = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]
    linked = [(a, b) for (a, x), (b, y) in itertools.combinations(known, 2) if jaccard(x, y) >= 0.8]
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 2
    assert sorted(i for i in ids if i is not None) == sorted(set(brute_components([i for i, _ in known], linked).values()))
    assert near_copies.drop(docs.limit(0)).count() == 0
