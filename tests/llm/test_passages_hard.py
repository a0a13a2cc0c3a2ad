"""Passages of repetitive texts: as plain comparison finds them, in time in proportion to the texts."""

import time

import numpy as np
import pytest

from tendermill.llm import passages
from test_llm import brute_passages, found_passages


def repetitive(n=400):
    rng = np.random.default_rng(6)
    period = lambda k, m: " ".join([f"p{i % k}" for i in range(m)])
    broken = lambda k, m, every, tag: " ".join(f"{tag}{i}" if i % every == every - 1 else f"p{i % k}" for i in range(m))
    texts = ["a " * n, "a " * (n + 7), period(3, n), period(3, n + 1), period(2, n), broken(3, n, 9, "x"), broken(3, n, 9, "y"), broken(3, n, 25, "z"), "a " * 21, "a " * 19]
    mixed = [" ".join(rng.choice(["a", "p0", "p1"], n)) for _ in range(4)]
    return list(enumerate([*texts, *mixed, mixed[0] + " a " * 40, "q " + texts[2], None, ""])) + [(None, texts[0]), (3, texts[3]), (-5, period(3, 60))]


@pytest.mark.parametrize("window", [8, 20])
def test_repetitive_texts(spark, window):
    docs = spark.createDataFrame(repetitive(), "doc_id long, text string")
    assert found_passages(docs, window) == brute_passages(repetitive(), window)


@pytest.mark.parametrize("text", ["a " * 20_000, " ".join("b%d" % i if i % 48 == 47 else "xyz"[i % 3] for i in range(19_200)), "m n o " * 6_600])
def test_long_repetitive_stretches_take_linear_time(text):
    began = time.perf_counter()
    machine = passages.Automaton([(1, text.encode()), (2, text.encode() + b" end")], passages.WINDOW)
    found = machine.occurrences(b"begin " + text.encode(), 5)
    assert found == [(1, len(text.split()) + 1)] and not machine.occurrences(text.encode(), 1)
    assert time.perf_counter() - began < 5
