"""Quality: gradient-boosted trees over statistics of the whole text.

Statistics are binned by quantiles of a bounded labelled sample; each tree is
grown level by level from histograms of gradients.  Trees are complete and
flattened into arrays of features, thresholds and leaf values, so a batch of
documents walks all of them with a few numpy look-ups a level.

Scores see the text alone.  Defined results: NULL and empty texts have all
statistics zero and are scored; without labels every score is 0.5; NULL ids are
scored; repeated rows score alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendermill.llm.common import text_bytes
from tendermill.llm.labelled import fold, sample

#: Labelled rows for the fit; scoring has no bound.
SAMPLE = 20_000
FOLDS, HELD = 4, 2
THRESHOLD = 0.7
BINS = 64
DEPTH = 4
TREES = 80
RATE = 0.15
PENALTY = 2.0

_SETS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#*$%&<>|", b"|", b"!", b"?", b".", b",", b'"=', b"@", bytes(range(128, 256)))


def _classes() -> np.ndarray:
    """For each byte, the counts that it adds to; sets may overlap."""
    out = np.zeros((256, len(_SETS)), np.int64)
    for i, chars in enumerate(_SETS):
        out[list(chars), i] = 1
    return out


CLASSES = _classes()
N_STATISTICS = len(_SETS) + 15


def statistics(raw: bytes) -> list[float]:
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n, m = max(1, len(words)), max(1, len(lines))
    if not words:
        return [0.0] * N_STATISTICS
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    chars = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ CLASSES / len(raw)
    grams = set(zip(words, words[1:], words[2:], words[3:]))
    known = set(words)
    ends = np.fromiter((w[-1] for w in words), np.uint8, len(words))
    line_words = np.fromiter((len(x.split()) for x in lines), np.int64, len(lines))
    upper = sum(map(bytes.isupper, words))
    return [
        *chars, float(np.log1p(len(words))), float(sizes.mean()), float(sizes.std()), float((sizes <= 3).mean()), float((sizes >= 12).mean()),
        len(known) / n, len(grams) / max(1, len(words) - 3), len(set(lines)) / m, len(lines) / n, float(line_words.mean()), float(line_words.std()),
        float(np.isin(ends, list(b".!?")).mean()), float(np.isin(ends, list(b"#*$%&")).mean()), upper / n, sum(w in (b"|", b"-", b"*") for w in words) / n,
    ]


@dataclass
class Forest:
    """``feature`` and ``threshold`` by tree and inner node, ``value`` by tree and leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.value))[None, :]
        node = np.zeros((len(x), len(self.value)), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        z = self.base + self.value[trees, node - (2**DEPTH - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Forest:
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    if not len(y):
        return Forest(feature[:0], threshold[:0], value[:0], 0.0)
    p = np.clip(y.mean(), 0.01, 0.99)
    base = float(np.log(p / (1 - p)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    z = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            low, width = 2**level - 1, 2**level
            best, choice = np.full(width, 1e-6), np.zeros((width, 2), np.int64)
            choice[:, 1] = BINS
            for f in range(x.shape[1]):
                cell = (node - low) * BINS + bins[:, f]
                sums = [np.bincount(cell, w, minlength=width * BINS).reshape(width, BINS).cumsum(axis=1) for w in (g, h)]
                (gl, hl), (ga, ha) = sums, (s[:, -1:] for s in sums)
                gain = gl**2 / (hl + PENALTY) + (ga - gl) ** 2 / (ha - hl + PENALTY) - ga**2 / (ha + PENALTY)
                gain[(hl < 1) | (ha - hl < 1)] = 0
                at = gain[:, : max(1, len(edges[f]))].argmax(axis=1)
                top = gain[np.arange(width), at]
                better = top > best
                best[better], choice[better] = top[better], np.stack([np.full(width, f), at], axis=1)[better]
            for k in range(width):
                f, b = choice[k]
                feature[t, low + k] = f
                threshold[t, low + k] = edges[f][b] if b < len(edges[f]) else np.inf
            mine = choice[node - low]
            node = 2 * node + 1 + (bins[np.arange(len(y)), mine[:, 0]] > mine[:, 1])
        leaf = node - inner
        value[t] = RATE * np.bincount(leaf, g, minlength=leaves) / (np.bincount(leaf, h, minlength=leaves) + PENALTY)
        z += value[t][leaf]
    return Forest(feature, threshold, value, base)


def _score(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = np.array([statistics(raw.as_py()) for raw in part["raw"]])
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(forest.score(x))], names=["doc_id", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``."""
    train = fold(F.col("doc_id"), FOLDS) != HELD
    rows = sample(docs, labels, "quality", train, most, lambda raw: np.array(statistics(raw)), "double", most * N_STATISTICS)
    forest = fit(np.array(rows.x).reshape(len(rows.x), N_STATISTICS), rows.y)
    scored = text_bytes(docs, "doc_id").mapInArrow(_score(forest), "doc_id long, score double")
    held_out = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
