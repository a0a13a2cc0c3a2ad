"""Toxicity: a convolutional text classifier in numpy.

Words are hashed to rows of an embedding table; filters of several widths slide
over the whole text, each keeps its strongest response, and a logistic layer
joins them.  One coordinate of a word's vector is the shrunk log-odds of the
label, counted before the fit; the others start at random and are trained with
Adam.  For scoring, the product of the embeddings and the filters is tabulated,
so that a position costs a few table rows.

The score never sees language, source, id or labels.  Thresholds by language are
calibrated on a held-back part of the sample and only serve ``flagged``.

Defined results: NULL and empty texts get the score of a text without words;
without training rows all scores are near 0; NULL ids are scored and are not
held out; repeated rows score alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendermill.llm.labelled import fold, sample

BUCKETS = 1 << 17
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
#: Labelled rows, and words of them, for the fit, which reads whole texts; scoring has no such bound.
SAMPLE = 12_000
SAMPLE_WORDS = 8_000_000
#: Passes over the sample: at least, at most, and the steps aimed at between.
EPOCHS, MOST_EPOCHS, STEPS = 3, 12, 1500
BATCH = 32
#: Words held at once, unless one text alone has more.
BATCH_WORDS = 1 << 17
FOLDS = 5
PAD = 0
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_LOW = np.int64((1 << 32) - 1)


class WordIds(dict):
    """Two buckets of a word, without case and surrounding punctuation, in one number; bucket 0 is padding."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        plain = word.decode("utf-8", "replace").lower().strip(_EDGES)
        h = xxhash.xxh3_64_intdigest(plain.encode())
        found = self[word] = 1 + h % (BUCKETS - 1) | (1 + (h >> 32) % (BUCKETS - 1)) << 32
        return found


def word_ids(raw: bytes, ids: WordIds) -> np.ndarray:
    """Buckets of the words, then padding for the widest filter."""
    words = raw.split()
    out = np.zeros(len(words) + max(WIDTHS) - 1 + (not words), np.int64)
    out[: len(words)] = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    return out


class Odds:
    """Shrunk log-odds of the label for texts that hold a word.

    A word's value is the one nearer to zero of its two buckets, so that words
    that share one bucket with a telling word are not taken for it.
    """

    def __init__(self, docs: list[np.ndarray], y: np.ndarray, strength: float = 5.0):
        prior = np.clip(y.mean() if len(y) else 0.1, 0.01, 0.99)
        self.tables = []
        for shift in (0, 32):
            seen, hit = np.zeros(BUCKETS), np.zeros(BUCKETS)
            for d, label in zip(docs, y):
                at = np.unique((d >> shift) & _LOW)
                seen[at] += 1
                hit[at] += label
            p = (hit + strength * prior) / (seen + strength)
            odds = np.log(p / (1 - p)) - np.log(prior / (1 - prior))
            odds[PAD] = 0
            self.tables.append(odds.astype(np.float32))

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        a, b = self.tables[0][ids & _LOW], self.tables[1][ids >> 32]
        return np.where(np.abs(a) < np.abs(b), a, b)


@dataclass
class Network:
    """``filters[w]`` is (width, 1 + DIM, FILTERS): row 0 weighs the odds, the others the embedding."""

    odds: Odds
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)

    @classmethod
    def start(cls, odds: Odds, prior: float, rng: np.random.Generator) -> Network:
        embed = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
        embed[PAD] = 0
        filters = [rng.normal(0, 0.1, (w, 1 + DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in filters:
            f[:, 0, 0] = 1 / len(f)
        n = FILTERS * len(WIDTHS)
        out = np.full(n, 0.01, np.float32)
        out[::FILTERS] = 0.8
        return cls(odds, embed, filters, np.zeros(n, np.float32), out, float(np.log(prior / (1 - prior)) - 2))

    def tables(self) -> list[list[np.ndarray]]:
        """For each width and offset, each bucket's part in the filters' response."""
        return [[self.embed @ f[j, 1:] for j in range(len(f))] for f in self.filters]

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, self.bias, self.out]


def score_many(docs: list[np.ndarray], net: Network, tables: list[list[np.ndarray]]) -> np.ndarray:
    """Scores of whole texts; windows begin on words, and past a text's end they see its padding."""
    ids = np.concatenate(docs)
    ends = np.cumsum([len(d) for d in docs])
    starts = np.concatenate(([0], ends[:-1]))
    odds, rows = net.odds(ids)[:, None], ids & _LOW
    tops = []
    for f, table in zip(net.filters, tables):
        total = table[0][rows] + odds * f[0, 0]
        for j in range(1, len(f)):
            total[:-j] += table[j][rows[j:]] + odds[j:] * f[j, 0]
        for j in range(1, max(WIDTHS)):
            total[ends - j] = -np.inf
        tops.append(np.maximum.reduceat(total, starts, axis=0))
    # Summed by row: the last bits of a matrix product depend on the number of rows.
    z = (np.maximum(np.concatenate(tops, axis=1) + net.bias, 0) * net.out).sum(axis=1) + net.out_bias
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def batched(items: Iterable, words: Callable, most: int | None = None) -> Iterator[list]:
    """Lists of at most ``most`` items, each list ended once it holds ``BATCH_WORDS`` words."""
    held, size = [], 0
    for x in items:
        held.append(x)
        size += words(x)
        if size >= BATCH_WORDS or len(held) == most:
            yield held
            held, size = [], 0
    if held:
        yield held


def train(docs: list[np.ndarray], y: np.ndarray, langs: list[str | None], seed: int = 7) -> Network:
    """Fit on the word ids of all texts but a tenth, which calibrates the thresholds.

    While training, a text's words carry the odds of the half that it is not in;
    for scoring, the odds of all rows take their place.
    """
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(docs))
    hold, fit = order[: len(docs) // 10], order[len(docs) // 10 :]
    half = rng.integers(0, 2, len(docs))
    odds_of = lambda at: Odds([docs[i] for i in at], y[at])
    other = [odds_of(fit[half[fit] != side]) for side in (0, 1)]
    prior = float(np.clip(y.mean() if len(y) else 0.01, 0.01, 0.99))
    net = Network.start(odds_of(fit), prior, rng)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    bias_moment, step = [0.0, 0.0], 0
    for _ in range(min(MOST_EPOCHS, max(EPOCHS, STEPS * BATCH // max(1, len(fit))))):
        fit = rng.permutation(fit)
        for part in batched(fit.tolist(), lambda i: len(docs[i]), BATCH):
            step += 1
            odds = np.concatenate([other[half[i]](docs[i]) for i in part])
            _train_step(net, [docs[i] for i in part], odds, y[part], moments, bias_moment, step)
    if len(hold):
        tables = net.tables()
        scores = np.concatenate([score_many(part, net, tables) for part in batched([docs[i] for i in hold], len)])
        held = [langs[i] for i in hold]
        for lang in sorted({x for x in held if x}):
            here = np.array([x == lang for x in held])
            net.thresholds[lang] = _best_threshold(scores[here], y[hold][here])
    return net


def _best_threshold(scores: np.ndarray, y: np.ndarray) -> float:
    """Threshold with the highest F1, the nearest to a half among equals; a half with few examples."""
    if y.sum() < 10:
        return 0.5
    grid = np.linspace(0.1, 0.9, 33)
    f1 = [2 * (y * (scores >= t)).sum() / max(1, y.sum() + (scores >= t).sum()) for t in grid]
    return float(min(grid[np.isclose(f1, max(f1))], key=lambda t: abs(t - 0.5)))


def _train_step(net: Network, docs: list[np.ndarray], odds: np.ndarray, y: np.ndarray, moments, bias_moment, step: int, rate: float = 0.01, decay: float = 1e-4) -> None:
    ids = np.concatenate(docs) & _LOW
    ends = np.cumsum([len(d) for d in docs])
    starts = np.concatenate(([0], ends[:-1]))
    vectors = np.concatenate([odds[:, None], net.embed[ids]], axis=1)
    tops, wheres = [], []
    for f in net.filters:
        x = vectors @ f[0]
        for j in range(1, len(f)):
            x[:-j] += vectors[j:] @ f[j]
        where = np.array([s + x[s : e - max(WIDTHS) + 1].argmax(axis=0) for s, e in zip(starts, ends)])
        wheres.append(where)
        tops.append(np.take_along_axis(x, where, axis=0))
    top = np.concatenate(tops, axis=1) + net.bias
    hidden = np.maximum(top, 0)
    p = 1 / (1 + np.exp(-np.clip(hidden @ net.out + net.out_bias, -30, 30)))
    d_z = ((p - y) / len(y)).astype(np.float32)
    d_top = (d_z[:, None] * net.out) * (top > 0)
    grads, touched, pieces = [], [], []
    for n, (f, where) in enumerate(zip(net.filters, wheres)):
        d = d_top[:, n * FILTERS : (n + 1) * FILTERS]
        g = np.zeros_like(f)
        for j in range(len(f)):
            at = where + j
            g[j] = np.einsum("bk,bkd->dk", d, vectors[at])
            touched.append(ids[at].ravel())
            pieces.append((d[:, :, None] * f[j, 1:].T[None]).reshape(-1, DIM))
        grads.append(g)
    rows, inverse = np.unique(np.concatenate(touched), return_inverse=True)
    d_rows = np.zeros((len(rows), DIM), np.float32)
    np.add.at(d_rows, inverse, np.concatenate(pieces))
    d_rows[rows == PAD] = 0
    updates = [(net.embed, rows, d_rows, moments[0])]
    updates += [(p_, slice(None), g, m) for p_, g, m in zip(net.filters, grads, moments[1:])]
    updates += [(net.bias, slice(None), d_top.sum(axis=0), moments[-2]), (net.out, slice(None), hidden.T @ d_z + decay * net.out, moments[-1])]
    for values, at, g, (m, v) in updates:
        m[at] = 0.9 * m[at] + 0.1 * g
        v[at] = 0.99 * v[at] + 0.01 * g * g
        values[at] -= rate * m[at] / (np.sqrt(v[at]) + 1e-6)
    g = float(d_z.sum())
    bias_moment[0] = 0.9 * bias_moment[0] + 0.1 * g
    bias_moment[1] = 0.99 * bias_moment[1] + 0.01 * g * g
    net.out_bias -= rate * bias_moment[0] / (bias_moment[1] ** 0.5 + 1e-6)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, tables = shared.value
        ids = WordIds()
        for batch in batches:
            texts = (word_ids(raw.as_py(), ids) for raw in batch["raw"])
            scores = [score_many(part, net, tables) for part in batched(texts, len)]
            if scores:
                limits = [net.thresholds.get(x, 0.5) for x in batch["lang"].to_pylist()]
                all_ = np.concatenate(scores)
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(all_), pa.array(all_ >= np.array(limits))], names=["doc_id", "score", "flagged"])

    return run


def classify(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted, flagged`` of every row of ``docs``."""
    spark = docs.sparkSession
    ids = WordIds()
    rows = sample(docs, labels, "toxic", fold(F.col("doc_id"), FOLDS) != 0, most, lambda raw: word_ids(raw, ids), "bigint", SAMPLE_WORDS)
    net = train(rows.x, rows.y, rows.lang)
    slim = Network(net.odds, net.embed[:1], net.filters, net.bias, net.out, net.out_bias, net.thresholds)
    shared = spark.sparkContext.broadcast((slim, net.tables()))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    plain = docs.select("doc_id", lang.alias("lang"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("raw"))
    scored = plain.mapInArrow(_score(shared), "doc_id long, score double, flagged boolean")
    held_out = F.coalesce(fold(F.col("doc_id"), FOLDS) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "flagged")
