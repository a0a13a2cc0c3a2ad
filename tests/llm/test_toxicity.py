"""Texts are scored and fitted whole, and each for itself."""

import numpy as np

from tendermill.llm import toxicity


def fitted(rows):
    ids = toxicity.WordIds()
    return toxicity.train([toxicity.word_ids(raw, ids) for raw, _, _ in rows], np.array([y for _, y, _ in rows], np.float64), [lang for _, _, lang in rows])


def trained(extra=()):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        words = [f"w{x}" for x in rng.integers(0, 97, 30)]
        if i % 3 == 0:
            words[0] = "odious"
        rows.append((" ".join(words).encode(), int(i % 3 == 0), "en"))
    return fitted([*rows, *extra])


def test_a_score_is_the_same_alone_and_in_any_batch():
    net = trained()
    tables, ids = net.tables(), toxicity.WordIds()
    clean, toxic, none = (toxicity.word_ids(x, ids) for x in (b"w1 w2 w3", b"odious odious odious", b""))
    alone = [toxicity.score_many([x], net, tables)[0] for x in (clean, toxic, none)]
    assert alone[0] < 0.5 < alone[1]
    for batch in ([clean, toxic, none], [none, toxic, clean, clean], [clean, none, toxic], [clean, clean, toxic, toxic, none]):
        expected = [next(a for a, x in zip(alone, (clean, toxic, none)) if x is d) for d in batch]
        assert toxicity.score_many(batch, net, tables).tolist() == expected


def test_a_training_step_does_not_read_the_next_text():
    net, ids = trained(), toxicity.WordIds()
    mine, other = (toxicity.word_ids(x, ids) for x in (b"w1", b"never"))
    net.odds = lambda at: np.zeros(len(at), np.float32)
    for f in net.filters:
        f[:] = 1
    net.embed[other & toxicity._LOW] = 5
    net.embed[toxicity.PAD] = 0
    before = net.embed.copy()
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    fits = toxicity.score_many([other], net, net.tables())[0]  # no error, so no gradient of its own
    toxicity._train_step(net, [mine, other], np.zeros(6, np.float32), np.array([1.0, fits]), moments, [0.0, 0.0], 1)
    at = other & toxicity._LOW
    assert np.allclose(net.embed[at], before[at], atol=1e-4)


def test_words_at_the_end_of_long_texts_are_learnt():
    rng = np.random.default_rng(4)
    text = lambda words, end: " ".join([*(f"w{x}" for x in rng.integers(0, 97, words)), end]).encode()
    net = trained([(text(3100, "wicked" if i % 2 else "plain"), i % 2, "en") for i in range(90)])
    ids = toxicity.WordIds()
    wicked, plain = (toxicity.score_many([toxicity.word_ids(text(40, x), ids)], net, net.tables())[0] for x in ("wicked", "plain"))
    assert plain < 0.5 < wicked


def test_batches_end_by_words_and_by_rows(monkeypatch):
    monkeypatch.setattr(toxicity, "BATCH_WORDS", 10)
    assert list(toxicity.batched([3, 3, 30, 9, 1, 2], lambda x: x)) == [[3, 3, 30], [9, 1], [2]]
    assert list(toxicity.batched([1, 1, 1], lambda x: x, 2)) == [[1, 1], [1]]


def test_scores_are_those_of_a_plain_convolution():
    net, ids = trained(), toxicity.WordIds()
    texts = [b"odious w1 w2 Odious! w3", b"w4", b"", b" ".join(b"w%d" % (i * 7 % 97) for i in range(400)), b"w1 w2 w3 w4 w5 odious"]
    found = toxicity.score_many([toxicity.word_ids(x, ids) for x in texts], net, net.tables())
    for raw, got in zip(texts, found):
        words = [toxicity.word_ids(w, ids)[0] for w in raw.split()] or [0]
        vectors = [[float(net.odds(np.array([w]))[0]), *map(float, net.embed[w & toxicity._LOW])] for w in words]
        z, n = net.out_bias, 0
        for f in net.filters:
            for k in range(toxicity.FILTERS):
                best = -float("inf")
                for at in range(len(words)):
                    r = 0.0
                    for j in range(len(f)):
                        if at + j < len(words):
                            r += sum(v * float(w) for v, w in zip(vectors[at + j], f[j, :, k]))
                    best = max(best, r)
                z += max(best + float(net.bias[n]), 0.0) * float(net.out[n])
                n += 1
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-4
