"""Every operator against a brute-force version, and on awkward rows.

The awkward table has NULLs in each column, empty and blank texts, a very long
text, copies, repeated rows and columns whose names clash with those that the
operators use inside.
"""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tendermill.llm import ann, bpe, components, mixing, passages, pii, quality_rules, quality_trees, simhash, token_files, toxicity

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LIBRARY = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words int, row string, fp string, key string, block string"
WORDS = [f"w{i}" for i in range(97)]


def long_text(seed, n, vocabulary=WORDS):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(vocabulary, n))


def awkward():
    shared = long_text(1, 70)
    texts = [
        (0, "alpha  beta\tgamma\n\ndelta"), (1, None), (2, ""), (3, " \n\t "), (4, long_text(2, 6000)), (5, shared), (6, shared),
        (7, f"x y {shared} z"), (7, f"x y {shared} z"), (None, f"q {shared}"), (None, None), (9, "Ünï çode 漢字   😀 <|endoftext|>"),
        (10, "a@b.example.com +1 (017) 555-7713 4539 1488 0343 6467 129.38.82.176 2024-02-29"), (11, long_text(3, 60) + " " + long_text(3, 60)), (12, "A" * 5000),
    ]
    return [(i, t, None if n % 4 == 0 else "en", None if n % 5 == 0 else f"s{n % 2}", None, 1, "r", "f", "k", "b") for n, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def blanks(text):
    return (text or "").encode().split()


def brute_passages(rows, window):
    owner = {}
    for i, text in rows:
        w = blanks(text)
        for k in range(len(w) - window + 1):
            if i is not None:
                gram = tuple(w[k : k + window])
                owner[gram] = min(i, owner.get(gram, i))
    out = []
    for i, text in rows:
        w = blanks(text)
        gone = set()
        for k in range(len(w) - window + 1):
            first = owner.get(tuple(w[k : k + window]))
            if first is not None and (i is None or first < i):
                gone |= set(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def found_passages(df, window):
    return Counter(tuple(r)[:4] for r in passages.without_repeats(df, window).collect())


def test_passages(docs, empty):
    assert found_passages(docs, 50) == brute_passages([r[:2] for r in awkward()], 50)
    assert found_passages(empty, 50) == Counter()


def test_passages_of_near_copies_in_many_shards(spark, monkeypatch):
    """Small shards and tasks; copies of copies with edits, so that passages nest and overlap."""
    monkeypatch.setattr(passages, "SHARD_BYTES", 500)
    monkeypatch.setattr(passages, "TASK_BYTES", 400)
    rng = np.random.default_rng(5)
    rows, base = [], [long_text(s, 150, WORDS[:12]).split() for s in (20, 21, 22)]
    for i in range(60):
        w = list(base[rng.integers(3)]) + list(base[rng.integers(3)])[: rng.integers(150)]
        for _ in range(rng.integers(6)):
            w[rng.integers(len(w))] = f"edit{rng.integers(4)}"
        rows.append((int(i), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_passages(df, 20) == brute_passages(rows, 20)


def brute_counts(text):
    w = [x.decode() for x in blanks(text)]
    grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    often = Counter(grams)
    at = {k + j for k, g in enumerate(grams) if often[g] > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", " ".join(w))), len(lines) - len(set(lines)), len(at)


def test_quality_rules(docs, empty):
    rows = quality_rules.judge(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == Counter((i, *brute_counts(t)) for i, t, *_ in awkward())
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept) and 0 <= r.p_good <= 1
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in rows if r.kept)
    assert quality_rules.judge(empty).count() == 0 and quality_rules.keep(empty).count() == 0


def test_junk_is_told_from_prose(spark):
    good = [(i, long_text(i, 150) + ".") for i in range(80)]
    junk = [(100 + i, " ".join(f"{w.upper()}!!{'###' if i % 2 else '***'}" for w in long_text(i, 120).split())) for i in range(8)]
    rows = quality_rules.judge(spark.createDataFrame(good + junk, "doc_id long, text string")).collect()
    assert {r.doc_id for r in rows if r.kept} == set(range(80))


def brute_fingerprint(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    if not w:
        return 0
    grams = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, linked):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_simhash(docs, empty):
    rows = simhash.components(docs).collect()
    prints = {(i, t): brute_fingerprint(t) for i, t, *_ in awkward()}
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1) for r in rows) == Counter((i, prints[i, t]) for i, t, *_ in awkward())
    known = [(i, f) for (i, _), f in prints.items() if i is not None]
    linked = [(a, b) for a, x in known for b, y in known if (x ^ y).bit_count() <= 4]
    label = brute_components([i for i, _ in known], linked)
    assert all(r.component_id == (None if r.doc_id is None else label[r.doc_id]) for r in rows)
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([*set(label.values()), None, None])
    assert simhash.components(empty).count() == 0 and simhash.drop_near_copies(empty).count() == 0


@pytest.mark.parametrize("block", [2048, 8])
def test_links_lose_no_pair(spark, block):
    """Chains of fingerprints a few bits apart, with hot anchors cut into blocks."""
    rng = np.random.default_rng(9)
    prints = {int(x) for x in rng.integers(0, 1 << 63, 60, np.uint64)}
    for x in list(prints)[:6]:
        for _ in range(25):
            x ^= sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(1, 6))))
            prints.add(x)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    reps = spark.createDataFrame(list(zip(signed, range(len(signed)))), "fp long, rep long")
    linked = [(a, b) for a, x in enumerate(signed) for b, y in enumerate(signed[:a]) if ((x ^ y) & (1 << 64) - 1).bit_count() <= 4]
    label = {n: c for n, c in brute_components(range(len(signed)), linked).items() if n != c}
    found = {r.node: r.component for r in components.connected_components(simhash.links(reps, block=block)).collect()}
    assert found == label


def test_anchors_are_code_words_within_two_bits():
    flips = simhash.anchor_flips()
    for s, row in enumerate(flips):
        assert len(row) == len(set(row)) == (16 if s else 1)
        for m in row:
            spelt = 0
            for i in range(1, 32):
                spelt ^= i * (m >> (i - 1) & 1)
            assert spelt == s and m.bit_count() <= 2


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 101)], "u long, v long")
    found = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, 101: 100}


def reference_encoder():
    vocabulary = bpe.Vocabulary.from_file(RANKS)
    return vocabulary, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


VOCABULARY, TIKTOKEN = reference_encoder()
TEXTS = st.text(st.sampled_from("ab thé \n\t\r'sre12!?ñ漢😀\u0085 lAB_"), max_size=60)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_encoding_is_that_of_the_library(text):
    encoder = bpe.Encoder(VOCABULARY, public_tokenizers.PATTERN)
    ids = encoder.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == TIKTOKEN.encode_ordinary(text)
    assert encoder.decode(ids) == text.encode()


@settings(max_examples=80, deadline=None)
@given(TEXTS, st.lists(st.tuples(st.integers(0, 60), st.integers(0, 6), TEXTS), max_size=4))
def test_appends_and_edits_give_the_full_encoding(text, edits):
    kept = bpe.PrefixText(VOCABULARY, public_tokenizers.PATTERN, text)
    for at, size, new in edits:
        at = min(at, len(kept.text))
        kept.edit(at, min(len(kept.text), at + size), new)
        assert kept.ids() == TIKTOKEN.encode_ordinary(kept.text)
    kept.append("thing 12")
    assert kept.ids() == TIKTOKEN.encode_ordinary(kept.text)


def test_edit_encodes_only_around_the_change():
    kept = bpe.PrefixText(VOCABULARY, public_tokenizers.PATTERN, long_text(1, 2000))
    before = kept.encoded_bytes
    kept.edit(3000, 3001, "zz")
    assert kept.encoded_bytes - before < 60


def test_small_caches_change_nothing():
    encoder = bpe.Encoder(VOCABULARY, public_tokenizers.PATTERN)
    encoder.first.kept = encoder.rest.kept = 5
    texts = [long_text(s, 50) for s in range(4)] + ["", "a  b", "x" * 300]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_stream(texts)] == [TIKTOKEN.encode_ordinary(t) for t in texts]


def test_bpe(docs, empty):
    rows = bpe.digests(docs, RANKS, public_tokenizers.PATTERN).collect()
    expected = Counter()
    for i, t, *_ in awkward():
        ids = TIKTOKEN.encode_ordinary(t or "")
        expected[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, rows)) == expected
    assert Counter((r.doc_id, len(r.ids)) for r in bpe.encoded(docs, RANKS, public_tokenizers.PATTERN).collect()) == Counter(k[:2] for k in expected.elements())
    assert bpe.digests(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(-(2**62), 2**62, 20_000)).view(np.uint64)
    assert sorted(token_files.PerfectHash.build(keys)(keys)) == list(range(len(keys)))
    assert len(token_files.PerfectHash.build(keys[:0])(keys[:5])) == 5


def test_token_files(spark, docs, empty):
    tokenizer = Tokenizer.from_file(LIBRARY)
    manifest = token_files.write(docs, LIBRARY, shards=3)
    rows = token_files.read(manifest).collect()
    expected = Counter()
    for i, t, *_ in awkward():
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        expected[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == expected
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is None, i or 0))
    wanted = spark.createDataFrame([(7,), (12,), (8,), (10**12,)], "doc_id long")
    assert Counter(r.doc_id for r in token_files.lookup(wanted, manifest).collect()) == Counter({7: 2, 12: 1})
    assert token_files.read(token_files.write(empty, LIBRARY, shards=2)).count() == 0


def luhn(digits):
    twice = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(twice)) % 10 == 0


def replaced(spark, *values):
    df = spark.createDataFrame([(i, f"see {v} there") for i, v in enumerate(values)], "doc_id long, text string")
    return [r.text[4:-6] for r in pii.pseudonymise(df).orderBy("doc_id").collect()]


def test_pseudonyms_keep_their_format(spark):
    cards = ["4539148803436467", "4539 1488 0343 6467", "4539-1488-0343-6467", "4539148803436468"]
    a, b, c, d = replaced(spark, *cards)
    assert d == cards[3] and a != cards[0] and luhn(a)
    assert re.sub(r"\D", "", b) == re.sub(r"\D", "", c) == a and re.fullmatch(r"\d{4}( \d{4}){3}", b)
    values = ["129.38.82.176", "300.1.1.1", "2024-02-29", "2023-02-29", "29.02.2024", "+1 (017) 555-7713", "123-45-6789", "000-45-6789", "GB82WEST12345698765432", "GB83WEST12345698765432"]
    new = replaced(spark, *values)
    changed = [x != y for x, y in zip(values, new)]
    assert changed == [True, False, True, False, True, True, True, False, True, False]
    assert all(0 <= int(o) < 256 for o in new[0].split("."))
    assert re.fullmatch(r"(19|20)\d\d-\d\d-\d\d", new[2]) and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", new[5])
    assert int("".join(str(int(ch, 36)) for ch in new[8][4:] + new[8][:4])) % 97 == 1
    assert replaced(spark, "a.b@mail.example.com")[0].endswith("@mail.example.com")
    assert replaced(spark, *values) == new


def test_values_side_by_side_are_all_replaced(spark):
    values = ["+1 (017) 555-7713", "4539148803436467", "4539 1488 0343 6467", "129.38.82.176", "2024-02-29", "x.55@mail4.example.com", "+33 1 23 45 67 89"]
    for a in values:
        new = replaced(spark, *[f"{a} {b}" for b in values], f"{a} 12 apples", f"{a}, {a}.")
        assert not [n for b, n in zip([*values, a, a], new) if a in n or b in n]


def test_permutations_are_one_to_one(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    assert df.select(pii.permute_digits(F.lit("k"), "t", F.col("d")).alias("x")).distinct().count() == 1000
    days = spark.range(73_049).select(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    new = days.select(pii.date(F.lit("k"), F.col("d"), "yyyy-MM-dd").alias("x"))
    assert new.distinct().count() == 73_049 and new.where("x not between '1900-01-01' and '2099-12-31'").count() == 0


def test_pii_rows(docs, empty):
    out = pii.pseudonymise(docs, found="n_found")
    rows = out.collect()
    before = {i: t for i, t, *_ in awkward()}
    assert out.columns == [*docs.columns, "n_found"] and len(rows) == len(awkward())
    assert all(r.text == before[r.doc_id] for r in rows if r.doc_id not in (None, 10))
    assert [r.n_found for r in rows if r.doc_id == 10] == [5]
    assert pii.pseudonymise(empty).count() == 0


def test_marks_in_texts_survive(spark):
    text = f"{pii.MARK}a{pii.ESC}b {pii.ESC}a 129.38.82.176{pii.MARK}"
    new = pii.pseudonymise(spark.createDataFrame([(text,)], "text string")).first().text
    assert re.sub(r"[0-9.]+", "#", new) == re.sub(r"[0-9.]+", "#", text) and "129.38" not in new


def test_mixing(spark):
    sizes = {"big": 700, "mid": 200, "low": 60, None: 40}
    rows = [(i, long_text(i, 30), s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    placed = mixing.plan(df, evenness=0.9, max_epochs=3.0, block_rows=50).collect()
    tokens = Counter()
    for r in placed:
        tokens[r.source] += r.n_tokens
    total = sum(tokens.values())
    assert abs(total - 30_000) < 4 * 30 + 1
    share = np.array([tokens[s] / total for s in sizes])
    uneven = -(share * np.log(share)).sum() / np.log(4)
    assert max(tokens[s] / (30 * n) for s, n in sizes.items()) <= 3.1 and share[0] < 0.7 and uneven > 0.7
    for s in sizes:  # streams have no gaps
        at = 0
        for r in sorted((r for r in placed if r.source == s), key=lambda r: r.start):
            assert r.start == at
            at += r.n_tokens
    mixed = mixing.mix(df, evenness=0.9, max_epochs=3.0, block_rows=50)
    assert mixed.columns == df.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter(r.doc_id for r in placed)


def test_mixing_rows(docs, empty):
    assert mixing.mix(docs).columns == docs.columns
    assert Counter(r.doc_id for r in mixing.mix(docs).collect()) == Counter(r.doc_id for r in mixing.plan(docs).collect())
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[200:700] = x[100]
    rows = [(i, v.tolist(), "extra") for i, v in enumerate(x)]
    rows += [(2000, None, ""), (2020, [0.0] * 16, ""), (2040, [float("nan")] * 16, ""), (2060, [None] * 16, ""), (None, x[0].tolist(), ""), (2080, [], ""), (2100, [1.0], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    found = {}
    for r in ann.neighbours(df).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == set(range(0, 1500, 20))
    hits = 0
    wide = x.astype(np.float64)
    for q, got in found.items():
        got.sort()
        score = wide @ wide[q]
        order = [i for i in np.lexsort((np.arange(1500), -score)) if i != q][:20]
        assert [g[0] for g in got] == list(range(1, 21)) and np.allclose([g[2] for g in got], [score[g[1]] for g in got])
        hits += len(set(order) & {g[1] for g in got})
    assert hits / (20 * len(found)) >= 0.9


def test_neighbours_of_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    few = ann.neighbours(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0])], schema)).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in sorted(few, key=lambda r: r["rank"])] == [(0, 1, 2), (0, 2, 1)]
    assert ann.neighbours(spark.createDataFrame([], schema)).count() == 0


def labelled(spark):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(1500):
        words = long_text(i, 60, [f"{a}{b}" for a in "bcdfg" for b in WORDS]).split()
        toxic, good = i % 6 == 0, i % 3 != 0
        if toxic:
            words[rng.integers(60)] = ["Vile!", "odious,", "wretch"][i % 3]
        if not good:
            words = [f"{w}***" for w in words]
        rows.append((i, " ".join(words), "en"))
        labels.append((i, int(good), int(toxic)))
    rows += [(5000, None, None), (5001, "", "en"), (None, "odd", "en"), (3, rows[3][1], "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module, label, folds, held, limit", [(toxicity, "toxic", 5, 0, 0.5), (quality_trees, "quality", 4, 2, 0.7)])
def test_classifiers(spark, module, label, folds, held, limit):
    docs, labels = labelled(spark)
    rows = module.classify(docs, labels).collect()
    assert len(rows) == 1504 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= limit) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % folds == held) for r in rows)
    truth = {r.doc_id: r[label] for r in labels.collect()}
    tested = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert len(tested) > 200 and sum(p == y for p, y in tested) / len(tested) > 0.95


@pytest.mark.parametrize("module", [toxicity, quality_trees])
def test_classifiers_without_rows(spark, module):
    docs, labels = labelled(spark)
    assert module.classify(docs.limit(0), labels).count() == 0
    assert module.classify(docs.limit(5), labels.limit(0)).count() == 5
