"""Collocations against a plain count of all phrases."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from tendermill.llm import phrases, queries

SCHEMA = "doc_id long, text string, lang string, f long, key string, shard string"


def rows():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)] + ["New", "York", "é", "漢字", "a-b", "\x1f"]
    p = 1 / np.arange(1, len(words) + 1)
    out = []
    for i in range(160):
        n = int(rng.integers(1, 120))
        t = list(rng.choice(words, n, p=p / p.sum()))
        for _ in range(n // 12):
            at = int(rng.integers(0, n))
            t[at:at] = ["the", "Quick", "brown", "fox"] if rng.random() < 0.6 else ["brown", "fox", "jumps"]
        for at in rng.integers(0, len(t), len(t) // 9):
            t[at] += str(rng.choice(list(".,;:!?\n\r\x0b\x0c")))
        out.append((i, str(rng.choice([" ", "  ", "\t"])).join(t), [None, "en", "fr", "und"][i % 4]))
    out += [(1000, None, "en"), (1001, "", "en"), (1002, " \t\n", "de"), (None, "new york " * 400, "en"), (None, None, None), (7, "one one one " * 50, "xx"), (7, "one one one " * 50, "xx")]
    return [(*r, 1, "k", "s") for r in out]


def plain(rows, support, top=2000):
    n, f = Counter(), defaultdict(Counter)
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, 5):
                for i in range(len(w) - size + 1):
                    f[lang][tuple(w[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        chosen = {p: a for p, a in counts.items() if len(p) > 1 and a >= support}
        best = []
        for p, a in chosen.items():
            inside = any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * b >= 80 * a for q, b in chosen.items())
            if not inside:
                score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return Counter(out)


@pytest.mark.parametrize("support, shards, bits, chunk", [(30, 4, 1 << 20, 8 << 20), (30, 1, 1 << 20, 3000), (7, 5, 1 << 7, 2000), (2, 9, 1 << 16, 50_000)])
def test_phrases_are_those_of_the_plain_count(spark, monkeypatch, support, shards, bits, chunk):
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    found = Counter(map(tuple, phrases.collocations(docs, support=support, shards=shards, bits=bits).collect()))
    want = plain(rows(), support)
    assert found == want and len(want) > 20


def test_the_first_rows_of_each_language(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    assert Counter(map(tuple, phrases.collocations(docs, support=3, top=5).collect())) == plain(rows(), 3, 5)


def test_no_rows(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None, 1, "", "")], SCHEMA)).count() == 0


def test_the_sql_gives_the_same_rows(spark, tmp_path):
    docs = spark.createDataFrame(rows(), SCHEMA)
    pq.write_table(docs.toArrow(), tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    assert Counter(con.execute(queries.ORACLE_SQL["op12_phrases"]).fetchall()) == plain(rows(), 30)


def test_scores_are_exact_beyond_64_bits(spark):
    a, b = 10**17 + 1, 3 * 10**17 + 7
    counts = spark.createDataFrame([("x", "p q", 2, a), ("x", "p", 1, b), ("x", "q", 1, b + 1)], "lang string, phrase string, size int, f long")
    row = phrases.scored(counts).first()
    assert (row.a, row.l, row.r, row.score) == (a, b, b + 1, 2000000 * a // (2 * b + 1))
