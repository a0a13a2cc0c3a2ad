"""HyperMinHash near duplicates against a comparison of all pairs."""

import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from tendermill.llm import components, hyperminhash, queries
from tendermill.llm.passages import WordHashes

SCHEMA = "doc_id long, text string, n long, mark string, rep string, h string, members string"


def edited(rng, words, share):
    return [f"e{rng.integers(1 << 40)}" if rng.random() < share else w for w in words]


def rows(copies=24):
    rng = np.random.default_rng(9)
    prose = lambda n: [f"w{i}" for i in rng.integers(0, 3000, n)]
    texts = []
    for share in (0.002, 0.006, 0.01, 0.015):
        base = prose(int(rng.integers(60, 400)))
        texts += [base, *(edited(rng, base, share) for _ in range(copies))]
    for _ in range(copies):
        base = prose(int(rng.integers(6, 60)))
        texts += [base, base + prose(1), base[:-1], base]
    chain = prose(150)
    for _ in range(copies):
        texts.append(chain)
        chain = chain[2:] + prose(2)
    texts += [prose(n) for n in (0, 1, 2, 4, 5, 6, 9, 5000)] * 2
    out = [(int(i), " ".join(t)) for i, t in zip(rng.permutation(len(texts)), texts)]
    same = prose(40)
    out += [(9001, " ".join(same)), (9002, " ".join(same).upper()), (9003, "\t".join(same)), (9004, None), (9005, ""), (9006, " \n"), (9007, "a b"), (9008, "A  b"), (9009, "a b c")]
    out += [(None, " ".join(same)), (None, None), (9001, " ".join(same)), (9001, "another text of the same id altogether so it is"), (9010, "another text of the same id altogether so it is"), (9011, None), (9011, " ".join(same))]
    return [(*r, 1, "m", "r", "h", "x") for r in out]


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain(rows, percent=85):
    known = [(r[0], shingles(r[1])) for r in rows if r[0] is not None]
    root = {i: i for i, _ in known}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(known):
        for j, b in known[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b) and (x := find(i)) != (y := find(j)):
                root[max(x, y)] = min(x, y)
    return Counter([(i, len(s), find(i), i == find(i)) for i, s in known] + [(None, len(shingles(r[1])), None, True) for r in rows if r[0] is None])


@pytest.mark.parametrize("block, pairs, percent", [(2048, 4, 85), (16, 0, 85), (64, 1, 70)])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, block, pairs, percent):
    monkeypatch.setattr(hyperminhash, "PAIRS", pairs)
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    assert Counter(map(tuple, hyperminhash.components(docs, percent, block).collect())) == plain(rows(), percent)


def test_no_rows(spark):
    assert hyperminhash.components(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame([(1, None, 1, "", "", "", "")], SCHEMA)
    assert [tuple(r) for r in hyperminhash.components(one).collect()] == [(1, 0, 1, True)]


def test_one_document_of_each_group_stays(spark):
    docs = spark.createDataFrame(rows(6), SCHEMA)
    kept = hyperminhash.drop(docs)
    assert kept.columns == docs.columns
    want = Counter(r[0] for r in plain(rows(6)) if r[0] is not None and r[3]).keys()
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(want)
    assert kept.where("doc_id is null").count() == 2


def test_the_sql_gives_the_same_rows(spark, tmp_path):
    unique = [r for i, r in enumerate(rows(8)) if r[0] is not None and r[0] not in (9001, 9011)]
    pq.write_table(spark.createDataFrame(unique, SCHEMA).toArrow(), tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    assert Counter(con.execute(queries.ORACLE_SQL["op11_hyperminhash"]).fetchall()) == plain(unique)


@pytest.mark.parametrize("n", [6, 40, 300, 4000])
def test_estimates_are_near_the_similarity(n):
    rng = np.random.default_rng(n)
    off = []
    for _ in range(60):
        both, more = rng.integers(0, 1 << 63, n, dtype=np.uint64), rng.integers(0, 1 << 63, n // 3, dtype=np.uint64)
        a, b = np.unique(both), np.unique(np.concatenate([both, more]))
        regs = np.stack([hyperminhash.registers(a), hyperminhash.registers(b)])
        off.append(hyperminhash.estimates(regs, slice(0, 1))[0, 1] - len(a) / len(b))
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.05


def test_registers_of_disjoint_sets_differ():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64)) for _ in range(200)]
    regs = np.stack([hyperminhash.registers(s) for s in sets])
    est = hyperminhash.estimates(regs, slice(0, 200))
    assert abs(est[~np.eye(200, dtype=bool)].mean()) < 1e-3 and np.allclose(np.diag(est), 1, atol=1e-5)


def test_products_count_common_values():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 500, int(rng.integers(1, 300)), dtype=np.uint64)) for _ in range(40)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    found = hyperminhash.intersections(sets)
    assert all(found[i][j] == want[i][j] for i in range(40) for j in range(40) if i != j)
    assert all(hyperminhash.common(a, b) == want[i][j] for i, a in enumerate(sets) for j, b in enumerate(sets))


def test_shingles_are_lower_cased_words():
    h = WordHashes()
    assert (hyperminhash.shingle_set(b"A b\tC d e F", h) == hyperminhash.shingle_set(b"a B c\x0bd E f", h)).all()
    assert len(hyperminhash.shingle_set(b"x y z", h)) == 1 and not len(hyperminhash.shingle_set(b" \n", h))


@pytest.mark.parametrize("hub", [1, 1000])
def test_components_with_and_without_hubs(spark, monkeypatch, hub):
    monkeypatch.setattr(components, "HUB", hub)
    rng = np.random.default_rng(4)
    edges = [(0, i) for i in range(1, 60)] + [(int(a), int(b)) for a, b in rng.integers(60, 160, (70, 2))] + [(i, i + 1) for i in range(200, 240)]
    root = list(range(300))
    for _ in range(300):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    found = components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.component for r in found} == {n: root[n] for e in edges if e[0] != e[1] for n in e if root[n] != n}
