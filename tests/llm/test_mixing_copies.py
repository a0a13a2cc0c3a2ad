"""Repeated rows in the mix, against the operator's SQL."""

from collections import Counter

import duckdb
import pandas as pd
import pytest

from tendermill.llm import mixing, queries

SCHEMA = "doc_id long, text string, lang string, source string"


def copies(n=60):
    rows = [(i, f"alpha beta {i} " + "word " * (i % 37), "en", "big") for i in range(400)]
    rows += [(900, "twenty words " * 10, "en" if i % 2 else None, "mid") for i in range(n)]
    rows += [(1000 + i, "some few words here", "en", "low") for i in range(5)]
    return rows + [(None, None, None, None)] * 7 + [(2000, "", "en", "mid")] * 9


def by_sql(rows):
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("documents", documents)
    return Counter(con.sql(queries.ORACLE_SQL["op3_mixing"]).select("doc_id, source, epoch, block, n_tokens, start").fetchall())


@pytest.mark.parametrize("at_once", [mixing.COPIES, 7])
def test_repeated_rows_are_those_of_the_sql(spark, monkeypatch, at_once):
    monkeypatch.setattr(mixing, "COPIES", at_once)
    df = spark.createDataFrame(copies(), SCHEMA)
    placed = mixing.plan(df).select("doc_id", "source", "epoch", "block", "n_tokens", "start").collect()
    assert Counter(map(tuple, placed)) == by_sql(copies())
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert Counter((r.doc_id, r.source) for r in mixed.collect()) == Counter((r.doc_id, r.source) for r in placed)


def test_a_budget_that_ends_among_copies(spark):
    df = spark.createDataFrame(copies(), SCHEMA)
    placed = mixing.plan(df, budget=1500, evenness=0.5).collect()
    taken = Counter((r.doc_id, r.source) for r in placed)
    assert 0 < taken[900, "mid"] < 60
    assert Counter((r.doc_id, r.source) for r in mixing.mix(df, budget=1500, evenness=0.5).collect()) == taken
