"""Fill-in-the-middle against a plain version, on awkward rows and with other units."""

import hashlib
from collections import Counter

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tendermill.llm import fim, queries

SCHEMA = "doc_id long, text string, n long, form string, row string, output string"


def rows():
    texts = ["", None, "a", "ab", " \n\r\n\t", "aé😀\n漢" * 700, "$1 \\Q x \\E {2}", "has <P> in it", "<S>", "x<M", "😀" * 65, "z" * 64, "q" * 128]
    out = [(i, t) for i, t in enumerate(texts * 9)] + [(None, "no id"), (None, None), (3, "ab"), (3, "ab")]
    return [(i, t, 7, "psm", "r", "o") for i, t in out]


def plain(doc_id, text):
    t = text or ""
    n, digest = len(t), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    form = "plain" if not t or any(x in t for x in fim.SENTINELS) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
    out = {"plain": t, "psm": f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}", "spm": f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"}[form]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, n, form, *((None, None) if form == "plain" else (a, b - a)), sha(out), sha(t))


def test_outputs_are_those_of_the_plain_version(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    found = Counter(map(tuple, fim.digests(docs).collect()))
    assert found == Counter(plain(i, t) for i, t, *_ in rows())
    assert {f[2] for f in found} == {"plain", "psm", "spm"}
    assert fim.digests(docs.limit(0)).count() == 0


def test_the_sql_gives_the_same_rows(spark, tmp_path):
    docs = spark.createDataFrame(rows(), SCHEMA)
    pq.write_table(docs.toArrow(), tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    assert Counter(con.execute(queries.ORACLE_SQL["op13_fim"]).fetchall()) == Counter(map(tuple, fim.digests(docs).collect()))


@pytest.mark.parametrize("unit", [r"\S*\s+|\S+", r"(?s:.{3})", r"[a-z]"])
def test_other_units_come_back_whole(spark, unit):
    words = [(i, f"one two  three\n{'four ' * (i % 150)}end", 0, "", "", "") for i in range(300)]
    made = fim.transform(spark.createDataFrame([*rows(), *words], SCHEMA), unit=unit, sentinels=("$a", "\\b", "c.c"), rate=100, spm=50)
    text = F.coalesce(F.col("row.text"), F.lit(""))
    back = fim.restored(F.col("output"), F.col("form"), ("$a", "\\b", "c.c"))
    assert made.where(back != text).count() == 0
    assert made.where("form = 'plain' and n > 0").count() == 0 and made.select("form").distinct().count() == 3


def test_words_are_counted_and_not_cut(spark):
    made = fim.transform(spark.createDataFrame([(i, "aa bb cc dd") for i in range(50)], "doc_id long, text string"), unit=r"\S*\s+|\S+", rate=100)
    cut = made.select("n", fim.parts(F.col("output"), F.col("form")).alias("p")).collect()
    assert all(r.n == 4 and all(len(x) in (0, 3, 6, 9, 2, 5, 8, 11) for x in r.p) for r in cut)


def test_sentinels_must_differ(spark):
    with pytest.raises(ValueError):
        fim.transform(spark.createDataFrame([(1, "a")], "doc_id long, text string"), sentinels=("<P>", "<P>x", "<M>"))


def test_a_very_long_text_needs_no_deep_stack(spark):
    long = spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("aé😀\n"), 500_000).alias("text"))
    row = fim.digests(long).first()
    assert row.n == 2_000_000 and row.restored_sha256 == hashlib.sha256(("aé😀\n" * 500_000).encode()).hexdigest()
