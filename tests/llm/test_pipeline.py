"""The pipeline against plain versions of its stages, one after the other."""

from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken

import brute
import corpus_pipeline
from tendermill.llm import bpe, pii, queries

KEY = "a key of the tests"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents():
    rng = np.random.default_rng(12)
    prose = lambda n: " ".join(rng.choice([f"{a}{b}en" for a in ("lor", "bin", "tal", "mor") for b in "aeiou"], n)) + "."
    texts = [prose(int(rng.integers(25, 120))) for _ in range(60)]
    for i in range(12):  # near copies: one word changed, and exact ones
        words = texts[i].split()
        words[len(words) // 2] = "other"
        texts += [" ".join(words), texts[i]]
    texts += ["#### $$$$ " * 40, "too short", "", None, "one two three four five six seven eight " * 30, f"{prose(30)} write to jo@mail.example.org or 129.38.82.176 on 2024-02-29 {prose(20)}"]
    texts += [prose(3000), f"{prose(40)}\n\n{prose(30)}  \t{prose(10)}"]
    rows = [(i, t, "en" if i % 3 else None, "big" if i % 2 else f"s{i % 5}", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[7], (None, prose(40), "en", None, 3)]


def stages(rows):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(n, r[1]) for n, r in enumerate(rows)], columns=["doc_id", "text"]))
    kept = con.sql(f"SELECT doc_id FROM ({queries.ORACLE_SQL['op2_quality_rules']}) WHERE kept").fetchall()
    rows = [rows[n] for (n,) in kept]
    rows = brute.near_copies_dropped(rows)
    rows = [(r[0], brute.pseudonymised(KEY, r[1]), *r[2:]) for r in rows]
    con.register("documents", pd.DataFrame([r[:4] for r in rows], columns=COLUMNS[:4]).astype({"doc_id": "Int64"}))
    placed = Counter(r[0] for r in con.sql(f"SELECT doc_id FROM ({queries.ORACLE_SQL['op3_mixing']})").fetchall())
    vocabulary = bpe.Vocabulary.from_file(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    return Counter({(r[0], tuple(library.encode_ordinary(r[1] or ""))): placed[r[0]] for r in rows if placed[r[0]]})


def test_the_pipeline_is_its_plain_stages(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(documents(), schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set(pii.KEY_SETTING, KEY)
    try:
        found = Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    expected = stages(documents())
    assert sum(expected.values()) > 40 and {r[0] for r in documents()} - {k[0] for k in expected}
    assert found == expected


def test_the_stages_take_an_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
