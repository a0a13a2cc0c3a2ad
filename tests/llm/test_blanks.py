"""Characters that Python and the tokenizers' patterns take for blanks differently."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tendermill.llm import bpe, hyperminhash, near_copies, token_files
from test_llm import LIBRARY, RANKS, TIKTOKEN, VOCABULARY, awkward, SCHEMA

CONTROLS = [chr(c) for c in range(32)] + ["\x7f", "\x85", "\xa0", " ", " ", " ", "　", "﻿", "​"]
OURS, OTHER, TOKENIZER = bpe.Encoder(VOCABULARY, public_tokenizers.PATTERN), token_files.LibraryEncoder(LIBRARY), Tokenizer.from_file(LIBRARY)


def differs(text):
    if np.frombuffer(OURS.encode(text), "<u4").tolist() != TIKTOKEN.encode_ordinary(text):
        return "byte-level"
    if np.frombuffer(OTHER.encode_text(text), f"<u{OTHER.width}").tolist() != TOKENIZER.encode(text, add_special_tokens=False).ids:
        return "library"


def test_controls_in_all_positions():
    around = ["", "a", "!", " ", "1", "\n", "é", "..", " a ", "\x1c"]
    wrong = [(a + c + b, w) for c in CONTROLS for a in around for b in around if (w := differs(a + c + b))]
    assert not wrong, wrong[:5]


def test_random_texts():
    rng = random.Random(4)
    letters = [*CONTROLS, *"ab cd  EF!?.,'s12é漢😀-_"]
    wrong = [(t, w) for t in ("".join(rng.choices(letters, k=rng.randrange(1, 24))) for _ in range(100_000)) if (w := differs(t))]
    assert not wrong, wrong[:5]


def test_records_with_separators_in_spark(spark):
    texts = ["record end.\x1e next", "!\x1c", "\x1c!", "..\x1f\x1f", "a\x1d b", "\x1c\x1d\x1e\x1f", " \x1f "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: list(r.ids) for r in bpe.encoded(docs, RANKS, public_tokenizers.PATTERN).collect()}
    assert found == {i: TIKTOKEN.encode_ordinary(t) for i, t in enumerate(texts)}
    rows = token_files.read(token_files.write(docs, LIBRARY, shards=2)).collect()
    crc = lambda t: zlib.crc32(np.array([*TOKENIZER.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert {r.doc_id: r.ids_crc32 for r in rows} == {i: crc(t) for i, t in enumerate(texts)}


def test_a_foreign_key_with_a_fingerprint_of_the_shard_finds_nothing(spark, tmp_path):
    keys = np.arange(0, 3000, 3, dtype=np.int64)
    (tmp_path / "i").write_bytes(token_files.index_bytes(keys, np.ones(len(keys), np.int64), 0, 2))
    (tmp_path / "p").write_bytes(bytes(2 * len(keys)))
    shard = token_files.Shard(f"file://{tmp_path}/p", f"file://{tmp_path}/i")
    foreign = np.arange(1, 30_000, 3, dtype=np.int64)
    slot = shard.mph(foreign.view(np.uint64))
    shard.marks = shard.marks.copy()
    at = np.flatnonzero(slot >= 0)[0]
    shard.marks[slot[at]] = token_files.fingerprints(foreign.view(np.uint64))[at]
    assert not shard.locate(foreign)[1].any()


def test_columns_named_as_those_inside(spark):
    rows = [(1, "one two three four five six", 1, 2, 3, 4), (2, "one two three four five six", 1, 2, 3, 4), (2, "other words are here", 0, 0, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _rows int, _row int, size int, row int")
    for kept in (near_copies.drop(docs), hyperminhash.drop(docs)):
        assert kept.columns == docs.columns and Counter(map(tuple, kept.collect())) == Counter([rows[0]])
    assert len(awkward()) and SCHEMA
