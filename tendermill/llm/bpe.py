"""Byte-level BPE by dynamic programming over prefixes.

For each prefix of a piece exactly one token can end its encoding.  A token may
follow the encoding of the prefix before it if, and only if, it and that
prefix's last token stay apart when both are encoded together; trying the
vocabulary's suffixes at each position finds the one token for which that
holds.  The table of last tokens is the encoding of every prefix at once:
appending bytes only adds entries, and an edit keeps the entries before it.

A text is cut into pieces by the tokenizer's pattern first, and pieces are
encoded separately.  :class:`PrefixText` keeps the tables of a text's pieces,
so that an append or an edit cuts and encodes again only around the change.

In Spark, :func:`encoded` runs over Arrow batches of whole texts; the tables of
recent pieces are kept, within a bound, for a task's lifetime.

Defined results: NULL and empty texts have no tokens; NULL ids and repeated
rows are encoded like any others; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tendermill.llm.common import text_bytes
from tendermill.llm.pieces import TextEncoder

#: Bytes of ids handed to Spark at a time.
OUT_BYTES = 8 << 20
#: Pairs of tokens whose border is remembered.
PAIRS = 1_000_000


class Vocabulary:
    """Ranks of byte strings, with what the prefix tables need."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for word, rank in ranks.items():
            self.bytes_of[rank] = word
        #: Every end of a token, with the rank if it is a token itself, else -1.
        self.suffixes = {word[i:]: -1 for word in ranks for i in range(len(word))} | ranks
        # A merge of tokens a and b makes the token whose bytes theirs spell; the parts of each token come from its own encoding with lower ranks.
        self.parts: list[tuple[int, int] | None] = [None] * len(self.bytes_of)
        self.merged: dict[tuple[int, int], int] = {}
        for word, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(word) > 1:
                pair = tuple(self._encode_below(word, rank))
                if len(pair) == 2:
                    self.parts[rank] = pair
                    self.merged[pair] = rank
        self._apart: dict[tuple[int, int], bool] = {}

    @classmethod
    def from_file(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)})

    def _encode_below(self, word: bytes, limit: int) -> list[int]:
        """Plain merging with the ranks under ``limit``; for single tokens only."""
        out = [word[i : i + 1] for i in range(len(word))]
        while len(out) > 1:
            rank, i = min((self.ranks.get(a + b, limit), i) for i, (a, b) in enumerate(zip(out, out[1:])))
            if rank >= limit:
                break
            out[i : i + 2] = [out[i] + out[i + 1]]
        return [self.ranks[x] for x in out]

    def apart(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b, encoded together, give a and b."""
        known = self._apart.get((a, b))
        if known is None:
            if len(self._apart) > PAIRS:
                self._apart.clear()
            known = self._apart[a, b] = self._stay_apart(a, b)
        return known

    def _stay_apart(self, a: int, b: int) -> bool:
        # Undo the merges on the two sides of the border, the latest first.  At each moment the tokens
        # that touch the border are ``a`` and ``b``; a merge across it would have come before the merge
        # undone last if its rank is lower (on the right side, also if it is the same: merging goes from the left).
        before = len(self.bytes_of)
        while True:
            across = self.merged.get((a, b), before)
            if across < before:
                return False
            left, right = self.parts[a], self.parts[b]
            if left is None and right is None:
                return True
            if right is None or (left is not None and a > b):
                before, a = a, left[1]
            else:
                before, b = b + 1, right[0]

    def extend(self, last: list[int], piece: bytes, start: int) -> None:
        """Make ``last[i]``, the last token of ``piece[:i + 1]``, for i from ``start``."""
        del last[start:]
        suffixes, known, apart = self.suffixes, self._apart, self.apart
        for end in range(start + 1, len(piece) + 1):
            found = []
            for at in range(end - 1, -1, -1):
                token = suffixes.get(piece[at:end])
                if token is None:
                    break
                if token >= 0:
                    found.append((at, token))
            for at, token in reversed(found):
                if not at or (known[pair] if (pair := (last[at - 1], token)) in known else apart(*pair)):
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")

    def walk(self, last: list[int]) -> list[int]:
        """The tokens of the whole piece, read backwards from its table."""
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.bytes_of[out[-1]])
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        last: list[int] = []
        self.extend(last, piece, 0)
        return self.walk(last)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Encoder(TextEncoder):
    """Whole texts to the bytes of their ids (little-endian unsigned 32-bit) and back."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        super().__init__(pattern, self._encode_piece)

    def _encode_piece(self, piece: str) -> bytes:
        return array("I", self.vocabulary.encode_piece(piece.encode())).tobytes()

    def encode(self, text: str) -> bytes:
        return self.encode_text(text)

    def decode(self, ids: bytes) -> bytes:
        return self.vocabulary.decode(np.frombuffer(ids, "<u4").tolist())


class PrefixText:
    """A text with the prefix tables of its pieces; stays equal to a full encoding under edits."""

    #: Pieces before an edit that are cut again: a cut depends on the piece and on the character after it.
    BACK = 2

    def __init__(self, vocabulary: Vocabulary, pattern: str, text: str = ""):
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.text, self.starts, self.tables = "", [], []
        self.encoded_bytes = 0
        self.append(text)

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def _table(self, piece: str, old: tuple[bytes, list[int]] | None) -> tuple[bytes, list[int]]:
        """Table of a piece; keeps the entries of the prefix that it shares with ``old``."""
        raw, last, same = piece.encode(), [], 0
        if old:
            same = next((i for i, (x, y) in enumerate(zip(raw, old[0])) if x != y), min(len(raw), len(old[0])))
            last = old[1][:same]
        self.vocabulary.extend(last, raw, same)
        self.encoded_bytes += len(raw) - same
        return raw, last

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace ``text[start:end]`` by ``new``."""
        self.text = self.text[:start] + new + self.text[end:]
        shift = len(new) - (end - start)
        first = max(0, bisect.bisect_right(self.starts, start) - 1 - self.BACK)
        at = self.starts[first] if self.starts else 0
        old_at = {s + shift: i for i, s in enumerate(self.starts) if s >= end}
        starts, tables, rest = [], [], len(self.starts)
        for m in self.pattern.finditer(self.text, at):
            # After the change, the old cuts hold again from the first one that the new cuts meet.
            if m.start() >= start + len(new) and m.start() in old_at:
                rest = old_at[m.start()]
                break
            i = first + len(starts)
            starts.append(m.start())
            tables.append(self._table(m.group(), self.tables[i] if i < len(self.tables) else None))
        self.tables = self.tables[:first] + tables + self.tables[rest:]
        self.starts = self.starts[:first] + starts + [s + shift for s in self.starts[rest:]]

    def ids(self) -> list[int]:
        return [t for _, last in self.tables for t in self.vocabulary.walk(last)]


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder a Python worker, whatever the number of its tasks."""
    return Encoder(Vocabulary.from_file(path), pattern)


def _digests(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for ids in enc.encode_stream(raw.as_py().decode("utf-8", "replace") for raw in batch["raw"]):
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(enc.decode(ids)).hexdigest())
            arrays = [batch["doc_id"], pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            held, size, at = [], 0, 0
            for i, raw in enumerate(batch["raw"]):
                held.append(enc.encode_text(raw.as_py().decode("utf-8", "replace")))
                size += len(held[-1])
                if size >= OUT_BYTES or i + 1 == batch.num_rows:
                    ids = pa.array(np.frombuffer(b"".join(held), "<i4"))
                    offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in held]))).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(at, len(held)), pa.ListArray.from_arrays(offsets, ids)], names=["doc_id", "ids"])
                    held, size, at = [], 0, i + 1

    return run


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids`` of each row."""
    return text_bytes(docs, "doc_id").mapInArrow(_ids(path, pattern), "doc_id long, ids array<int>")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Number of tokens, digest of the ids and digest of the text decoded from them."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return text_bytes(docs, "doc_id").mapInArrow(_digests(path, pattern), schema)
