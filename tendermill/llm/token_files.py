"""Token ids as binary shards with a minimal perfect hash index.

Documents are range-partitioned by id; a partition is one shard: a payload file
of raw little-endian ids (16 bits if the vocabulary fits, else 32) in ascending
order of ids, and an index file.  The index maps a document id through a
minimal perfect hash to a slot with the key's fingerprint, the offset of its
ids and the number of rows, so a keyed read is one probe and one read of the
payload.  A key that is not in the shard fails the fingerprint or, rarely, the
comparison with the stored key after it.

Files are written through ``pyarrow.fs`` under the name of the attempt and then
moved, so that a repeated task replaces its own files and readers never see a
part.  A manifest table has one row a shard: names, counts and least and
greatest id; prefix sums of its counts give every document's global position.

Defined results: NULL and empty texts hold the end id alone; rows with a NULL
id come last and are read in order, but not by key; repeated ids lie together,
ordered by a hash of their text, and a keyed read returns all of them; extra columns are
ignored; an empty table gives an empty manifest.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tendermill.llm.common import as_uri, materialise, new_path, text_bytes
from tendermill.llm.pieces import TextEncoder

MAGIC = b"TMIX0001"
#: Bits a key in a level of the hash: more is faster and larger.
GAMMA = 2.0
END_ID = 2
#: Bytes of text in a shard, at most about; its keys are held in one task.
SHARD_BYTES = 128 << 20


def scatter(keys: np.ndarray, salt: int) -> np.ndarray:
    """64-bit finaliser of ``keys`` (unsigned 64-bit) for one level."""
    x = keys + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Distinct 64-bit keys to 0 .. n - 1, level by level.

    In each level the keys alone at their position own it; the others go on.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        ones = [int(np.bitwise_count(x).sum()) for x in levels]
        self.base = np.concatenate(([0], np.cumsum(ones))).astype(np.int64)
        self.before = [np.concatenate(([0], np.cumsum(np.bitwise_count(x), dtype=np.int64))) for x in levels]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys):
            size = -(-max(64, int(GAMMA * len(keys))) // 64) * 64
            at = (scatter(keys, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            keys = keys[~alone[at]]
        return cls(levels)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Slots of ``keys``; -1 for some of the keys that were not built in."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            at = scatter(keys[left], level) % np.uint64(64 * len(bits))
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (bits[word] >> bit) & np.uint64(1) == 1
            under = np.bitwise_count(bits[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            found = self.base[level] + self.before[level][word] + under
            out[left[hit]] = found[hit]
            left = left[~hit]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (scatter(keys, 1 << 20) >> np.uint64(32)).astype("<u4")


def index_bytes(keys: np.ndarray, lengths: np.ndarray, n_null: int, width: int) -> bytes:
    """Index of rows in order; the last ``n_null`` rows have no key."""
    keyed = keys[: len(keys) - n_null].astype(np.int64).view(np.uint64)
    distinct, first, rows = np.unique(keyed.view(np.int64), return_index=True, return_counts=True)
    mph = PerfectHash.build(distinct.view(np.uint64))
    slot = mph(distinct.view(np.uint64))
    starts = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
    slots = [np.empty(len(distinct), t) for t in ("<u4", "<u8", "<u4")]
    slots[0][slot], slots[1][slot], slots[2][slot] = fingerprints(distinct.view(np.uint64)), first, rows
    head = struct.pack("<8sIQQQI", MAGIC, width, len(keys), n_null, len(distinct), len(mph.levels))
    sizes = np.array([len(x) for x in mph.levels], "<u8").tobytes()
    return b"".join([head, sizes, *(x.tobytes() for x in mph.levels), *(x.tobytes() for x in slots), starts.astype("<u8").tobytes(), keyed.tobytes()])


class Shard:
    """Reader of one shard."""

    def __init__(self, payload: str, index: str):
        fs, path = pa.fs.FileSystem.from_uri(index)
        with fs.open_input_stream(path) as f:
            raw = f.read()
        form = "<8sIQQQI"
        magic, self.width, self.rows, self.n_null, n_keys, n_levels = struct.unpack_from(form, raw)
        if magic != MAGIC:
            raise ValueError(f"{index} is no index")
        at = struct.calcsize(form)

        def take(dtype: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, dtype, n, at)
            at += out.nbytes
            return out

        sizes = take("<u8", n_levels)
        self.mph = PerfectHash([take("<u8", int(n)) for n in sizes])
        self.marks, self.first, self.count = take("<u4", n_keys), take("<u8", n_keys), take("<u4", n_keys)
        self.starts, self.keys = take("<u8", self.rows + 1), take("<u8", self.rows - self.n_null).view(np.int64)
        self.fs, self.path = pa.fs.FileSystem.from_uri(payload)

    def locate(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and number of rows of each key; no rows for keys that are not here."""
        keys = np.asarray(keys, np.int64).view(np.uint64)
        slot = self.mph(keys)
        if not len(self.marks):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        here = (slot >= 0) & (self.marks[slot] == fingerprints(keys))
        # The fingerprint turns nearly all foreign keys away; the stored key all others.
        here &= self.keys[self.first[slot].astype(np.int64)].view(np.uint64) == keys
        return np.where(here, self.first[slot], 0).astype(np.int64), np.where(here, self.count[slot], 0).astype(np.int64)

    def read(self, row: int, rows: int = 1) -> list[np.ndarray]:
        """Ids of ``rows`` rows from ``row`` on."""
        a, b = int(self.starts[row]), int(self.starts[row + rows])
        with self.fs.open_input_file(self.path) as f:
            ids = np.frombuffer(f.read_at((b - a) * self.width, a * self.width), f"<u{self.width}")
        cuts = (self.starts[row + 1 : row + rows] - self.starts[row]).astype(np.int64)
        return np.split(ids, cuts)

    def get(self, key: int) -> list[np.ndarray]:
        first, count = self.locate(np.array([key]))
        return self.read(int(first[0]), int(count[0])) if count[0] else []


class Spelling(dict):
    """Characters as the library's model spells them: one letter for each byte."""

    def __init__(self, level):
        self.level = level

    def __missing__(self, code: int) -> str:
        found = self[code] = self.level.pre_tokenize_str(chr(code))[0][0]
        return found


class LibraryEncoder(TextEncoder):
    """The ``tokenizers`` library over distinct pieces; texts with special tokens go to it whole."""

    #: The pattern by which the library's byte-level pre-tokenizer cuts (a fixed value).
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spelling = Spelling(ByteLevel(add_prefix_space=False, use_regex=False))
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.form, self.tokenize = "H" if self.width == 2 else "I", self.tokenizer.model.tokenize
        super().__init__(self.PATTERN, self._encode_piece)

    def _encode_piece(self, piece: str) -> bytes:
        return array(self.form, [t.id for t in self.tokenize(piece.translate(self.spelling))]).tobytes()

    def encode_text(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return array(self.form, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return super().encode_text(text)


@lru_cache(maxsize=1)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def _write_shard(root: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = library_encoder(tokenizer)
        shard, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        end = np.array([end_id], f"<u{enc.width}").tobytes()
        fs, base = pa.fs.FileSystem.from_uri(root)
        fs.create_dir(base, recursive=True)
        name = f"{base}/shard-{shard:06d}"
        keys, lengths, n_null, least, greatest = [], [], 0, None, None
        with fs.open_output_stream(f"{name}.bin.{attempt}") as f:
            for batch in batches:
                texts = (raw.as_py().decode("utf-8", "replace") for raw in batch["raw"])
                for ids in enc.encode_stream(texts):
                    f.write(ids + end)
                    lengths.append(len(ids) // enc.width + 1)
                known = batch["doc_id"].drop_null()
                n_null += batch.num_rows - len(known)
                if len(known):
                    least = known[0].as_py() if least is None else least
                    greatest = known[-1].as_py()
                keys.append(batch["doc_id"].fill_null(0).to_numpy())
        if not lengths:
            fs.delete_file(f"{name}.bin.{attempt}")
            return
        with fs.open_output_stream(f"{name}.idx.{attempt}") as f:
            f.write(index_bytes(np.concatenate(keys), np.array(lengths), n_null, enc.width))
        for kind in ("bin", "idx"):
            fs.move(f"{name}.{kind}.{attempt}", f"{name}.{kind}")
        file = f"{root.rstrip('/')}/shard-{shard:06d}"
        row = {"shard": shard, "payload": f"{file}.bin", "index": f"{file}.idx", "n_docs": len(lengths), "n_ids": sum(lengths), "least": least, "greatest": greatest}
        yield pa.RecordBatch.from_pylist([row], schema=MANIFEST_ARROW)

    return run


MANIFEST = "shard int, payload string, index string, n_docs long, n_ids long, least long, greatest long"
MANIFEST_ARROW = pa.schema([("shard", pa.int32()), ("payload", pa.string()), ("index", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("least", pa.int64()), ("greatest", pa.int64())])


def write(docs: DataFrame, tokenizer: str, root: str | None = None, end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Write ``docs`` to shards under the URI ``root``; the manifest, with each shard's first position.

    Unless given, the number of shards is that of shuffle partitions, or more so
    that a shard is made of about ``SHARD_BYTES`` of text at most.  Where the
    shared folder is a plain path, ``root`` becomes a file URI.
    """
    spark = docs.sparkSession
    root = as_uri(root or new_path(spark, "token-shards"))
    plain = text_bytes(docs, "doc_id").withColumn("h", F.xxhash64("raw"))
    if not shards:
        size = plain.agg(F.coalesce(F.sum(F.octet_length("raw")), F.lit(0))).first()[0]
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    dealt = plain.repartitionByRange(shards, F.col("doc_id").asc_nulls_last(), "h")
    dealt = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "h", "raw").select("doc_id", "raw")
    manifest = materialise(dealt.mapInArrow(_write_shard(root, tokenizer, end_id), MANIFEST), "token-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            shard = Shard(row["payload"], row["index"])
            first, count = shard.locate(shard.keys)
            if not ((count > 0) & (shard.keys[first] == shard.keys)).all():
                raise ValueError(f"{row['index']} misses keys")
            for at in range(0, shard.rows, 4096):
                ids = shard.read(at, min(4096, shard.rows - at))
                keys = [int(k) for k in shard.keys[at : at + len(ids)]]
                starts = shard.starts[at : at + len(ids)].astype(np.int64) + row["base"]
                crcs = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                arrays = [keys + [None] * (len(ids) - len(keys)), starts, [len(x) for x in ids], crcs]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in arrays], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every row, from the files; every key is looked up by its hash."""
    # With a number, the exchange keeps its partitions: shards are read side by side, not in one task.
    spread = manifest.repartition(max(1, manifest.count()), F.col("shard"))
    return spread.mapInArrow(_read_shards, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _lookup(left: pa.Table, right: pa.Table) -> pa.Table:
    out = []
    for row in right.to_pylist():
        shard = Shard(row["payload"], row["index"])
        for key in left["doc_id"].to_pylist():
            out += [{"doc_id": key, "ids": ids.astype(np.int32)} for ids in shard.get(key)]
    return pa.Table.from_pylist(out, schema=pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]))


def lookup(keys: DataFrame, manifest: DataFrame) -> DataFrame:
    """``doc_id, ids`` of the wanted ``keys(doc_id)``, each by one probe of the shard that may hold it.

    The ids' range is cut into as many steps of one width as there are shards;
    keys and shards meet by step, and a shard lies in the steps that it covers.
    """
    shards = manifest.where("least is not null").select("shard", "payload", "index", "least", "greatest")
    least, greatest, n = shards.agg(F.min("least"), F.max("greatest"), F.count("*")).first()
    width = 1 if least is None else (greatest - least) // n + 1
    step = lambda c: F.floor((F.col(c).cast("decimal(20,0)") - F.lit(least or 0)) / F.lit(width)).cast("long")
    covered = shards.select("shard", "least", "greatest", F.explode(F.sequence(step("least"), step("greatest"))).alias("step"))
    routed = keys.where("doc_id is not null").distinct().withColumn("step", step("doc_id")).join(covered, "step")
    routed = routed.where(F.col("doc_id").between(F.col("least"), F.col("greatest"))).select("doc_id", F.col("shard").alias("to"))
    return routed.groupBy("to").cogroup(shards.groupBy("shard")).applyInArrow(_lookup, "doc_id long, ids array<int>")
