"""ZIP archives of any size as a source whose partitions are ranges of members.

The directory at an archive's end is read by itself, wherever the archive lies,
and names each member's place and packed size.  Archives up to a partition's size
are packed together, one task reading their directories; of a larger one the
planner reads the directory and cuts its members into runs of about that size, so
that an archive of many gigabytes is read by many tasks.  A task reads its
members' bytes only and unpacks them as they come.  A nested archive goes to a
temporary file of the task first, so that its size is bounded by the disk, not by
memory.

``spark.read.format("archives").load(path)`` or :func:`read` give a row a file, in
the order of the archive: ``archive, depth, name, size, text, page_count,
warning``.  Options: ``partitionBytes``, ``maxMemberBytes`` (longer members are
told, not read) and ``maxBytes`` (longer archives are told; none unless given).

Defined results: damaged archives and members, members under a password and
methods other than stored and deflated give a row with a warning; folders, hidden
and empty files and suffixes that are not taken in give none; an empty folder
gives no rows.
"""

from __future__ import annotations

import io
import struct
import tempfile
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tendermill.sources.archives import ALLOWED, DEPTH, WARNED, decoded_name, is_hidden, text_of

SCHEMA = "archive string, depth int, name string, size long, text string, page_count int, warning string"
ARROW = pa.schema(
    [("archive", pa.string()), ("depth", pa.int32()), ("name", pa.string()), ("size", pa.int64()), ("text", pa.string()), ("page_count", pa.int32()), ("warning", pa.string())]
)
PARTITION_BYTES = 128 << 20
MEMBER_BYTES = 256 << 20
#: Bytes read, and bytes of text handed to Spark, at a time.
STEP = 1 << 20
OUT_BYTES = 16 << 20
DAMAGED = (zipfile.BadZipFile, zlib.error, struct.error, EOFError, ValueError, OSError)


@dataclass(frozen=True)
class Member:
    """A member as the directory tells it."""

    name: str
    flags: int
    method: int
    at: int
    packed: int
    size: int
    crc: int


@dataclass
class Files(InputPartition):
    """Whole archives, or with ``members`` a run of members of one."""

    paths: list[tuple[str, int]]
    members: list[Member] | None = None


def directory(f) -> list[Member]:
    """Members of an open archive; reads its end and its directory only."""
    with zipfile.ZipFile(f) as z:
        return [Member(i.filename, i.flag_bits, i.compress_type, i.header_offset, i.compress_size, i.file_size, i.CRC) for i in z.infolist() if not i.is_dir()]


def unpacked(f, m: Member) -> Iterator[bytes]:
    """Pieces of a member's content as they are unpacked."""
    f.seek(m.at)
    head = f.read(30)
    if head[:4] != b"PK\x03\x04":
        raise zipfile.BadZipFile("no member where the directory says")
    f.seek(m.at + 30 + sum(struct.unpack("<HH", head[26:30])))
    left, crc, done = m.packed, 0, 0
    inflate = zlib.decompressobj(-15) if m.method == 8 else None
    while left:
        piece = f.read(min(STEP, left))
        if not piece:
            raise EOFError("the archive ends within a member")
        left -= len(piece)
        while piece:
            out = inflate.decompress(piece, STEP) if inflate else piece
            piece = inflate.unconsumed_tail if inflate else b""
            crc, done = zlib.crc32(out, crc), done + len(out)
            if done > m.size:
                raise zipfile.BadZipFile("a member is longer than told")
            if out:
                yield out
    if done != m.size or crc != m.crc:
        raise zipfile.BadZipFile("a member does not match its checksum")


def files_of(f, members: list[Member], most: int, depth: int = 0) -> Iterator[tuple[int, str, int, bytes, str]]:
    """``depth, name, size, content, warning`` of each file among ``members`` and in archives nested there."""
    for m in members:
        if is_hidden(m.name) or not m.size:
            continue
        name = decoded_name(m.name, bool(m.flags & 0x800))
        suffix = name[name.rfind(".") :].lower() if "." in name else ""
        nested = suffix == ".zip" and depth < DEPTH
        if suffix in WARNED:
            yield depth, name, 0, b"", f"format {suffix} is not read"
        elif suffix not in ALLOWED or (suffix == ".zip" and not nested):
            continue
        elif m.flags & 1 or m.method not in (0, 8):
            yield depth, name, m.size, b"", "member is under a password" if m.flags & 1 else f"method {m.method} is not read"
        elif m.size > most and not nested:
            yield depth, name, m.size, b"", "member is over the size limit"
        elif nested:
            with tempfile.TemporaryFile() as inner:
                try:
                    for piece in unpacked(f, m):
                        inner.write(piece)
                    inside = directory(inner)
                except DAMAGED:
                    yield depth + 1, "", 0, b"", "nested archive is damaged"
                    continue
                yield from files_of(inner, inside, most, depth + 1)
        else:
            try:
                yield depth, name, m.size, b"".join(unpacked(f, m)), ""
            except DAMAGED:
                yield depth, name, m.size, b"", "member is damaged"


def _filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.partition_bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self.member_bytes = int(options.get("maxmemberbytes", MEMBER_BYTES))
        self.most = int(options["maxbytes"]) if "maxbytes" in options else None

    def _listed(self) -> list[tuple[str, int]]:
        fs, base = _filesystem(self.path)
        info = fs.get_file_info(base)
        infos = [info] if info.is_file else fs.get_file_info(pa.fs.FileSelector(base, recursive=True))
        return sorted((i.path, i.size) for i in infos if i.is_file and i.path.lower().endswith(".zip"))

    def partitions(self) -> list[Files]:
        fs, _ = _filesystem(self.path)
        out: list[Files] = []
        held: list[tuple[str, int]] = []
        for path, size in self._listed():
            members = None
            if size > self.partition_bytes and not (self.most and size > self.most):
                try:
                    with fs.open_input_file(path) as f:
                        members = directory(f)
                except DAMAGED:
                    pass  # one task will tell
            if not members:
                if held and sum(s for _, s in held) + size > self.partition_bytes:
                    out, held = [*out, Files(held)], []
                held.append((path, size))
                continue
            out, held = [*out, *([Files(held)] if held else [])], []
            run: list[Member] = []
            for m in members:
                if run and sum(x.packed for x in run) + m.packed > self.partition_bytes:
                    out, run = [*out, Files([(path, size)], run)], []
                run.append(m)
            out.append(Files([(path, size)], run))
        return [*out, Files(held)] if held or not out else out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _filesystem(self.path)
        rows: list[tuple] = []
        size = 0
        for row in self._rows(fs, partition):
            rows.append(row)
            size += len(row[4])
            if size >= OUT_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), ARROW.types)], schema=ARROW)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), ARROW.types)], schema=ARROW)

    def _rows(self, fs: pa.fs.FileSystem, partition: Files) -> Iterator[tuple]:
        for path, size in partition.paths:
            if self.most and size > self.most:
                yield path, 0, "", size, "", None, "archive is over the size limit"
                continue
            with fs.open_input_file(path) as f:
                try:
                    members = directory(f) if partition.members is None else partition.members
                except DAMAGED:
                    yield path, 0, "", 0, "", None, "archive is damaged"
                    continue
                for depth, name, n, content, warning in files_of(f, members, self.member_bytes):
                    text, pages = ("", None) if warning else text_of(name, content)
                    yield path, depth, name, n, text, pages, warning


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def read(spark: SparkSession, path: str, most_bytes: int | None = None, partition_bytes: int = PARTITION_BYTES, member_bytes: int = MEMBER_BYTES) -> DataFrame:
    """The files of the archives under ``path``, a folder or one archive."""
    spark.dataSource.register(ArchiveSource)
    reader = spark.read.format("archives").option("partitionBytes", partition_bytes).option("maxMemberBytes", member_bytes)
    return (reader.option("maxBytes", most_bytes) if most_bytes else reader).load(path)
