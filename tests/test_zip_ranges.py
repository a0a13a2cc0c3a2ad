"""Archives read by ranges of members: large, nested, damaged and awkward ones."""

import os
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from tendermill.sources import archives, zip_ranges
from test_sources import document, zipped


def rows_of(spark, path, **options):
    return [(os.path.basename(r.archive), r.depth, r.name, r.size, r.text, r.warning) for r in zip_ranges.read(spark, str(path), **options).collect()]


def test_members_come_in_the_order_of_the_archive_from_many_tasks(spark, tmp_path):
    files = {f"d{i % 3}/n{i:03d}.txt": f"text {i} " * (i * 40 + 1) for i in range(60)}
    (tmp_path / "a.zip").write_bytes(zipped(files))
    (tmp_path / "b.zip").write_bytes(zipped({"x.docx": document(["un"]), "y.zip": zipped({"z.txt": "zz", "again.zip": zipped({"deep.txt": "d"})})}))
    df = zip_ranges.read(spark, str(tmp_path), partition_bytes=20_000)
    assert df.rdd.getNumPartitions() > 3
    got = rows_of(spark, tmp_path, partition_bytes=20_000)
    want = [("a.zip", 0, k.split("/")[1], len(v), v, "") for k, v in files.items()]
    want += [("b.zip", 0, "x.docx", got[60][3], "un", ""), ("b.zip", 1, "z.txt", 2, "zz", ""), ("b.zip", 2, "deep.txt", 1, "d", "")]
    assert got == want == rows_of(spark, tmp_path) == rows_of(spark, tmp_path, partition_bytes=1)
    assert sorted((r.name, r.text) for r in archives.read_archives(spark, str(tmp_path)).collect()) == sorted((w[2], w[4]) for w in want)


def test_the_source_is_there_by_name_and_for_one_file(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(zipped({"t.txt": "x"}))
    spark.dataSource.register(zip_ranges.ArchiveSource)
    assert spark.read.format("archives").load(str(tmp_path / "a.zip")).select("name", "text").collect() == [("t.txt", "x")]
    (tmp_path / "none").mkdir()
    assert rows_of(spark, tmp_path / "none") == []


def test_damage_passwords_and_methods_are_told(spark, tmp_path):
    whole = bytearray(zipped({"good.txt": "good", "bad.txt": "some other text", "last.txt": "last"}))
    at = whole.index(b"some other text")
    whole[at : at + 4] = b"SOME"
    (tmp_path / "a.zip").write_bytes(whole)
    locked = bytearray(zipped({"locked.txt": "secret"}))
    for mark in (b"PK\x03\x04", b"PK\x01\x02"):
        flags = locked.index(mark) + (6 if mark[2] == 3 else 8)
        locked[flags : flags + 2] = struct.pack("<H", struct.unpack("<H", locked[flags : flags + 2])[0] | 1)
    (tmp_path / "b.zip").write_bytes(locked)
    with zipfile.ZipFile(tmp_path / "c.zip", "w", zipfile.ZIP_LZMA) as z:
        z.writestr("odd.txt", "packed otherwise")
    (tmp_path / "d.zip").write_bytes(b"PK no archive")
    (tmp_path / "e.zip").write_bytes(zipped({"in.zip": "no archive", "ok.txt": "ok", "long.txt": "l" * 500}))
    whole = zipped({f"{i}.txt": os.urandom(300).hex() for i in range(9)})
    (tmp_path / "f.zip").write_bytes(whole[:200] + whole[900:])
    told = {(a, n): w for a, _, n, _, _, w in rows_of(spark, tmp_path, member_bytes=400)}
    assert told["a.zip", "good.txt"] == told["a.zip", "last.txt"] == told["e.zip", "ok.txt"] == ""
    assert told["a.zip", "bad.txt"] == "member is damaged" and told["b.zip", "locked.txt"] == "member is under a password"
    assert told["c.zip", "odd.txt"] == "method 14 is not read" and told["d.zip", ""] == "archive is damaged"
    assert told["e.zip", ""] == "nested archive is damaged" and told["e.zip", "long.txt"] == "member is over the size limit"
    assert told.get(("f.zip", ""), told.get(("f.zip", "0.txt"))) in ("archive is damaged", "member is damaged", "member is over the size limit")
    assert rows_of(spark, tmp_path / "a.zip", most_bytes=20) == [("a.zip", 0, "", len(zipped({"good.txt": "good", "bad.txt": "some other text", "last.txt": "last"})), "", "archive is over the size limit")]


@pytest.mark.parametrize("compression", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
def test_an_archive_of_three_gigabytes_with_long_offsets(spark, tmp_path, compression):
    """Members at both ends of an archive over 4 GB (stored, sparse) or over 3 GB unpacked; memory stays small."""
    path = tmp_path / "large.zip"
    n = 36
    with zipfile.ZipFile(path, "w", compression, compresslevel=1) as z:
        z.writestr("first.txt", "the first")
        for i in range(n):
            with z.open(zipfile.ZipInfo(f"skip{i}.bin") if compression == zipfile.ZIP_STORED else f"skip{i}.bin", "w", force_zip64=True) as f:
                if compression == zipfile.ZIP_STORED:
                    f.write(b"x")
                    continue
                for _ in range(3):
                    f.write(bytes(32 << 20))
        z.writestr("last.txt", "the last")
    if compression == zipfile.ZIP_STORED:  # a hole of 5 GB before the members: offsets need 64 bits
        raw = path.read_bytes()
        with open(path, "wb") as f:
            f.seek(5 << 30)
            f.write(raw)
        with zipfile.ZipFile(path) as z:
            assert z.infolist()[-1].header_offset > 1 << 32
    df = zip_ranges.read(spark, str(path), partition_bytes=1 << 20)
    assert df.select("name", "text", "warning").collect() == [("first.txt", "the first", ""), ("last.txt", "the last", "")]
    if compression == zipfile.ZIP_DEFLATED:
        assert df.rdd.getNumPartitions() >= 2


def test_a_long_member_is_unpacked_piece_by_piece(tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z, z.open("long.txt", "w") as f:
        for _ in range(64):
            f.write(bytes(1 << 20))
    with open(path, "rb") as f:
        (member,) = zip_ranges.directory(f)
        sizes = [len(x) for x in zip_ranges.unpacked(f, member)]
    assert sum(sizes) == 64 << 20 and max(sizes) <= zip_ranges.STEP


def test_sizes_are_summed_in_spark(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(zipped({f"{i}.txt": "ab" for i in range(50)}))
    assert zip_ranges.read(spark, str(tmp_path), partition_bytes=64).agg(F.sum("size")).first()[0] == 100
