"""Legacy workbooks, made by hand after the format's rules, against the same cells in the newer format."""

import random
import struct

import pytest

from tendermill.sources import archives, xls
from test_sources import workbook, zipped

SECTOR, SMALL = 512, 64


def compound(streams):
    """A compound file; streams under 4096 bytes lie in small sectors."""
    pad = lambda x, n: x + bytes(-len(x) % n)
    small, small_fat, places = b"", [], {}
    sectors, fat = [], []

    def chain(data):
        data = pad(data, SECTOR)
        first = len(sectors)
        for i in range(0, len(data), SECTOR):
            sectors.append(data[i : i + SECTOR])
            fat.append(len(sectors))
        if len(sectors) == first:
            return xls.END
        fat[-1] = xls.END
        return first

    for name, data in streams.items():
        if len(data) >= 4096:
            places[name] = chain(data)
        else:
            places[name] = len(small_fat)
            n = -(-len(data) // SMALL)
            small_fat += [len(small_fat) + i + 1 for i in range(n - 1)] + [xls.END]
            small += pad(data, SMALL)
    root = chain(small)
    small_at = chain(b"".join(struct.pack("<I", x) for x in small_fat).ljust(-(-4 * len(small_fat) // SECTOR) * SECTOR, b"\xff")) if small_fat else xls.END

    def entry(name, kind, first, size):
        raw = name.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw), kind, 1) + struct.pack("<III", xls.FREE, xls.FREE, xls.FREE) + bytes(36) + struct.pack("<IQ", first, size)

    entries = entry("Root Entry", 5, root, len(small)) + b"".join(entry(n, 2, places[n], len(d)) for n, d in streams.items())
    directory = chain(entries)
    n_fat = 1
    while (len(sectors) + n_fat) * 4 > n_fat * SECTOR:
        n_fat += 1
    at = list(range(len(sectors), len(sectors) + n_fat))
    table = b"".join(struct.pack("<I", x) for x in [*fat, *([0xFFFFFFFD] * n_fat)]).ljust(n_fat * SECTOR, b"\xff")
    head = xls.MAGIC + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIIIIIII", 0, n_fat, directory, 0, 4096, small_at, 1 if small_fat else 0, xls.END, 0)
    assert n_fat <= 109
    head += b"".join(struct.pack("<I", x) for x in at).ljust(436, b"\xff")
    return head + b"".join(sectors) + table


def record(kind, body=b""):
    return struct.pack("<HH", kind, len(body)) + body


def text(value, length="<H", wide=None):
    wide = not value.isascii() if wide is None else wide
    return struct.pack(length, len(value)) + bytes([wide]) + value.encode("utf-16-le" if wide else "latin-1")


def shared(values, limit):
    """Shared strings cut every ``limit`` bytes; the rest of a cut text may change its width."""
    parts, now = [], struct.pack("<II", len(values), len(values))
    for n, value in enumerate(values):
        rich, reading = n % 3 == 1, n % 4 == 2
        wide = any(ord(c) > 255 for c in value)
        head = struct.pack("<HB", len(value), wide | rich << 3 | reading << 2) + (struct.pack("<H", 2) if rich else b"") + (struct.pack("<I", 5) if reading else b"")
        if len(now) + len(head) > limit:
            parts, now = [*parts, now], b""
        now += head
        for c in value:
            size = 2 if wide else 1
            if len(now) + size > limit:
                wide = wide or n % 2 == 0
                parts, now = [*parts, now], bytes([wide])
            now += c.encode("utf-16-le" if wide else "latin-1")
        tail = (b"runs" * 2 if rich else b"") + (b"ruby!" if reading else b"")
        while tail:
            room = limit - len(now)
            now, tail = now + tail[:room], tail[room:]
            if tail:
                parts, now = [*parts, now], b""
    parts.append(now)
    return record(xls.SST, parts[0]) + b"".join(record(xls.CONTINUE, p) for p in parts[1:])


def rk(value):
    if value == int(value) and abs(value) < 1 << 29:
        return (int(value) << 2 | 2) & 0xFFFFFFFF
    if round(value * 100) == value * 100 and abs(value * 100) < 1 << 29:
        return (round(value * 100) << 2 | 3) & 0xFFFFFFFF
    return struct.unpack("<Q", struct.pack("<d", value))[0] >> 32 & 0xFFFFFFFC


def book(sheets, limit=8224, extra=b"", version=0x0600):
    """``sheets``: name to rows of values; numbers, texts, ("=", result) for formulas, booleans and ("#", code) for errors."""
    strings = list(dict.fromkeys(v for rows in sheets.values() for r in rows for v in r if isinstance(v, str) and v))
    bodies = []
    for rows in sheets.values():
        out = record(xls.BOF, struct.pack("<HHHHII", 0x0600, 0x10, 0, 0, 0, 0))
        for i, row in enumerate(rows):
            k = 0
            while k < len(row):
                v, at = row[k], struct.pack("<HHH", i, k, 15)
                if isinstance(v, bool):
                    out += record(xls.BOOLERR, at + bytes([v, 0]))
                elif isinstance(v, str) and v:
                    out += record(xls.LABELSST, at + struct.pack("<I", strings.index(v))) if (i + k) % 5 else record(xls.LABEL, at + text(v))
                elif isinstance(v, tuple) and v[0] == "#":
                    out += record(xls.BOOLERR, at + bytes([v[1], 1]))
                elif isinstance(v, tuple) and isinstance(v[1], str):
                    out += record(xls.FORMULA, at + b"\0\0\0\0\0\0\xff\xff" + bytes(8)) + record(xls.STRING, text(v[1]))
                elif isinstance(v, tuple):
                    out += record(xls.FORMULA, at + struct.pack("<d", v[1]) + bytes(8))
                elif isinstance(v, (int, float)):
                    run = [v]
                    while k + len(run) < len(row) and type(row[k + len(run)]) is int and type(v) is int:
                        run.append(row[k + len(run)])
                    if len(run) > 1:
                        out += record(xls.MULRK, struct.pack("<HH", i, k) + b"".join(struct.pack("<HI", 15, rk(x)) for x in run) + struct.pack("<H", k + len(run) - 1))
                        k += len(run) - 1
                    elif struct.unpack("<d", struct.pack("<Q", rk(v) << 32))[0] == v or rk(v) & 3:
                        out += record(xls.RK, at + struct.pack("<I", rk(v)))
                    else:
                        out += record(xls.NUMBER, at + struct.pack("<d", v))
                k += 1
        chart = record(xls.BOF, struct.pack("<HHHHII", 0x0600, 0x20, 0, 0, 0, 0)) + record(xls.NUMBER, struct.pack("<HHHd", 0, 0, 15, 99.0)) + record(xls.EOF)
        bodies.append(out + chart + record(xls.EOF))
    names = [text(n, "<B") for n in sheets]
    head = record(xls.BOF, struct.pack("<HHHHII", version, 5, 0, 0, 0, 0)) + extra
    tail = shared(strings, limit) + record(xls.EOF)
    at = len(head) + sum(len(n) + 10 for n in names) + len(tail)
    for name, body in zip(names, bodies):
        head += record(xls.BOUNDSHEET, struct.pack("<IBB", at, 0, 0) + name)
        at += len(body)
    return head + tail + b"".join(bodies)


SHEETS = {
    "Lot 1": [["N°", "Désignation", "Montant HT", "漢字"], ["1.1", "Terrassement " * 40, 12.5, 3, 4, -7], [True, ("#", 7), ("=", 2.25), ("=", "résultat"), False], ["é" * 300, 1e-7, 123456789.125, 0.01]],
    "Été": [["", "x"], [], [None, None, -0.75, 1 << 40]],
}


def plain(sheets):
    out = []
    for name, rows in sheets.items():
        for i, row in enumerate(rows):
            for k, v in enumerate(row):
                if isinstance(v, tuple) and v[0] == "#":
                    out.append((name, i, k, xls.ERRORS[v[1]], False))
                    continue
                v = v[1] if isinstance(v, tuple) else v
                if v is not None and v != "":
                    out.append((name, i, k, v if isinstance(v, str) else xls.spelt(float(v)), isinstance(v, str)))
    return out


@pytest.mark.parametrize("limit", [8224, 200, 61, 23])
@pytest.mark.parametrize("filler", [0, 9000])
def test_cells_of_a_workbook(limit, filler):
    raw = compound({"Workbook": book(SHEETS, limit), "Other": b"o" * filler, "Small": b"s" * 70})
    assert list(xls.cells(raw)) == plain(SHEETS)
    assert list(archives.cells_of("a.XLS", raw)) == plain(SHEETS) == list(archives.cells_of("misnamed.xlsx", raw))


def test_short_streams_lie_in_small_sectors():
    sheets = {"S": [["a", 1, 2.5]]}
    raw = compound({"Workbook": book(sheets)})
    assert len(book(sheets)) < 4096 and list(xls.cells(raw)) == plain(sheets)


def test_the_same_cells_as_in_the_newer_format(spark, tmp_path):
    rows = [["N°", "Prix"], ["1", "Béton"], ["2", "Acier"]]
    (tmp_path / "a.xls").write_bytes(compound({"Workbook": book({"Lot 1": rows})}))
    (tmp_path / "b.xlsx").write_bytes(workbook(rows))
    (tmp_path / "c.xls").write_bytes(workbook(rows))
    found = {}
    for r in archives.read_workbooks(spark, str(tmp_path)).collect():
        found.setdefault(r.book[-5:], []).append(tuple(r)[1:])
    assert len(found) == 3 and found["a.xls"[-5:]] == found[".xlsx"] == found["c.xls"[-5:]]
    assert archives.text_of("a.xls", (tmp_path / "a.xls").read_bytes()) == ("N°\tPrix\n1\tBéton\n2\tAcier", None)
    archive = tmp_path / "z"
    archive.mkdir()
    (archive / "z.zip").write_bytes(zipped({"bpu.xls": (tmp_path / "a.xls").read_bytes()}))
    assert archives.read_archives(spark, str(archive)).first().text == "N°\tPrix\n1\tBéton\n2\tAcier"


def test_locked_and_older_workbooks(spark, tmp_path):
    locked = compound({"Workbook": book(SHEETS, extra=record(xls.FILEPASS, bytes(54)))})
    (tmp_path / "locked.xls").write_bytes(locked)
    (tmp_path / "open.xls").write_bytes(compound({"Workbook": book(SHEETS)}))
    (tmp_path / "office.xls").write_bytes(compound({"EncryptedPackage": bytes(5000), "EncryptionInfo": bytes(200)}))
    (tmp_path / "locked.xlsx").write_bytes(compound({"EncryptedPackage": bytes(5000)}))
    (tmp_path / "broken.xls").write_bytes(xls.MAGIC + b"rest")
    (tmp_path / "empty.xls").write_bytes(b"")
    rows = archives.locked_workbooks(spark, str(tmp_path)).collect()
    assert sorted(r.book.rsplit("/", 1)[1] for r in rows) == ["locked.xls", "locked.xlsx", "office.xls"]
    assert list(xls.cells(locked)) == [] == list(xls.cells(compound({"Workbook": book(SHEETS, version=0x0500)}))) == list(xls.cells(compound({"Book": b"x" * 10})))


def test_damaged_files_end_and_give_none_or_less():
    raw = compound({"Workbook": book(SHEETS, 200)})
    whole, rng = set(plain(SHEETS)), random.Random(8)
    assert all(not list(archives.cells_of("a.xls", raw[:n])) or set(archives.cells_of("a.xls", raw[:n])) <= whole for n in range(0, len(raw), 97))
    for _ in range(400):
        broken = bytearray(raw)
        for _ in range(rng.randrange(1, 6)):
            broken[rng.randrange(len(broken))] = rng.randrange(256)
        list(archives.cells_of("a.xls", bytes(broken)))
