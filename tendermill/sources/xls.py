"""Cells of legacy workbooks (compound files with BIFF8 records).

A compound file is a small file system: sectors in chains, a table of chains, a
directory, and a second level of small sectors for short streams.  The workbook
stream is a list of records; sheets begin where the global part says, strings are
shared and may run on over several records, each with its own width of
characters.

Sectors are read as they are needed from an open file, so that telling whether a
workbook is locked reads a few kilobytes of it.  Damaged files raise
:class:`Damaged`; files of an older format and those under a password have no
cells.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
END, FREE = 0xFFFFFFFE, 0xFFFFFFFF
#: Texts of error codes.
ERRORS = {0: "#NULL!", 7: "#DIV/0!", 15: "#VALUE!", 23: "#REF!", 29: "#NAME?", 36: "#NUM!", 42: "#N/A"}
#: Numbers of records.
BOF, EOF, BOUNDSHEET, CONTINUE, SST, FILEPASS = 0x0809, 0x000A, 0x0085, 0x003C, 0x00FC, 0x002F
FORMULA, STRING, LABEL, RSTRING, LABELSST, NUMBER, RK, MULRK, BOOLERR = 0x0006, 0x0207, 0x0204, 0x00D6, 0x00FD, 0x0203, 0x027E, 0x00BD, 0x0205


class Damaged(ValueError):
    """The file breaks the format's rules."""


class Compound:
    """Streams of a compound file."""

    def __init__(self, f):
        self.f = f
        head = self._at(0, 512)
        if head[:8] != MAGIC:
            raise Damaged("no compound file")
        shift, small_shift = struct.unpack_from("<HH", head, 30)
        if shift not in (9, 12) or not 4 <= small_shift < shift:
            raise Damaged("odd sector sizes")
        self.size, self.small = 1 << shift, 1 << small_shift
        n_fat, start, self.cutoff, small_fat, _, more, n_more = struct.unpack_from("<I I 4x I I I I I", head, 44)
        fat = list(struct.unpack_from("<109I", head, 76))
        for _ in range(n_more):
            block = struct.unpack(f"<{self.size // 4}I", self._sector(more))
            fat, more = [*fat, *block[:-1]], block[-1]
        self.next: list[int] = []
        for sector in [x for x in fat if x < END - 1][:n_fat]:
            self.next += struct.unpack(f"<{self.size // 4}I", self._sector(sector))
        self.small_next = []
        for sector in self._chain(small_fat, self.next):
            self.small_next += struct.unpack(f"<{self.size // 4}I", self._sector(sector))
        entries = b"".join(map(self._sector, self._chain(start, self.next)))
        self.streams: dict[str, tuple[int, int]] = {}
        self.root = (END, 0)
        for at in range(0, len(entries) - 127, 128):
            length, kind = struct.unpack_from("<HB", entries, at + 64)
            first, size = struct.unpack_from("<IQ", entries, at + 116)
            size = size & 0xFFFFFFFF if shift == 9 else size
            name = entries[at : at + max(0, min(length, 64) - 2)].decode("utf-16-le", "replace")
            if kind == 5:
                self.root = (first, size)
            elif kind == 2:
                self.streams.setdefault(name, (first, size))

    def _at(self, place: int, n: int) -> bytes:
        self.f.seek(place)
        found = self.f.read(n)
        if len(found) < n and (place < 512 or not found):
            raise Damaged("the file ends early")
        return found.ljust(n, b"\0")

    def _sector(self, n: int) -> bytes:
        return self._at((n + 1) * self.size, self.size)

    @staticmethod
    def _chain(start: int, following: list[int]) -> Iterator[int]:
        steps = 0
        while start < END - 1:
            if start >= len(following) or steps > len(following):
                raise Damaged("a chain leaves the file or turns back")
            yield start
            start, steps = following[start], steps + 1

    def stream(self, name: str, most: int | None = None) -> bytes:
        """The first ``most`` bytes of a stream, or all of it."""
        first, size = self.streams[name]
        wanted, out, held = size if most is None else min(size, most), [], 0
        if size >= self.cutoff:
            for sector in self._chain(first, self.next):
                if held >= wanted:
                    break
                out.append(self._sector(sector))
                held += self.size
        else:
            base = list(self._chain(self.root[0], self.next))
            for sector in self._chain(first, self.small_next):
                if held >= wanted:
                    break
                place = sector * self.small
                if place // self.size >= len(base):
                    raise Damaged("a small sector leaves its stream")
                out.append(self._at((base[place // self.size] + 1) * self.size + place % self.size, self.small))
                held += self.small
        if held < wanted:
            raise Damaged("a stream ends early")
        return b"".join(out)[:wanted]


def records(data: bytes, at: int = 0) -> Iterator[tuple[int, list[bytes]]]:
    """Number and parts of each record from ``at`` on; what continues a record is another part of it."""
    kind, parts = None, []
    while at + 4 <= len(data):
        number, size = struct.unpack_from("<HH", data, at)
        body = data[at + 4 : at + 4 + size]
        if len(body) < size:
            raise Damaged("a record ends early")
        at += 4 + size
        if number == CONTINUE and kind is not None:
            parts.append(body)
            continue
        if kind is not None:
            yield kind, parts
        kind, parts = number, [body]
    if kind is not None:
        yield kind, parts


class Parts:
    """Reads over the parts of a record; characters that go on in the next part have their width told anew."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.part, self.at = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while n:
            if self.part >= len(self.parts):
                raise Damaged("a record ends early")
            piece = self.parts[self.part][self.at : self.at + n]
            out, n, self.at = out + piece, n - len(piece), self.at + len(piece)
            if n:
                self.part, self.at = self.part + 1, 0
        return out

    def characters(self, n: int, wide: bool) -> str:
        out = []
        while n:
            if self.part >= len(self.parts):
                raise Damaged("a text ends early")
            width = 2 if wide else 1
            piece = self.parts[self.part][self.at : self.at + n * width]
            piece = piece[: len(piece) // width * width]
            out.append(piece.decode("utf-16-le" if wide else "latin-1", "replace"))
            n -= len(piece) // width
            self.at += len(piece)
            if n:
                self.part, self.at = self.part + 1, 0
                wide = bool(self.take(1)[0] & 1)
        return "".join(out)

    def text(self, length: int = 2) -> str:
        """A text with its length before it, without its fonts and its reading."""
        n = int.from_bytes(self.take(length), "little")
        flags = self.take(1)[0]
        runs = int.from_bytes(self.take(2), "little") if flags & 8 else 0
        reading = int.from_bytes(self.take(4), "little") if flags & 4 else 0
        found = self.characters(n, bool(flags & 1))
        self.take(4 * runs + reading)
        return found


def rk_number(rk: int) -> float:
    """Number of 32 bits: an integer or the upper half of a double, and perhaps a hundredth of it."""
    value = float((rk >> 2) - (1 << 30 if rk & 0x80000000 else 0)) if rk & 2 else struct.unpack("<d", struct.pack("<Q", (rk & 0xFFFFFFFC) << 32))[0]
    return value / 100 if rk & 1 else value


def spelt(value: float) -> str:
    return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)


def _workbook(f) -> tuple[Compound, str | None]:
    book = Compound(f)
    return book, next((name for name in book.streams if name.lower() == "workbook"), None)


def is_locked(f) -> bool:
    """Whether an open workbook is under a password; reads its first records only."""
    try:
        book, name = _workbook(f)
        if "EncryptedPackage" in book.streams:
            return True
        return name is not None and any(kind == FILEPASS for kind, _ in _first(book.stream(name, 4096)))
    except (Damaged, struct.error):
        return False


def _first(data: bytes) -> Iterator[tuple[int, list[bytes]]]:
    try:
        yield from records(data)
    except Damaged:  # the part of the stream that was read ends within a record
        return


def cells(content: bytes) -> Iterator[tuple[str, int, int, str, bool]]:
    """``sheet, row, column, value, is_text`` of the filled cells."""
    book, name = _workbook(io.BytesIO(content))
    if name is None:
        return
    data = book.stream(name)
    sheets, shared = [], []
    for number, (kind, parts) in enumerate(records(data)):
        if number == 0 and (kind != BOF or struct.unpack_from("<H", parts[0])[0] != 0x0600):
            return
        if kind == FILEPASS:
            return
        if kind == BOUNDSHEET:
            reader = Parts(parts)
            at, _, sheet_kind = struct.unpack("<IBB", reader.take(6))
            if sheet_kind == 0:
                sheets.append((at, reader.text(1)))
        elif kind == SST:
            reader = Parts(parts)
            _, n = struct.unpack("<II", reader.take(8))
            shared = [reader.text() for _ in range(n)]
        elif kind == EOF:
            break
    for at, sheet in sheets:
        yield from _sheet(data, at, sheet, shared)


def _sheet(data: bytes, at: int, sheet: str, shared: list[str]) -> Iterator[tuple[str, int, int, str, bool]]:
    waiting, depth = None, 0
    for kind, parts in records(data, at):
        body = parts[0]
        if kind in (BOF, EOF):  # charts within a sheet have records of their own
            depth += 1 if kind == BOF else -1
            if not depth:
                return
            continue
        if depth != 1:
            continue
        if kind == STRING and waiting:
            text = Parts(parts).text()
            if text:
                yield sheet, *waiting, text, True
            waiting = None
            continue
        if kind == MULRK:
            row, col = struct.unpack_from("<HH", body)
            for i in range((len(body) - 6) // 6):
                yield sheet, row, col + i, spelt(rk_number(struct.unpack_from("<I", body, 6 + 6 * i)[0])), False
            continue
        if kind not in (LABELSST, LABEL, RSTRING, NUMBER, RK, BOOLERR, FORMULA):
            continue
        row, col, _ = struct.unpack_from("<HHH", body)
        if kind == LABELSST:
            place = struct.unpack_from("<I", body, 6)[0]
            if place >= len(shared):
                raise Damaged("no such shared text")
            value, is_text = shared[place], True
        elif kind in (LABEL, RSTRING):
            reader = Parts(parts)
            reader.take(6)
            n, flags = struct.unpack("<HB", reader.take(3))
            value, is_text = reader.characters(n, bool(flags & 1)), True
        elif kind == NUMBER:
            value, is_text = spelt(struct.unpack_from("<d", body, 6)[0]), False
        elif kind == RK:
            value, is_text = spelt(rk_number(struct.unpack_from("<I", body, 6)[0])), False
        elif kind == BOOLERR:
            code, is_error = body[6], body[7]
            value, is_text = ERRORS.get(code, "#N/A") if is_error else str(int(bool(code))), False
        else:
            result, is_text = body[6:14], False
            if result[6:] != b"\xff\xff":
                value = spelt(struct.unpack("<d", result)[0])
            elif result[0] == 0:
                waiting = (row, col)
                continue
            else:
                value = {1: str(int(bool(result[2]))), 2: ERRORS.get(result[2], "#N/A")}.get(result[0], "")
        if value:
            yield sheet, row, col, value, is_text
