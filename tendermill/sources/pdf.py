"""Text of PDF files page by page, for tasks that read files.

Objects are found by reading the file from start to end, so that damaged and
repeatedly saved files need no table of places; the last version of an object
counts.  Streams pass their filters in order (Flate, LZW, ASCII85, ASCIIHex, run
lengths, with the predictors of PNG and TIFF), after decryption where the empty
password opens the file.  Texts come from the fonts' tables to Unicode, from the
predefined encodings that name a code page, and from the fonts' own differences.

Scanned pages, files under a password and fonts without any of these give no text.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Callable

from tendermill.sources.pdf_crypt import Decryption

_OBJECT = re.compile(rb"(?<!\d)(\d{1,10})\s+(\d{1,5})\s+obj\b")
_WORD = re.compile(rb"\s*(?:%[^\r\n]*[\r\n]\s*)*(<<|>>|\[|\]|/[^\s/<>\[\]()%]*|\(|<[0-9A-Fa-f\s]*>|(\d+)\s+(\d+)\s+R(?![A-Za-z])|[-+.\d]+|[A-Za-z]+)")
_TOKEN = re.compile(rb"/(\S+)\s+[-\d.]+\s+Tf|(\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\))|<([0-9A-Fa-f\s]*)>|(-?\d+(?:\.\d+)?)(?=[\s\](<])|(\[|\])|\b(T[dDm*]|ET)(?![A-Za-z])|(['\"])(?=\s)", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: A gap in an array of strings, in thousandths, that stands for a blank.
GAP = -180
#: Containers within containers, and bytes that a stream may be unpacked to.
DEEPEST, LONGEST = 40, 256 << 20
#: Predefined encodings by the code page that their codes are of.
CODE_PAGES = {
    "UCS2": "utf-16-be", "UTF16": "utf-16-be", "90ms-RKSJ": "cp932", "90msp-RKSJ": "cp932", "EUC": "euc_jp", "GBK-EUC": "gbk", "GBKp-EUC": "gbk", "GBK2K": "gb18030",
    "GB-EUC": "gb2312", "B5pc": "big5", "ETen-B5": "big5", "ETenms-B5": "big5", "KSC-EUC": "euc_kr", "KSCms-UHC": "cp949", "WinAnsiEncoding": "cp1252", "MacRomanEncoding": "mac_roman",
}
#: Parts of the names of accented letters, and names that no rule gives.
ACCENTS = {"acute": "\u0301", "grave": "\u0300", "circumflex": "\u0302", "dieresis": "\u0308", "tilde": "\u0303", "cedilla": "\u0327", "ring": "\u030a", "caron": "\u030c"}
GLYPHS = {
    "space": " ", "period": ".", "comma": ",", "colon": ":", "semicolon": ";", "hyphen": "-", "parenleft": "(", "parenright": ")", "quoteright": "’", "quoteleft": "‘", "quotesingle": "'",
    "quotedbl": '"', "slash": "/", "percent": "%", "ampersand": "&", "plus": "+", "equal": "=", "underscore": "_", "at": "@", "numbersign": "#", "asterisk": "*", "question": "?", "exclam": "!",
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "endash": "–", "emdash": "—", "bullet": "•", "Euro": "€",
    "degree": "°", "section": "§", "guillemotleft": "«", "guillemotright": "»", "oe": "œ", "OE": "Œ", "ae": "æ", "AE": "Æ", "germandbls": "ß", "fi": "fi", "fl": "fl", "ff": "ff", "ffi": "ffi", "ffl": "ffl",
}


class Ref(int):
    """The number of an object that a value points to."""


class Name(str):
    """A name in a file."""


def _literal(raw: bytes) -> bytes:
    def plain(m: re.Match) -> bytes:
        return bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _ESCAPES.get(m[1], b"" if m[1] in (b"\r", b"\n", b"\r\n") else m[1])

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", plain, raw[1:-1], flags=re.S)


def _literal_end(data: bytes, at: int) -> int:
    """Place after the string in brackets that begins at ``at``."""
    depth = 0
    while at < len(data):
        c = data[at]
        if c == 0x5C:
            at += 1
        elif c in (0x28, 0x29):
            depth += 1 if c == 0x28 else -1
            if not depth:
                return at + 1
        at += 1
    raise ValueError("a string does not end")


def parsed(data: bytes, at: int = 0, depth: int = 0):
    """The value at ``at`` and the place after it; an unknown word is None."""
    m = _WORD.match(data, at)
    if not m or depth > DEEPEST:
        raise ValueError("no value")
    word, at = m[1], m.end()
    if m[2]:
        return Ref(m[2]), at
    if word == b"(":
        end = _literal_end(data, at - 1)
        return _literal(data[at - 1 : end]), end
    if word in (b"<<", b"["):
        out, last = [], b">>" if word == b"<<" else b"]"
        while not ((n := _WORD.match(data, at)) and n[1] == last):
            value, at = parsed(data, at, depth + 1)
            out.append(value)
        if word == b"[":
            return out, n.end()
        return {str(k): v for k, v in zip(out[::2], out[1::2])}, n.end()
    if word[:1] == b"/":
        return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), word[1:]).decode("latin-1")), at
    if word[:1] == b"<":
        code = re.sub(rb"\s", b"", word[1:-1])
        return bytes.fromhex((code + b"0" * (len(code) % 2)).decode()), at
    if word in (b"true", b"false"):
        return word == b"true", at
    try:
        return (float(word) if b"." in word else int(word)), at
    except ValueError:
        return None, at


def lzw(data: bytes, early: int = 1) -> bytes:
    """Codes of growing width, the first bits first; 256 starts anew, 257 ends."""
    out, table, width, bits, held, last = [], {}, 9, 0, 0, b""
    n, size = 258, 0
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        while bits >= width:
            code = held >> (bits - width)
            bits -= width
            held &= (1 << bits) - 1
            if code == 257 or size > LONGEST:
                return b"".join(out)
            if code == 256:
                table, width, last, n = {}, 9, b"", 258
                continue
            entry = bytes([code]) if code < 256 else table.get(code, last + last[:1] if code == n and last else None)
            if entry is None:
                return b"".join(out)
            out.append(entry)
            size += len(entry)
            if last and n < 4096:
                table[n] = last + entry[:1]
                n += 1
            last = entry
            width = 9 + (n + early > 511) + (n + early > 1023) + (n + early > 2047)
    return b"".join(out)


def ascii85(data: bytes) -> bytes:
    data, out = re.sub(rb"\s", b"", data).removeprefix(b"<~").split(b"~")[0], bytearray()
    group: list[int] = []
    for c in data:
        if c == 0x7A and not group:
            out += bytes(4)
        elif 33 <= c <= 117:
            group.append(c - 33)
        if len(group) == 5:
            out += (sum(x * 85 ** (4 - i) for i, x in enumerate(group)) & 0xFFFFFFFF).to_bytes(4)
            group = []
    if len(group) > 1:
        whole = group + [84] * (5 - len(group))
        out += (sum(x * 85 ** (4 - i) for i, x in enumerate(whole)) & 0xFFFFFFFF).to_bytes(4)[: len(group) - 1]
    return bytes(out)


def ascii_hex(data: bytes) -> bytes:
    code = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0])
    return bytes.fromhex((code + b"0" * (len(code) % 2)).decode())


def run_lengths(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and data[at] != 128:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


def flate(data: bytes) -> bytes:
    """What can be unpacked, of damaged data the part before the damage."""
    for bits in (15, -15):
        machine, out = zlib.decompressobj(bits), []
        try:
            for at in range(0, len(data), 1 << 16):
                out.append(machine.decompress(data[at : at + (1 << 16)], LONGEST))
            return b"".join([*out, machine.flush()])
        except zlib.error:
            if any(out):
                return b"".join(out)
    return b""


def unpredicted(data: bytes, parms: dict) -> bytes:
    """Rows of bytes told as differences from what is before and above."""
    kind, colours, depth, columns = (parms.get(k, v) for k, v in (("Predictor", 1), ("Colors", 1), ("BitsPerComponent", 8), ("Columns", 1)))
    if kind < 2:
        return data
    size, row = max(1, colours * depth // 8), (colours * depth * columns + 7) // 8
    if kind == 2:
        if depth != 8:
            return data
        out = bytearray(data)
        for at in range(0, len(out), row):
            for i in range(at + size, min(at + row, len(out))):
                out[i] = (out[i] + out[i - size]) & 255
        return bytes(out)
    out, above = [], bytearray(row)
    for at in range(0, len(data), row + 1):
        how, now = data[at], bytearray(data[at + 1 : at + 1 + row])
        for i in range(len(now)):
            a, b, c = now[i - size] if i >= size else 0, above[i], above[i - size] if i >= size else 0
            if how == 4:
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            else:
                near = (0, a, b, (a + b) // 2)[how] if how < 4 else 0
            now[i] = (now[i] + near) & 255
        out.append(bytes(now))
        above = now.ljust(row, b"\0")
    return b"".join(out)


FILTERS: dict[str, Callable[[bytes, dict], bytes]] = {
    "FlateDecode": lambda d, p: unpredicted(flate(d), p),
    "LZWDecode": lambda d, p: unpredicted(lzw(d, p.get("EarlyChange", 1)), p),
    "ASCII85Decode": lambda d, p: ascii85(d), "ASCIIHexDecode": lambda d, p: ascii_hex(d), "RunLengthDecode": lambda d, p: run_lengths(d), "Crypt": lambda d, p: d,
}
FILTERS |= {"Fl": FILTERS["FlateDecode"], "LZW": FILTERS["LZWDecode"], "A85": FILTERS["ASCII85Decode"], "AHx": FILTERS["ASCIIHexDecode"], "RL": FILTERS["RunLengthDecode"]}


class File:
    """Values and streams of a file's objects."""

    def __init__(self, data: bytes):
        self.data = data
        self.values: dict[int, object] = {}
        #: Of objects with a stream: generation and place of the stream's first byte.
        self.streams: dict[int, tuple[int, int]] = {}
        self.trailer: dict = {}
        self.decryption: Decryption | None = None
        at = 0
        while m := _OBJECT.search(data, at):
            at = self._object(int(m[1]), int(m[2]), m.end())
        for m in re.finditer(rb"trailer\s*(?=<<)", data):
            try:
                found, _ = parsed(data, m.end())
            except ValueError:
                continue
            self.trailer |= found
        if "Encrypt" in self.trailer:
            self._open()
        for n in [n for n in self.streams if self.dictionary(n).get("Type") == "ObjStm"]:
            self._unpack(n)

    def _object(self, number: int, generation: int, at: int) -> int:
        """Keep the object whose value begins at ``at``; the place from where to search on."""
        try:
            value, end = parsed(self.data, at)
        except ValueError:
            return at
        self.values[number] = value
        self.streams.pop(number, None)
        m = re.compile(rb"\s*stream(?:\r\n|\n|\r)").match(self.data, end)
        if isinstance(value, dict) and m:
            self.streams[number] = (generation, m.end())
            if value.get("Type") == "XRef":
                self.trailer |= {k: v for k, v in value.items() if k in ("Root", "Encrypt", "ID")}
            # A length that points elsewhere is looked up when the stream is read.
            length = value.get("Length")
            told = m.end() + length if type(length) is int else m.end()
            found = self.data.find(b"endstream", told if told <= len(self.data) else m.end())
            return found if found > 0 else m.end()
        return end

    def _open(self) -> None:
        ids = self.get(self.trailer.get("ID")) or [b""]
        number = self.trailer["Encrypt"]
        plain = self.get(number)
        if not isinstance(plain, dict):
            raise ValueError("no rule of encryption")
        self.decryption = Decryption({k: self.get(v) for k, v in plain.items()}, self.get(ids[0]) if ids else b"")

    def get(self, value):
        """``value``, or what it points to."""
        for _ in range(DEEPEST):
            if not isinstance(value, Ref):
                return value
            value = self.values.get(int(value))
        return None

    def dictionary(self, value) -> dict:
        found = self.get(Ref(value) if type(value) is int else value)
        return found if isinstance(found, dict) else {}

    def stream(self, value) -> bytes:
        """Content of the stream that ``value`` points to, after its filters; an unknown filter gives nothing."""
        number = int(value)
        if number not in self.streams:
            return b""
        generation, at = self.streams[number]
        d, length = self.dictionary(number), self.get(self.dictionary(number).get("Length"))
        end = at + length if type(length) is int and length >= 0 else -1
        if end < 0 or not re.compile(rb"\s*endstream").match(self.data, end):
            end = self.data.find(b"endstream", at)
            end = len(self.data) if end < 0 else end
            end -= 2 if self.data[at:end].endswith(b"\r\n") else 1 if self.data[at:end].endswith((b"\n", b"\r")) else 0
        data = self.data[at:end]
        if self.decryption and d.get("Type") != "XRef":
            data = self.decryption.stream(number, generation, data)
        names, parms = (self.get(d.get(k, d.get(s))) for k, s in (("Filter", "F"), ("DecodeParms", "DP")))
        names = names if isinstance(names, list) else [names] if names else []
        parms = parms if isinstance(parms, list) else [parms] * len(names)
        for i, name in enumerate(map(self.get, names)):
            if name not in FILTERS:
                return b""
            data = FILTERS[name](data, self.dictionary(parms[i]) if i < len(parms) else {})
        return data

    def _unpack(self, number: int) -> None:
        """Objects that lie in a stream; those of their own in the file count before them."""
        d, inner = self.dictionary(number), self.stream(number)
        first = self.get(d.get("First"))
        if not isinstance(first, int):
            return
        heads = [int(x) for x in re.findall(rb"\d+", inner[:first])]
        for n, start in zip(heads[::2], heads[1::2]):
            try:
                self.values.setdefault(n, parsed(inner, first + start)[0])
            except ValueError:
                continue

    def pages(self) -> list[dict]:
        """Pages in order, with what they take over from the nodes above."""
        roots = [self.dictionary(self.trailer.get("Root"))] + [d for d in self.values.values() if isinstance(d, dict) and d.get("Type") == "Catalog"]
        out, seen = [], set()

        def walk(value, above: dict) -> None:
            node = self.dictionary(value)
            if not node or (isinstance(value, Ref) and int(value) in seen):
                return
            if isinstance(value, Ref):
                seen.add(int(value))
            node = {k: above[k] for k in ("Resources", "MediaBox", "Rotate") if k in above} | node
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                for kid in kids:
                    walk(kid, node)
            else:
                out.append(node)

        walk(next((d["Pages"] for d in roots if "Pages" in d), None), {})
        return out

    def content(self, page: dict) -> bytes:
        found = page.get("Contents")
        parts = found if isinstance(found, Ref) and int(found) in self.streams else self.get(found)
        return b"\n".join(self.stream(x) for x in (parts if isinstance(parts, list) else [parts]) if isinstance(x, Ref))


def _unicode_table(cmap: bytes) -> dict[bytes, str]:
    out, text = {}, lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        out |= {bytes.fromhex(a.decode()): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, c, several in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[([^\]]*)\])", block):
            low, high = int(a, 16), int(b, 16)
            if several:
                for code, x in enumerate(re.findall(rb"<([0-9A-Fa-f]+)>", several), low):
                    out[code.to_bytes(len(a) // 2)] = text(x)
                continue
            first = text(c)
            for code in range(low, min(high, low + 0xFFFF) + 1):
                out[code.to_bytes(len(a) // 2)] = first[:-1] + chr(ord(first[-1]) + code - low)
    return out


def glyph(name: str) -> str:
    """Character of a glyph's name; nothing for names that tell none."""
    if len(name) == 1 or name in GLYPHS:
        return GLYPHS.get(name, name)
    if m := re.fullmatch(r"(?:uni((?:[0-9A-F]{4})+)|u([0-9A-F]{4,6}))(?:\..*)?", name):
        return "".join(chr(int(m[1][i : i + 4], 16)) for i in range(0, len(m[1]), 4)) if m[1] else chr(min(int(m[2], 16), 0x10FFFF))
    if len(name) > 1 and name[1:] in ACCENTS:
        return unicodedata.normalize("NFC", name[0] + ACCENTS[name[1:]])
    return ""


Spelling = Callable[[bytes], str]


def _by_table(table: dict[bytes, str]) -> Spelling:
    size = max(map(len, table))
    return lambda raw: "".join(table.get(raw[i : i + size], "") for i in range(0, len(raw), size))


def _plain(raw: bytes) -> str:
    return raw.decode("cp1252", "replace")


def _spelling(file: File, font: dict) -> Spelling:
    """How the codes of a font's texts become characters."""
    if isinstance(font.get("ToUnicode"), Ref) and (table := _unicode_table(file.stream(font["ToUnicode"]))):
        return _by_table(table)
    encoding = file.get(font.get("Encoding"))
    base = encoding.get("BaseEncoding") if isinstance(encoding, dict) else encoding
    page = CODE_PAGES.get(base) or next((p for k, p in CODE_PAGES.items() if isinstance(base, str) and re.fullmatch(rf"(?:Uni\w+-)?{k}-[HV]", base)), None)
    if font.get("Subtype") == "Type0" and not page:
        return lambda raw: ""
    codes: dict[int, str] = {}
    if isinstance(encoding, dict):
        at = 0
        for x in file.get(encoding.get("Differences")) or []:
            at = x if isinstance(x, int) else at
            if isinstance(x, Name):
                codes[at] = glyph(x)
                at += 1
    if codes:
        return lambda raw: "".join(codes[c] if c in codes else bytes([c]).decode(page or "cp1252", "replace") for c in raw)
    return (lambda raw: raw.decode(page, "replace")) if page else _plain


def fonts_of(file: File, page: dict) -> dict[bytes, Spelling]:
    fonts = file.dictionary(file.dictionary(page.get("Resources")).get("Font"))
    return {name.encode("latin-1"): _spelling(file, file.dictionary(font)) for name, font in fonts.items()}


def _page_text(content: bytes, fonts: dict[bytes, Spelling]) -> str:
    out, spell, inside = [], _plain, False
    for font, literal, code, number, bracket, line, quote in _TOKEN.findall(content):
        if font:
            spell = fonts.get(font, _plain)
        elif literal:
            out.append(spell(_literal(literal)))
        elif code.strip():
            code = re.sub(rb"\s", b"", code)
            out.append(spell(bytes.fromhex((code + b"0" * (len(code) % 2)).decode())))
        elif bracket:
            inside = bracket == b"["
        elif number and inside and float(number) < GAP:
            out.append(" ")
        elif line or quote:
            out.append("\n")
    return re.sub(r"\s*\n\s*", "\n", re.sub(r"[ \t]+", " ", "".join(out))).strip()


def pages_of(data: bytes, most: int | None = None) -> list[str]:
    """Texts of the first ``most`` pages; damaged files give those that can be read, files under a password none."""
    file = File(data)
    return [_page_text(file.content(page), fonts_of(file, page)) for page in file.pages()[:most]]
