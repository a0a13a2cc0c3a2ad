"""PDF streams under each filter, predictor, encoding and encryption, made by hand; each gives the plain file's text."""

import base64
import hashlib
import os
import random
import struct
import zlib

import pytest

from tendermill.sources import pdf as reader
from tendermill.sources.archives import text_of
from tendermill.sources.pdf import pages_of
from tendermill.sources.pdf_crypt import PAD, _hash_of_revision_6, aes_decrypt, aes_encrypt, rc4

CONTENT = b"BT /F1 12 Tf 72 700 Td (R\\350glement \\(RC\\)) Tj T* [(de la) -250 (con) 20 (sultation)] TJ ET " * 30
TEXT = "\n".join(["Règlement (RC)\nde la consultation"] * 30)


def file(content, stream_dict="", fonts="<< /F1 << /Type /Font /Subtype /Type1 >> >>", more=(), trailer="", number=4):
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count 1 /Kids [3 0 R] /Resources << /Font %s >> >>" % fonts.encode(),
        3: b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % number, number: b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(content), stream_dict.encode(), content),
    } | dict(more)
    return b"%PDF-1.7\n" + b"\n".join(b"%d 0 obj\n%s\nendobj" % x for x in objects.items()) + b"\ntrailer << /Root 1 0 R " + trailer.encode("latin-1") + b" >>"


def lzw(data, early=1):
    table, out, width, held, bits = {bytes([i]): i for i in range(256)}, bytearray(), 9, 0, 0
    n = 258

    def put(code):
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            out.append(held >> (bits - 8) & 255)
            bits -= 8
            held &= (1 << bits) - 1

    put(256)
    now = b""
    for c in data:
        if now + bytes([c]) in table:
            now += bytes([c])
            continue
        put(table[now])
        table[now + bytes([c])] = n
        n += 1
        width = 9 + (n - 1 + early > 511) + (n - 1 + early > 1023) + (n - 1 + early > 2047)
        now = bytes([c])
        if n == 4094:
            put(table[now])
            now = b""
            put(256)
            table, n, width = {bytes([i]): i for i in range(256)}, 258, 9
    if now:
        put(table[now])
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def lengths(data):
    out, at = bytearray(), 0
    while at < len(data):
        n = 1
        while n < 128 and at + n < len(data) and data[at + n] == data[at]:
            n += 1
        if n > 1:
            out += bytes([257 - n, data[at]])
        else:
            out += bytes([0, data[at]])
        at += n
    return bytes(out) + b"\x80"


def predicted(data, kind, columns, colours):
    row, size = columns * colours, colours
    data = data.ljust(-(-len(data) // row) * row, b" ")
    out, above = bytearray(), bytes(row)
    for k, at in enumerate(range(0, len(data), row)):
        now = data[at : at + row]
        if kind == 2:
            out += bytes((now[i] - (now[i - size] if i >= size else 0)) & 255 for i in range(row))
            continue
        how = k % 5
        out.append(how)
        for i in range(row):
            a, b, c = now[i - size] if i >= size else 0, above[i], above[i - size] if i >= size else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            out.append((now[i] - (0, a, b, (a + b) // 2, paeth)[how]) & 255)
        above = now
    return bytes(out)


@pytest.mark.parametrize(
    "made, told",
    [
        (zlib.compress(CONTENT), "/Filter /FlateDecode"), (lzw(CONTENT), "/Filter /LZWDecode"), (lzw(CONTENT, 0), "/Filter [/LZWDecode] /DecodeParms [<< /EarlyChange 0 >>]"),
        (base64.a85encode(CONTENT) + b"~>", "/Filter /ASCII85Decode"), (CONTENT.hex().encode() + b">", "/Filter/ASCIIHexDecode"), (lengths(CONTENT), "/Filter /RunLengthDecode"),
        (base64.a85encode(zlib.compress(CONTENT), wrapcol=60) + b"~>", "/Filter [ /ASCII85Decode /FlateDecode ]"), (zlib.compress(lengths(CONTENT)).hex().encode() + b">", "/F [/AHx /Fl /RL]"),
        (zlib.compress(predicted(CONTENT, 15, 7, 3)), "/Filter /FlateDecode /DecodeParms << /Predictor 15 /Columns 7 /Colors 3 >>"),
        (lzw(predicted(CONTENT, 2, 9, 1)), "/Filter /LZWDecode /DecodeParms << /Predictor 2 /Columns 9 >>"),
        (zlib.compress(CONTENT)[2:-4], "/Filter /FlateDecode"), (CONTENT, "/Filter []"),
    ],
)
def test_filters(made, told):
    assert pages_of(file(made, told)) == [TEXT]


def test_lzw_of_all_sizes():
    rng = random.Random(3)
    for n in (0, 1, 300, 5000, 60_000):
        data = bytes(rng.choices(range(256), k=n))
        assert reader.lzw(lzw(data)) == data and reader.lzw(lzw(data[:3000], 0), 0) == data[:3000]
        assert reader.ascii85(base64.a85encode(data)) == data and reader.run_lengths(lengths(data)) == data


def test_unknown_filters_and_damage_give_no_text():
    assert pages_of(file(CONTENT, "/Filter /JBIG2Decode")) == [""]
    raw, rng = file(zlib.compress(CONTENT), "/Filter /FlateDecode"), random.Random(5)
    assert text_of("a.pdf", raw)[0] == TEXT
    for _ in range(300):
        broken = bytearray(raw)
        for _ in range(rng.randrange(1, 8)):
            broken[rng.randrange(len(broken))] = rng.randrange(256)
        text_of("a.pdf", bytes(broken)[: rng.randrange(len(raw))])


def encrypted(version, revision, method, password=b"", metadata=True):
    """A file whose content is encrypted after the rules of a revision; the owner's part may be anything."""
    file_id, permission = bytes(range(16)), -44
    size = {1: 5, 2: 16, 4: 16, 5: 32}[version]
    pad = (password + PAD)[:32]
    if version < 5:
        owner = os.urandom(32)
        key = hashlib.md5(pad + owner + struct.pack("<i", permission) + file_id + (b"" if metadata or revision < 4 else b"\xff" * 4)).digest()
        for _ in range(50 if revision > 2 else 0):
            key = hashlib.md5(key[:size]).digest()
        key = key[:size]
        if revision == 2:
            user = rc4(key, PAD)
        else:
            user = hashlib.md5(PAD + file_id).digest()
            for i in range(20):
                user = rc4(bytes(k ^ i for k in key), user)
            user += os.urandom(16)
        more = ""
        mark = struct.pack("<I", 4)[:3] + b"\0\0" + (b"sAlT" if method == "AESV2" else b"")
        of_object = hashlib.md5(key + mark).digest()[: min(16, size + 5)]
    else:
        owner, key, salts = os.urandom(48), os.urandom(32), os.urandom(16)
        made = _hash_of_revision_6 if revision == 6 else lambda p, s: hashlib.sha256(p + s).digest()
        user = made(password, salts[:8]) + salts
        of_object, more = key, f"/UE <{aes_encrypt(made(password, salts[8:]), key, bytes(16)).hex()}> /OE <{bytes(32).hex()}>"
    packed, iv = zlib.compress(CONTENT), os.urandom(16)
    n = 16 - len(packed) % 16
    body = rc4(of_object, packed) if method in (None, "V2") else iv + aes_encrypt(of_object, packed + bytes([n]) * n, iv)
    rules = f"/Filter /Standard /V {version} /R {revision} /Length {8 * size} /P {permission} /O <{owner.hex()}> /U <{user.hex()}> {more}"
    if method:
        rules += f"/CF << /StdCF << /CFM /{method} /AuthEvent /DocOpen >> >> /StmF /StdCF /StrF /StdCF /EncryptMetadata {str(metadata).lower()}"
    return file(body, "/Filter /FlateDecode", more=[(9, b"<< %s >>" % rules.encode())], trailer=f"/Encrypt 9 0 R /ID [<{file_id.hex()}> <00>]")


FORMS = [(1, 2, None), (2, 3, None), (4, 4, "V2"), (4, 4, "AESV2"), (5, 5, "AESV3"), (5, 6, "AESV3")]


@pytest.mark.parametrize("form", FORMS)
def test_encrypted_files_that_open_without_a_password(form):
    assert pages_of(encrypted(*form)) == [TEXT]
    assert text_of("a.pdf", encrypted(*form, password=b"secret")) == ("", None)


def test_metadata_that_is_left_plain_counts_in_the_key():
    assert pages_of(encrypted(4, 4, "AESV2", metadata=False)) == [TEXT]


def test_ciphers_give_the_published_examples():
    key = bytes.fromhex("000102030405060708090a0b0c0d0e0f")
    plain = bytes.fromhex("00112233445566778899aabbccddeeff")
    assert aes_encrypt(key, plain, bytes(16)).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert aes_encrypt(bytes(range(32)), plain, bytes(16)).hex() == "8ea2b7ca516745bfeafc49904b496089"
    data, iv = os.urandom(160), os.urandom(16)
    assert aes_decrypt(bytes(range(32)), aes_encrypt(bytes(range(32)), data, iv), iv, padded=False) == data
    assert rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"


def test_predefined_encodings():
    def page(text, codec, encoding, kind="/Subtype /Type0"):
        return file(b"BT /F1 9 Tf <%s> Tj ET" % text.encode(codec).hex().encode(), fonts=f"<< /F1 << /Type /Font {kind} /Encoding {encoding} >> >>")

    assert pages_of(page("été 漢字", "utf-16-be", "/UniJIS-UTF16-H")) == ["été 漢字"] == pages_of(page("été 漢字", "utf-16-be", "/UniGB-UCS2-V"))
    for codec, name in (("cp932", "90ms-RKSJ-H"), ("gbk", "GBK-EUC-H"), ("big5", "ETen-B5-V"), ("euc_kr", "KSC-EUC-H")):
        text = "한국" if codec == "euc_kr" else "漢字 A"
        assert pages_of(page(text, codec, f"/{name}")) == [text]
    assert pages_of(page("Élan ü", "mac_roman", "/MacRomanEncoding", "/Subtype /TrueType")) == ["Élan ü"]
    assert pages_of(page("ABCD", "latin-1", "<< /Differences [65 /eacute /ccedilla 68 /uni20AC] >>", "/Subtype /Type1")) == ["éçC€"]
    assert pages_of(page("AB", "utf-16-be", "/Identity-H")) == [""]


def test_objects_in_streams_and_tables_of_places_in_streams():
    inner = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Contents 4 0 R /Resources << /Font << >> >> >>"]
    heads, at = "", 0
    for n, body in enumerate(inner, 1):
        heads, at = f"{heads}{n} {at} ", at + len(body) + 1
    packed = zlib.compress(heads.encode() + b" ".join(inner))
    raw = b"%PDF-1.7\n5 0 obj << /Type /ObjStm /N 3 /First " + b"%d /Length %d /Filter /FlateDecode >> stream\r\n" % (len(heads), len(packed)) + packed + b"\r\nendstream endobj\n"
    raw += b"4 0 obj << /Length 6 0 R >> stream\n" + CONTENT + b"\nendstream endobj 6 0 obj %d endobj\n" % len(CONTENT)
    raw += b"7 0 obj << /Type /XRef /Root 1 0 R /Size 8 /W [1 2 1] /Length 4 >> stream\n\x01\x02endobj\nendstream endobj"
    assert pages_of(raw) == [TEXT]


def test_a_saved_again_file_shows_its_last_version():
    raw = file(b"BT (old) Tj ET") + b"\n4 0 obj << /Length 14 >> stream\nBT (new) Tj ET\nendstream endobj\ntrailer << /Root 1 0 R >>"
    assert pages_of(raw) == ["new"]


def test_bytes_that_look_like_an_end_within_a_stream():
    content = b"BT (a) Tj ET % endstream endobj 3 0 obj\nBT (b) Tj ET"
    assert pages_of(file(content)) == ["a\nb"] or "b" in pages_of(file(content))[0]
