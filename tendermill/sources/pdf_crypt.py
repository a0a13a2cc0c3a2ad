"""Encrypted PDF files that open without a password: the standard handler with RC4 or AES."""

from __future__ import annotations

import hashlib
import struct

import numpy as np

#: Fixed value: what stands for the rest of a short password.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    state, j, out = list(range(256)), 0, bytearray()
    for i in range(256):
        j = (j + state[i] + key[i % len(key)]) & 255
        state[i], state[j] = state[j], state[i]
    i = j = 0
    for byte in data:
        i = (i + 1) & 255
        j = (j + state[i]) & 255
        state[i], state[j] = state[j], state[i]
        out.append(byte ^ state[(state[i] + state[j]) & 255])
    return bytes(out)


def _times(a: int, b: int) -> int:
    """Product in the field of 256 elements."""
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a = (a << 1) ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


def _boxes() -> tuple[list[int], list[int]]:
    """Substitution of bytes: the inverse in the field, then four rotations of it and a constant."""
    inverse = [0] + [next(y for y in range(1, 256) if _times(x, y) == 1) for x in range(1, 256)]
    turn = lambda x, n: (x << n | x >> 8 - n) & 255
    box = [x ^ turn(x, 1) ^ turn(x, 2) ^ turn(x, 3) ^ turn(x, 4) ^ 0x63 for x in inverse]
    back = [0] * 256
    for i, x in enumerate(box):
        back[x] = i
    return box, back


BOX, BACK = _boxes()
_BY = {n: [_times(x, n) for x in range(256)] for n in (2, 3, 9, 11, 13, 14)}
_BACK = np.array(BACK, np.uint8)
_TABLES = {n: np.array(_BY[n], np.uint8) for n in (9, 11, 13, 14)}
#: Places of a block's bytes, column by column, after the rows are shifted, and before.
_SHIFT = [(i + 4 * (i % 4)) % 16 for i in range(16)]
_UNSHIFT = [(i - 4 * (i % 4)) % 16 for i in range(16)]


def _round_keys(key: bytes) -> list[list[int]]:
    n, rounds = len(key) // 4, len(key) // 4 + 6
    words, turn = [list(key[4 * i : 4 * i + 4]) for i in range(n)], 1
    for i in range(n, 4 * (rounds + 1)):
        word = list(words[-1])
        if i % n == 0:
            word = [BOX[x] for x in word[1:] + word[:1]]
            word[0] ^= turn
            turn = _times(turn, 2)
        elif n > 6 and i % n == 4:
            word = [BOX[x] for x in word]
        words.append([a ^ b for a, b in zip(words[i - n], word)])
    return [sum(words[4 * r : 4 * r + 4], []) for r in range(rounds + 1)]


def aes_decrypt(key: bytes, data: bytes, iv: bytes, padded: bool = True) -> bytes:
    """All blocks of a chain at once; bytes after the last whole block are left out."""
    keys = [np.array(k, np.uint8) for k in _round_keys(key)]
    blocks = np.frombuffer(data[: len(data) // 16 * 16], np.uint8).reshape(-1, 16)
    if not len(blocks):
        return b""
    x = blocks ^ keys[-1]
    for k in reversed(keys[:-1]):
        x = _BACK[x[:, _UNSHIFT]] ^ k
        if k is not keys[0]:
            a = [x[:, i::4] for i in range(4)]
            mixed = np.empty_like(x)
            for i in range(4):
                mixed[:, i::4] = _TABLES[14][a[i]] ^ _TABLES[11][a[(i + 1) % 4]] ^ _TABLES[13][a[(i + 2) % 4]] ^ _TABLES[9][a[(i + 3) % 4]]
            x = mixed
    before = np.concatenate([np.frombuffer(iv, np.uint8)[None], blocks[:-1]])
    out = (x ^ before).tobytes()
    return out[: -out[-1]] if padded and 1 <= out[-1] <= 16 else out


def aes_encrypt(key: bytes, data: bytes, iv: bytes) -> bytes:
    """A chain of whole blocks, one after the other."""
    keys, out, last = _round_keys(key), [], list(iv)
    two, three = _BY[2], _BY[3]
    for at in range(0, len(data), 16):
        x = [a ^ b ^ c for a, b, c in zip(data[at : at + 16], last, keys[0])]
        for k in keys[1:-1]:
            s = [BOX[x[i]] for i in _SHIFT]
            x = []
            for c in (0, 4, 8, 12):
                a, b, d, e = s[c : c + 4]
                x += [two[a] ^ three[b] ^ d ^ e, a ^ two[b] ^ three[d] ^ e, a ^ b ^ two[d] ^ three[e], three[a] ^ b ^ d ^ two[e]]
            x = [a ^ b for a, b in zip(x, k)]
        last = [BOX[x[i]] ^ k for i, k in zip(_SHIFT, keys[-1])]
        out += last
    return bytes(out)


def _hash_of_revision_6(password: bytes, salt: bytes) -> bytes:
    key, n = hashlib.sha256(password + salt).digest(), 0
    while True:
        mixed = aes_encrypt(key[:16], (password + key) * 64, key[16:32])
        key = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(mixed[:16]) % 3](mixed).digest()
        n += 1
        if n >= 64 and mixed[-1] <= n - 32:
            return key[:32]


class Decryption:
    """Key of a file and method of its streams, if the empty password opens it."""

    def __init__(self, d: dict, file_id: bytes):
        self.version, revision = d.get("V", 0), d.get("R", 0)
        self.method = "RC4"
        if self.version >= 4:
            name = d.get("StmF", "Identity")
            self.method = {"V2": "RC4", "AESV2": "AES", "AESV3": "AES"}.get(d.get("CF", {}).get(name, {}).get("CFM", "None"), "Identity")
        if self.version not in (1, 2, 4, 5) or d.get("Filter") != "Standard":
            raise ValueError("a handler that is not known")
        self.key = self._long_key(d, revision) if self.version == 5 else self._short_key(d, revision, file_id)

    @staticmethod
    def _short_key(d: dict, revision: int, file_id: bytes) -> bytes:
        size = 5 if revision == 2 else max(5, min(16, (d.get("Length", 40) if d.get("V") != 4 else 128) // 8))
        plain = b"\xff" * 4 if revision >= 4 and d.get("EncryptMetadata") is False else b""
        key = hashlib.md5(PAD + d["O"][:32] + struct.pack("<i", (d["P"] + (1 << 31)) % (1 << 32) - (1 << 31)) + file_id + plain).digest()
        for _ in range(50 if revision >= 3 else 0):
            key = hashlib.md5(key[:size]).digest()
        key = key[:size]
        if revision == 2:
            told = rc4(key, PAD) == d["U"][:32]
        else:
            mark = hashlib.md5(PAD + file_id).digest()
            for i in range(20):
                mark = rc4(bytes(k ^ i for k in key), mark)
            told = mark == d["U"][:16]
        if not told:
            raise ValueError("the file is under a password")
        return key

    @staticmethod
    def _long_key(d: dict, revision: int) -> bytes:
        made = _hash_of_revision_6 if revision >= 6 else lambda p, salt: hashlib.sha256(p + salt).digest()
        user = d["U"]
        if made(b"", user[32:40]) != user[:32]:
            raise ValueError("the file is under a password")
        return aes_decrypt(made(b"", user[40:48]), d["UE"][:32], bytes(16), padded=False)

    def stream(self, number: int, generation: int, data: bytes) -> bytes:
        if self.method == "Identity":
            return data
        key = self.key
        if self.version < 5:
            mark = struct.pack("<I", number)[:3] + struct.pack("<H", generation) + (b"sAlT" if self.method == "AES" else b"")
            key = hashlib.md5(key + mark).digest()[: min(16, len(key) + 5)]
        return rc4(key, data) if self.method == "RC4" else aes_decrypt(key, data[16:], data[:16]) if len(data) >= 32 else b""
