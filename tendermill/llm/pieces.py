"""Whole texts to token ids by way of their distinct chunks.

A tokenizer's pattern never joins the two sides of a space or line break that
stands alone between two other characters, so a text whose blanks are of that
kind is the sequence of its space-separated chunks, each encoded for itself.
Texts with other blanks are cut by the pattern as they are.  A run of letters,
with or without a space before it, must be one piece, and so must be one other
character after it; this is asked of the pattern at the start.

Ids of chunks are kept in two generations: a lookup that misses the young one
takes the entry over from the old one or encodes the chunk; once the young one
is full it becomes the old one.  Frequent chunks stay, memory is bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import regex

#: Chunks in a generation; a task keeps two of each of the two kinds.
KEPT = 300_000
#: Longer chunks are encoded each time.
KEPT_CHARS = 48


class _Blank(Exception):
    """A chunk that is empty or holds a blank at an end: its text is cut as a whole."""


class Chunks(dict):
    """Id bytes of chunks that follow ``lead``, made as they are looked up; ``cut`` takes all but plain words."""

    def __init__(self, lead: str, encode_piece: Callable[[str], bytes], cut: Callable[[str], bytes], tail: Chunks | None, kept: int):
        self.lead, self.encode_piece, self.cut, self.kept, self.old = lead, encode_piece, cut, kept, {}
        #: Chunks without a lead, for the character after a run of letters.
        self.tail = self if tail is None else tail

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            if chunk.isalpha():
                ids = self.encode_piece(self.lead + chunk)
            elif not chunk or chunk[0].isspace() or chunk[-1].isspace():
                raise _Blank
            elif chunk[:-1].isalpha():
                ids = self[chunk[:-1]] + self.tail[chunk[-1]]
            else:
                ids = self.cut(self.lead + chunk)
            if len(chunk) > KEPT_CHARS:
                return ids
        self[chunk] = ids
        return ids

    def turn(self) -> None:
        if len(self) >= self.kept:
            self.old = dict(self)
            self.clear()


class TextEncoder:
    """Texts to id bytes; ``encode_piece`` gives those of a piece, which must not depend on other pieces."""

    def __init__(self, pattern: str, encode_piece: Callable[[str], bytes], kept: int = KEPT):
        self.split, self.encode_piece = regex.compile(pattern).findall, encode_piece
        #: Chunks at the start of a line and chunks after a space.
        self.first = Chunks("", encode_piece, self._cut, None, kept)
        self.rest = Chunks(" ", encode_piece, self._cut, self.first, kept)
        self.line_break = encode_piece("\n")
        if [self.split(x) for x in (" ab", "ab", " ab'", "ab1")] != [[" ab"], ["ab"], [" ab", "'"], ["ab", "1"]]:
            raise ValueError("runs of letters are no pieces of this pattern")

    def _cut(self, text: str) -> bytes:
        cut = self.split(text)
        return self.encode_piece(text) if len(cut) == 1 else b"".join(map(self._piece, cut))

    def _piece(self, piece: str) -> bytes:
        # What begins or ends with a blank of any kind is no chunk; the pattern need not take the same characters for blanks.
        chunk = piece.removeprefix(" ")
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            return self.encode_piece(piece)
        return self.first[piece] if chunk is piece else self.rest[chunk]

    def encode_text(self, text: str) -> bytes:
        if not text:
            return b""
        first, rest, lines = self.first, self.rest.__getitem__, []
        try:
            for line in text.split("\n"):
                head, *others = line.split(" ")
                lines.append(first[head] + b"".join(map(rest, others)))
            ids = self.line_break.join(lines)
        except _Blank:
            ids = b"".join(map(self._piece, self.split(text)))
        self.first.turn()
        self.rest.turn()
        return ids

    def encode_stream(self, texts: Iterable[str]) -> Iterator[bytes]:
        return map(self.encode_text, texts)
