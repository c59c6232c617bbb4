"""Token ids of whole texts by the tokenizers library, with the ids of frequent words remembered.

Both supported pre-tokenizers end a token at every run of white space, so the ids of a text are those of its pieces
between ASCII space, one after the other. A piece is encoded by the library once and then looked up. Most new
pieces are a word of plain letters: their pre-tokens are known, so they go straight to the library's merge model. ASCII symbols
at a word's end are a pre-token of their own, so the word's ids, often known by then, are followed by theirs. Texts where a piece could look beyond its edge (white space beyond ASCII
next to it, or strings of special tokens) are encoded whole.
"""

from __future__ import annotations

import codecs
import gc
import os
import re
import string
import struct
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

import numpy as np
from tokenizers import Tokenizer

from .common import Remembered

#: Pieces whose ids a Python worker remembers.
KEPT_PIECES = 600_000
#: White space beyond ASCII, and what it begins with; the begin of a special token.
_WIDE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_WIDE_BEGINS = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
_SPECIAL = b"<|"
#: Marks a piece that has no space before it.
_BARE = b"\0"
#: Runs of white space and white space other than blanks and line ends: where a word's space is not simply one blank.
_RUNS = (b"  ", b" \n", b"\n ", b"\n\n", b"\t", b"\r", b"\v", b"\f")
_SPACES = (b"", b" ", b"\t", b"\n", b"\r", b"\v", b"\f")
_LEADING = re.compile(rb"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")


def _whole(text: bytes) -> bool:
    """May a piece of this text look beyond its edge?"""
    return _SPECIAL in text or _BARE in text or (not text.isascii() and any(x in text for x in _WIDE_BEGINS) and _WIDE.search(text) is not None)


#: The character that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the rest from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_REST = sorted(set(range(256)) - _PRINTABLE)
_CHARACTERS = "".join(chr(b) if b in _PRINTABLE else chr(256 + _REST.index(b)) for b in range(256))
#: What both pre-tokenizers take for symbols among ASCII characters.
_SYMBOLS = string.punctuation.encode()
#: Packs so many ids.
_PACKED = [struct.Struct(f"<{n}I").pack for n in range(32)]


@dataclass(frozen=True)
class Kind:
    """How a vocabulary cuts texts: its pieces, whether it drops case, and whether a word keeps the space before it."""

    pieces: Callable[[bytes], list[bytes]]
    lower: bool
    spaced: bool

    def text(self, piece: bytes) -> bytes:
        """What a piece stands for."""
        if not self.spaced or piece[:1] == b"\n":
            return piece
        return piece[1:] if piece[:1] == _BARE else b" " + piece

    def parts(self, piece: bytes) -> tuple[str, str] | None:
        """The pre-tokens of a plain piece: a line end and a word with its space; None if it is not plain."""
        word, line, space = piece, "", ""
        if self.spaced:
            if word[:1] == _BARE:
                word = word[1:]
            elif word[:1] == b"\n":
                line, word = _CHARACTERS[10], word[1:]
            else:
                space = _CHARACTERS[32]
        text = word.decode("utf-8", "replace")
        if not text.isalpha():
            return None
        if text.isascii():
            return line, space + text
        if max(text) > "\xff" or b"\xc2" in word:  # plain are the two-byte Latin-1 letters, which normalization leaves alone
            return None
        return line, space + codecs.charmap_decode(text.lower().encode() if self.lower else word, "strict", _CHARACTERS)[0]


def _word(piece: bytes) -> bytes | None:
    """A piece without the symbols at its end, if it has some and they are a pre-token of their own: they follow an ASCII letter or digit or a plain letter."""
    word = piece.rstrip(_SYMBOLS)
    if len(word) == len(piece) or not (word[-1:].isalnum() or word[-2:-1] == b"\xc3" and word[-1:] not in (b"\x97", b"\xb7")):
        return None
    return word


class _Pieces(dict):
    """Ids of pieces, made when they are first asked for; a bounded number of words is remembered, the others until they are cleared.

    A word with symbols at its end is put together from both, which is cheap, so these many pieces take no room from words.
    """

    def __init__(self, make: Callable[[bytes], bytes], symbols: Callable[[bytes], bytes]):
        self.make, self.symbols, self.others = make, Remembered(symbols), {}

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.others.get(piece)
        if ids is None:
            word = _word(piece)
            if word is not None:
                ids = self.others[piece] = self[word] + self.symbols[piece[len(word):]]
            else:
                ids = self.make(piece)
                (self if len(self) < KEPT_PIECES else self.others)[piece] = ids
        return ids


class Encoder:
    """Encodes texts to bytes of little-endian 32-bit ids, without special tokens added."""

    def __init__(self, path: str, kind: Kind):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer, self.kind = Tokenizer.from_file(path), kind
        self.model, self.known = self.tokenizer.model, _Pieces(self._piece, lambda run: self._ids(run.decode()))
        self.space = _CHARACTERS[32] if kind.spaced else ""

    def _encoded(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(f.ids, "<u4").tobytes() for f in found]

    def _ids(self, *parts: str) -> bytes:
        """The ids of pre-tokens."""
        ids = [token.id for part in parts if part for token in self.model.tokenize(part)]
        return _PACKED[len(ids)](*ids) if len(ids) < len(_PACKED) else struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: bytes) -> bytes:
        """The ids of a piece."""
        if piece.isalpha():  # most are a word of ASCII letters
            return self._ids(self.space + piece.decode())
        parts = self.kind.parts(piece)
        return self._ids(*parts) if parts is not None else self._encoded([self.kind.text(piece)])[0]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each UTF-8 text."""
        collects = gc.isenabled()
        gc.disable()  # no cycles are made here, so the collector would only walk over pieces again and again
        try:
            out = [None if _whole(t) else b"".join(map(self.known.__getitem__, self.kind.pieces(t))) for t in texts]
            whole = iter(self._encoded([t for t, ids in zip(texts, out) if ids is None]))
            self.known.others.clear()
            gc.freeze()
        finally:
            if collects:
                gc.enable()
        return [next(whole) if ids is None else ids for ids in out]


def lower_words(text: bytes) -> list[bytes]:
    """Pieces for a vocabulary that drops white space and case: words, A-Z in lower case."""
    return text.lower().split()


def spaced_words(text: bytes) -> list[bytes]:
    """Pieces for a byte-level vocabulary: words with the white space before them, and white space at the end.

    A piece stands for itself after one space, unless it begins with a line end or the mark of a bare piece.
    """
    if not any(x in text for x in _RUNS):
        first, *rest = text.replace(b"\n", b" \n").split(b" ")
        return [_BARE + first, *rest]
    return [p[1:] if p[:1] == b" " and p[1:2] not in _SPACES else p if p[:1] == b"\n" else _BARE + p for p in _LEADING.findall(text)]


LOWER_WORDS = Kind(lower_words, lower=True, spaced=False)
SPACED_WORDS = Kind(spaced_words, lower=False, spaced=True)


@cache
def encoder(path: str, kind: Kind) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path, kind)
