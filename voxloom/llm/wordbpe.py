"""Ids of the lower-casing word-end BPE vocabulary, equal to the tokenizers library's.

The library splits a normalised text into pieces and merges each piece by itself, so a piece
always gives the same ids. Texts made only of characters whose normalisation and classes are
certain (ASCII and precomposed Latin letters) are split here and pieces are looked up in a
bounded memo that asks the library's merges once per piece; every other text, and any text with a
special string, goes to the library whole.
"""

from __future__ import annotations

import functools
import re
from array import array

from voxloom.llm.base import CACHES

MEMO = 690_000
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
_SPECIAL = re.compile("(" + "|".join(map(re.escape, SPECIAL)) + ")")
_UNSAFE = re.compile("[^\t-\r -~\xa0-\u012f\u0132-\u017e]")
_L = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017e"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\\s{_L}{_N}]+")
_PIECE_ASCII = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\\sa-z0-9]+")


class Memo(dict):
    """A dict that computes what it lacks and starts anew when it is full."""

    def __init__(self, compute, limit: int = MEMO):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.compute(key)
        return value


def byte_letters() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies, by the published rule."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


def pieces(text: str) -> list[str] | None:
    """Pre-tokens of a text, or None where only the library may split it."""
    if "<|" in text and any(s in text for s in SPECIAL):
        return None
    if text.isascii():
        if _UNSAFE.search(text):
            return None
        return _PIECE_ASCII.findall(text.lower())
    if _UNSAFE.search(text):
        return None
    return _PIECE.findall(text.lower())


def parts(text: str) -> list[str]:
    """A text cut at its special strings, which the library takes out before it normalises."""
    return _SPECIAL.split(text)[::2] if "<|" in text else [text]


class WordBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.model, self.normalizer, self.splitter = self.lib.model, self.lib.normalizer, self.lib.pre_tokenizer
        self.letters = {b: c for c, b in byte_letters().items()}
        self.packed = Memo(lambda piece: array("I", self.piece_ids(piece)).tobytes())

    def library_ids(self, text: str) -> list[int]:
        return self.lib.encode(text, add_special_tokens=False).ids

    def split(self, text: str) -> list[str]:
        """Pre-tokens of any text without special strings, in byte stand-ins, as the library splits it."""
        return [p for p, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))]

    def stand_ins(self, piece: str) -> str:
        """The UTF-8 bytes of a pre-token as printable letters."""
        return piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)

    def piece_ids(self, piece: str) -> list[int]:
        """Ids of one pre-token, by the library's merges alone."""
        return [t.id for t in self.model.tokenize(self.stand_ins(piece))]

    def ids(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        found = pieces(text)
        if found is None:
            return array("I", self.library_ids(text)).tobytes()
        return b"".join(map(self.packed.__getitem__, found))


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    """One tokenizer for each Python worker and path."""
    return WordBpe(path)


CACHES["wordbpe"] = load.cache_clear
