"""Tables over code points, by which whole batches of texts are classed at once in numpy.

Tables cover the basic plane; characters beyond it are looked up by rule when a batch holds any.
"""

from __future__ import annotations

import unicodedata

import numpy as np

from .shared import code_points, mix64

#: Classes of characters; 0 is no letter. Marks count as letters in scripts whose vowels are marks.
LATIN, HAN, KANA, HANGUL, CYRILLIC, DEVANAGARI, THAI, ARABIC, DIGIT, OTHER = range(1, 11)
CLASSES = 11
_BLOCKS = ((0x370, 0x400, OTHER), (0x400, 0x530, CYRILLIC), (0x600, 0x700, ARABIC), (0x900, 0x980, DEVANAGARI), (0xE00, 0xE80, THAI), (0x1100, 0x1200, HANGUL), (0x3041, 0x3100, KANA), (0x31F0, 0x3200, KANA), (0x2E80, 0x2FE0, HAN), (0x3400, 0xA000, HAN), (0xAC00, 0xD7B0, HANGUL), (0xF900, 0xFB00, HAN), (0xFF66, 0xFFA0, KANA), (0x20000, 0x32000, HAN))
_MARKED = (DEVANAGARI, THAI, ARABIC)


def fold_of(code: int) -> int:
    """The character without width and case, where that is one character again."""
    if 0xD800 <= code < 0xE000:
        return code
    new = unicodedata.normalize("NFKC", chr(code)).casefold()
    return ord(new) if len(new) == 1 else code


def class_of(code: int) -> int:
    kind = unicodedata.category(chr(code))
    if kind[0] == "N":
        return DIGIT
    block = next((c for a, z, c in _BLOCKS if a <= code < z), 0)
    if kind[0] == "L":
        return block or (LATIN if code < 0x250 or 0x1E00 <= code < 0x1F00 or 0xFF21 <= code <= 0xFF5A else OTHER)
    return block if kind[0] == "M" and block in _MARKED else 0


def letters_of(code: int) -> str:
    """Letters and digits of the character once it is fully decomposed and folded: a sum over them doesn't depend on
    how a text is composed."""
    if 0xD800 <= code < 0xE000:
        return ""
    return "".join(c for c in unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", chr(code)).casefold()) if c.isalnum())


def _hashes(codes: np.ndarray) -> np.ndarray:
    return mix64(codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def weight_of(code: int) -> int:
    """Sum of a hash of each of the character's letters, modulo 2^64."""
    return int(_hashes(code_points(letters_of(code))).sum(dtype=np.uint64))


def _all_weights() -> np.ndarray:
    held = [letters_of(c) for c in range(0x10000)]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_hashes(code_points("".join(held))), dtype=np.uint64)))
    end = np.cumsum(list(map(len, held)))
    return sums[end] - sums[end - list(map(len, held))]


class Table:
    """One value per code point; built when first used."""

    def __init__(self, rule, kind, build=None):
        self.rule, self.kind, self.build, self.values, self.beyond = rule, kind, build, None, {}

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        if self.values is None:
            self.values = self.build() if self.build else np.fromiter((self.rule(c) for c in range(0x10000)), self.kind, 0x10000)
        high = codes > 0xFFFF
        if not high.any():
            return self.values[codes]
        out = self.values[np.where(high, 0, codes)]
        found, at = np.unique(codes[high], return_inverse=True)
        for c in found.tolist():
            if c not in self.beyond:
                self.beyond[c] = self.rule(c)
        out[high] = np.array([self.beyond[c] for c in found.tolist()], dtype=self.kind)[at]
        return out


FOLD = Table(fold_of, np.uint32)
CLASS = Table(class_of, np.uint8)
LETTERS = Table(lambda c: len(letters_of(c)), np.uint8)
WEIGHT = Table(weight_of, np.uint64, _all_weights)
LOWER = Table(lambda c: ord(x) if not 0xD800 <= c < 0xE000 and len(x := chr(c).lower()) == 1 else c, np.uint32)


class Block:
    """The code points of several texts, each followed by a line break, and the text of each."""

    def __init__(self, texts: list[str]):
        self.codes = code_points("\n".join([*texts, ""]))
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.row = np.repeat(np.arange(len(texts), dtype=np.int64), self.lengths)


def chunks(sizes: list[int], letters: int = 400_000):
    """Ranges of rows of about so many letters; a longer row is a range of its own."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > letters:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)
