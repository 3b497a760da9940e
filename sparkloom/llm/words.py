"""Words, and 64-bit hashes of words and of runs of words."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: A word is a longest run of letters and digits of any script; the underscore is not one.
_WORD = re.compile(r"[^\W_]+")
#: Odd multiplier of the rolling hash modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
CACHE_ENTRIES = 500_000


def words(text: str | None) -> list[str]:
    """The words of a text, lower-cased; null and empty text have none."""
    return _WORD.findall(text.lower()) if text else []


def each_word(text: str | None):
    """The words of :func:`words` one by one, for a look at the first of them."""
    return (m.group().lower() for m in _WORD.finditer(text)) if text else iter(())


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def raw_words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8, faster where it is ASCII."""
    if not text:
        return []
    if text.isascii():
        return text.encode().translate(_LOWER).split()
    return [w.encode("utf-8", "replace") for w in _WORD.findall(text.lower())]


def word_bytes(text: str | None) -> bytes:
    """The words of a text as lower-cased UTF-8 between blanks."""
    if not text:
        return b""
    return text.encode().translate(_LOWER) if text.isascii() else b" ".join(raw_words(text))


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of texts given by :func:`word_bytes`, and the number of words of each text.

    All words of a batch are hashed at once: prefix sums of a polynomial over the bytes, modulo 2**64.
    """
    flat, counts = [], []
    for k in range(0, len(texts), 1024):
        part = texts[k : k + 1024]
        raw = np.frombuffer(b" ".join(part) + b" ", np.uint8)
        inside = np.zeros(len(raw) + 1, np.int8)
        inside[1:] = raw != 32
        change = np.diff(inside)
        begin, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        up, down = _powers_to(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(raw * up[: len(raw)], out=sums[1:], dtype=np.uint64)
        flat.append(mix((sums[end] - sums[begin]) * down[begin]))
        bounds = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
        counts.append(np.diff(np.searchsorted(begin, bounds), prepend=0))
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *flat]), np.concatenate([none.astype(np.int64), *counts])


class WordHashes(dict):
    """Hash by word, as text or UTF-8, remembered within a Python worker up to ``CACHE_ENTRIES`` words."""

    def __missing__(self, word: str | bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word if isinstance(word, bytes) else word.encode("utf-8", "replace"))
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[word] = h
        return h

    def array(self, ws: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


HASHES = WordHashes()
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, INVERSE)):
            p = np.full(2 * n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def rolling(hashes: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hash of each run of ``length`` words, all windows at once by prefix sums."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _powers_to(len(hashes))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up, out=sums[1:], dtype=np.uint64)
    return mix((sums[length:] - sums[:-length]) * down[:n])


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values, so that any of them may index a table."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
