"""Words of many texts at once: runs of letters and digits after NFKC and lower case."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np

_STEP = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def every_character() -> str:
    """All code points, in order, as one text."""
    return np.arange(sys.maxunicode + 1, dtype=np.uint32).tobytes().decode("utf-32-le", "surrogatepass")


@lru_cache(maxsize=1)
def letters_and_digits() -> np.ndarray:
    out = np.zeros(sys.maxunicode + 1, bool)
    for m in re.finditer(r"[^\W_]+", every_character()):
        out[m.start() : m.end()] = True
    return out


@lru_cache(maxsize=1)
def _lower() -> np.ndarray:
    """The code point of each code point's lower case (itself where that is more than one)."""
    # two letters aside, of which one has two code points and the other looks at its neighbours
    odd = "\u0130\u03a3"
    whole = every_character().replace(odd[0], " ").replace(odd[1], " ").lower()
    out = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    for c in odd:
        low = c.lower()
        out[ord(c)] = ord(low) if len(low) == 1 else ord(c)
    return out


_weights = np.ones(1, np.uint64)


def _weight(n: int) -> np.ndarray:
    """The first n powers of an odd constant, modulo 2**64."""
    global _weights
    if len(_weights) < n:
        w = np.full(max(n, 256), _STEP, np.uint64)
        w[0] = 1
        _weights = np.cumprod(w)
    return _weights


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


def normalized(text: str | None) -> str:
    """NFKC; the separator U+0000 is no letter and becomes a space."""
    if not text:
        return ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return text.replace("\0", " ") if "\0" in text else text


def word_hashes(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first place, length) of each word in code points; the hash does not depend on case."""
    is_word = letters_and_digits()[cp]
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1]
    at, first = np.flatnonzero(is_word), np.flatnonzero(begins)
    if not len(first):
        return np.zeros(0, np.uint64), first, first
    rank = np.searchsorted(at, first)  # of each word's first letter among all letters
    size = np.diff(np.r_[rank, len(at)])
    inside = np.arange(len(at)) - np.repeat(rank, size)
    terms = (_lower()[cp[at]] + np.uint64(1)) * _weight(int(size.max()))[inside]
    return mix(np.add.reduceat(terms, rank) + size.astype(np.uint64)), first, size


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word as uint64, number of words of each text), in order.

    The work is done on code points of all texts at once, so its cost follows
    the characters, not the words. Null and empty texts have no words.
    """
    joined = "\0".join(map(normalized, texts)).lower()
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(cp):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    hashes, first, _ = word_hashes(cp)
    upto = np.searchsorted(first, np.r_[np.flatnonzero(cp == 0), len(cp)])
    return hashes, np.diff(np.r_[0, upto])


def shingles(hashes: np.ndarray, per_text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of `width` successive words, text it belongs to)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(per_text)), per_text)
    h = hashes[:n].copy()
    for i in range(1, width):
        h = h * np.uint64(_STEP) + hashes[i : i + n]
    ok = text[:n] == text[width - 1 : width - 1 + n]
    return mix(h[ok]), text[:n][ok]
