"""Words of a text and their hashes, for use inside tasks."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: A character U+4E00 to U+9FFF alone, or a longest run of other letters and digits.
WORD = re.compile("[一-鿿]|[^\\W_一-鿿]+")
_CACHE_WORDS = 500_000


def words(text: str | None) -> list[str]:
    """The words of a text in lower case; none for null or empty text."""
    return WORD.findall(text.lower()) if text else []


class WordHashes:
    """64-bit hashes of words, the same on every executor. It remembers the words seen last."""

    def __init__(self) -> None:
        self._known: dict[str, int] = {}

    def __call__(self, found: list[str]) -> np.ndarray:
        known = self._known
        if len(known) > _CACHE_WORDS:
            known.clear()
        for w in set(found):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """One 64-bit hash for each run of ``size`` consecutive words, in order of position."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    return mixed(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values, so that any of their bits may be used."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))
