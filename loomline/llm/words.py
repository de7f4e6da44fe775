"""Words of a text, their hashes, and sets of hashed word shingles; all in bytes, for whole texts."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words in a shingle.
SHINGLE = 5
_LIMIT = 400_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    """Runs of bytes other than the space and 09-0D, with A-Z lowered; bytes.lower and bytes.split mean just these."""
    return text.encode("utf-8", "surrogatepass").lower().split()


class WordHashes(dict):
    """64-bit hashes of words, kept for words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(h: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the word shingles, in order, from the words' hashes. Fewer words: the whole sequence as one shingle. None: empty."""
    n = len(h)
    if n == 0:
        return np.empty(0, np.uint64)
    m = max(1, n - width + 1)
    out = np.full(m, min(n, width), np.uint64)
    for j in range(min(n, width)):
        out = out * _MULTIPLIER + h[j : j + m]
    return mix(out)


def shingle_set(words: list[bytes], hashes: WordHashes, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles."""
    return np.unique(shingle_hashes(hashes.of(words), width))
