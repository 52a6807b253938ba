"""Word shingle sets of whole texts, as arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
MEMO_WORDS = 200_000


class WordHashes(dict):
    """64-bit hash of each word; a cache, emptied when it holds MEMO_WORDS."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, width: int, memo: WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct shingles of `width` words.

    Words are the runs between ASCII white space, A-Z lower-cased. With fewer words
    than `width` the whole sequence is the one shingle; null or no words: empty.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    size = min(width, len(words))
    total = np.full(n, np.uint64(size), np.uint64)
    for i in range(size):
        total = total * MULTIPLIER + h[i : i + n]
    return np.unique(mix(total))
