"""Words and hashed word shingles, as every stage on shingles of this package sees them."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import mix

_STEP = np.uint64(0x9FB21C651E98DF25)


class WordHashes(dict):
    """64-bit hashes of words, cached; ``trim`` between texts bounds the cache."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def trim(self, most: int = 400_000) -> None:
        if len(self) > most:
            self.clear()


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case; ``bytes`` has just these rules."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_runs(words: list[bytes], hashes: WordHashes, width: int) -> np.ndarray:
    """64-bit hashes of the runs of ``width`` words, one for each place; a shorter text is one run."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    run = min(n, width)
    acc = h[: n - run + 1] + np.uint64(run)
    for j in range(1, run):
        acc *= _STEP
        acc += h[j : n - run + 1 + j]
    return mix(acc)


def shingle_set(words: list[bytes], hashes: WordHashes, width: int) -> np.ndarray:
    """The distinct hashes of a text's runs, sorted."""
    return np.unique(shingle_runs(words, hashes, width))
