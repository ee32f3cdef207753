"""Word shingles as hash sets. Words: ASCII lower-cased, split at ASCII white space."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
#: Bytes of distinct words (and some 150 more for each) whose hashes a task keeps.
KEPT_BYTES = 160_000_000
_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFF51AFD7ED558CCD)]


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").lower().split()


class WordHashes(dict):
    """64-bit hashes of words, each computed once while it is kept."""

    def __init__(self, kept: int = KEPT_BYTES):
        super().__init__()
        self.kept, self.size = kept, 0

    def __missing__(self, word: bytes) -> int:
        if self.size >= self.kept:
            self.clear()
            self.size = 0
        self.size += len(word) + 150
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, parts: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, parts), dtype=np.uint64, count=len(parts))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(parts: list[bytes], hashes: WordHashes, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a shorter text is one shingle, a text without words has none."""
    if not parts:
        return np.empty(0, dtype=np.uint64)
    if len(parts) < size:
        return np.array([xxhash.xxh3_64_intdigest(b"\n".join(parts), seed=len(parts))], dtype=np.uint64)
    w = hashes.of(parts)
    n = len(w) - size + 1
    h = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        h = mixed(h + w[i : i + n] * _MIX[i % len(_MIX)])
    return np.unique(h)


def exact_set(parts: list[bytes], size: int = WORDS) -> set:
    """The shingles themselves."""
    if not parts:
        return set()
    if len(parts) < size:
        return {tuple(parts)}
    return set(zip(*[parts[i:] for i in range(size)]))
