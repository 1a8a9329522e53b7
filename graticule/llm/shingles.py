"""Words and word shingles of whole texts as 64-bit hashes, for use inside Arrow batches."""
from __future__ import annotations

import numpy as np
import xxhash

CACHE = 1 << 17  # words kept per Python worker
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = _WordHashes()


def words(text: str | None) -> list[bytes]:
    """Maximal runs without the white space of ASCII, A-Z lower-cased: what bytes.split and bytes.lower do."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; the whole sequence if it has fewer words; empty without words."""
    w = words(text)
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, w), np.uint64, len(w))
    n = min(k, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        out = out + h[j: len(h) - n + 1 + j] * _FACTORS[j % 8]
    out = np.sort(mixed(out))
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def digest(grams: np.ndarray) -> int:
    """64-bit identity of a set of shingles, as a signed long."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes())).astype(np.int64))
