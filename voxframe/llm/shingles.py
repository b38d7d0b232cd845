"""Words and hashed word shingles of one text, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 5
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64: every bit of the result hangs on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; fewer words are one shingle, none an empty set.

    A-Z count as a-z; words stand between ASCII white space (space and tab to carriage return).
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    hashed = np.fromiter(map(digest, words), np.uint64, len(words))
    n = max(len(words) - SHINGLE + 1, 1)
    total = np.full(n, min(len(words), SHINGLE), np.uint64)
    for k in range(min(SHINGLE, len(words))):
        total += mixed(hashed[k : k + n] + np.uint64(k)) * _ODD[k]
    return np.unique(mixed(total))
