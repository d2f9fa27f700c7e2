"""Sets of distinct five-word shingles as 64-bit hashes, by document."""

from __future__ import annotations

import numpy as np

from . import textbatch as tb

WORDS = 5
_STEPS = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """A sorted array for each document of a slice: its distinct shingles; with one to four words, one
    shingle of them all; without words none. Words are lower-cased by A-Z only."""
    n = len(offsets) - 1
    starts, ends, owners = tb.word_spans(data, offsets)
    hashes = tb.hash_spans(data, starts, ends, lower=True)
    counts = np.bincount(owners, minlength=n) if len(owners) else np.zeros(n, np.int64)
    firsts = np.cumsum(counts) - counts
    m = max(len(hashes) - WORDS + 1, 0)
    whole = np.zeros(m, np.uint64)
    for k in range(WORDS if m else 0):
        whole += hashes[k : k + m] * _STEPS[k]
    whole = tb.mix(whole)
    sets = []
    for first, count in zip(firsts.tolist(), counts.tolist()):
        if count >= WORDS:
            own = np.sort(whole[first : first + count - WORDS + 1])
            fresh = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=fresh[1:])
            sets.append(own[fresh])
        elif count:
            value = np.full(1, count, np.uint64)
            for k in range(count):
                value += hashes[first + k : first + k + 1] * _STEPS[k]
            sets.append(tb.mix(value))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 75 * union, neither empty."""
    if not len(a) or not len(b):
        return False
    return 4 * (common := shared(a, b)) >= 3 * (len(a) + len(b) - common)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())
