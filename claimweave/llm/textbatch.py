"""Numpy kernels over Arrow string batches: spans, 64-bit span hashes, ragged gathers.

A batch of texts is one byte buffer with document offsets. Null texts count as empty.
Work goes in slices of whole documents so that memory follows the slice, not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_libc = ctypes.CDLL(None)
_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)
_powers = {k: np.ones(1, np.uint64) for k in (_PRIME, _INVERSE)}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_PRIME))
_fold = np.arange(256)
_fold[65:91] += 32
#: Byte values under which A-Z and a-z are one.
_BYTE_LOWER = _BYTE[_fold]
#: The separators of words: space and 0x09 to 0x0D.
SEPARATOR = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def powers(base: int, n: int) -> np.ndarray:
    have = _powers[base]
    if len(have) < n:
        fresh = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        fresh[0] = 1
        _powers[base] = have = np.multiply.accumulate(fresh)
    return have[:n]


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets (n + 1) of a string array, without copying where none is null."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.type not in (pa.string(), pa.large_string()):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32 if texts.type == pa.string() else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole documents with about ``limit`` bytes each; a longer document stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, end document, bytes, offsets from 0) for each slice of a batch."""
    data, offsets = text_buffer(texts)
    for lo, hi in slices(offsets, limit):
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
    released()


def released() -> None:
    """Gives back to the system what Arrow and numpy have freed: a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(_libc, "malloc_trim", None):
        trim(0)


def mapped_apart(least: int = 1 << 20) -> None:
    """From now on this process gets arrays of ``least`` bytes and more from the system and gives them back once freed, and
    its threads share two heaps: memory follows what is in use, not the sizes that were."""
    if tune := getattr(_libc, "mallopt", None):
        tune(-3, least)  # M_MMAP_THRESHOLD, which else rises with what is freed
        tune(-8, 2)  # M_ARENA_MAX


def document_starts(n_bytes: int, offsets: np.ndarray) -> np.ndarray:
    flags = np.zeros(n_bytes + 1, bool)
    flags[offsets] = True
    return flags


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document indices of all runs of bytes that are no separators."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~separator[data]
    edge = document_starts(len(data), offsets)
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, documents_of(starts, offsets)


def documents_of(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets, positions, side="right") - 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of byte spans: a polynomial in table values, shifted to the span's start, length added, mixed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(data)
    terms = np.zeros(n + 1, np.uint64)
    np.multiply((_BYTE_LOWER if lower else _BYTE)[data], powers(_PRIME, n), out=terms[:n])
    cuts = np.empty(2 * len(starts), np.int64)
    cuts[0::2], cuts[1::2] = starts, ends
    sums = np.add.reduceat(terms, cuts)[0::2]
    empty = starts == ends
    if empty.any():
        sums[empty] = 0
    sums *= powers(_INVERSE, n + 1)[starts]
    return mix(sums + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... for each (start, length), concatenated."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.arange(total, dtype=np.int64)
    out += np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return out


def per_document(values: np.ndarray, documents: np.ndarray, n: int) -> np.ndarray:
    """Sums of integer values by document."""
    return np.bincount(documents, weights=values, minlength=n).astype(np.int64) if len(values) else np.zeros(n, np.int64)
