"""Whole texts to token ids in tasks, each distinct chunk given to the tokenizer library once.

A chunk begins where an ASCII space or line feed follows a character that is no white space.
The byte-level pre-tokeniser never joins across such a place, and no special string holds a
space, so the ids of a text are the ids of its chunks in order. Chunks are known by a 64-bit hash.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa

from . import textbatch as tb

#: Chunks and values that a worker keeps (some 50 MB); beyond it begins anew. What is met in one slice of texts comes on top.
KEPT_CHUNKS, KEPT_VALUES = 600_000, 4_000_000
#: Bytes of distinct chunks that the library gets as one string.
JOINED_BYTES = 1 << 16


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of chunks; after characters of which some are wide white space, none begins (that is always safe)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    begins = tb.document_starts(n, offsets)[:n]
    at = np.flatnonzero((data == 32) | (data == 10))
    begins[at[closes(data, at)]] = True
    return np.flatnonzero(begins)


def closes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Is the character before each position surely no white space?"""
    last, second, third = (np.where(at >= k, data[np.maximum(at - k, 0)], 0) for k in (1, 2, 3))
    return ((last > 32) & (last < 128)) | ((last >= 128) & (second != 0xC2) & ~((third >= 0xE1) & (third <= 0xE3)))


class ChunkCache:
    """Values (runs of numbers) of distinct chunks, looked up by hash in sorted arrays."""

    def __init__(self, evaluate: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], kept: int = KEPT_CHUNKS, kept_values: int = KEPT_VALUES):
        """``evaluate``: of joined chunks and their ends, all values and their number by chunk."""
        self.evaluate, self.kept, self.kept_values = evaluate, kept, kept_values
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.rows = np.zeros(0, np.int64)
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.held, self.used = np.zeros(1 << 16, np.int32), 0

    @property
    def flat(self) -> np.ndarray:
        return self.held[: self.used]

    def _add(self, flat: np.ndarray) -> None:
        if self.used + len(flat) > len(self.held):
            grown = np.zeros(max(2 * len(self.held), self.used + len(flat)), np.int32)
            grown[: self.used] = self.flat
            self.held = grown
        self.held[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def rows_of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each chunk its row in ``starts``, ``lengths``; good until the next call."""
        unique, first, inverse = np.unique(tb.hash_spans(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) and (len(self.keys) + len(unique) > self.kept or self.used > self.kept_values):
            self.clear()
        at = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == unique[inside]
        if not known.all():
            new = np.flatnonzero(~known)
            sizes = ends[first[new]] - starts[first[new]]
            flat, lengths = self.evaluate(data[tb.ragged(starts[first[new]], sizes)], np.cumsum(sizes))
            rows = len(self.lengths) + np.arange(len(new))
            self.starts = np.concatenate([self.starts, self.used + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self._add(flat)
            where = at[new]
            self.keys = np.insert(self.keys, where, unique[new])
            self.rows = np.insert(self.rows, where, rows)
            at = np.searchsorted(self.keys, unique)
        return self.rows[at][inverse]


_caches: dict[tuple, ChunkCache] = {}


def strings(joined: np.ndarray, ends: np.ndarray) -> list[str]:
    raw, stops = joined.tobytes(), ends.tolist()
    return [raw[a:b].decode("utf-8") for a, b in zip([0, *stops], stops)]


def flattened(values: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, values), np.int64, len(values))
    return np.fromiter((x for v in values for x in v), np.int32, int(lengths.sum())), lengths


class LibraryEncoder:
    """Ids of joined chunks by the tokenizers library (special strings as its default, none added).

    Chunks that begin with a space or line feed and end with no white space may stand side by side
    in one string; byte-level tokens have fixed byte lengths, which tell whose each id is.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library: Any = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        added = {t.content for t in self.library.get_added_tokens_decoder().values()}
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, k in vocabulary.items():
            self.n_bytes[k] = len(token.encode("utf-8")) if token in added else len(token)

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, joined: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.append(0, ends[:-1])
        fit = ((joined[starts] == 32) | (joined[starts] == 10)) & closes(joined, ends)
        fit &= ends - starts >= 4  # so that closes() looks at this chunk alone
        alone = np.flatnonzero(~fit)
        together = np.flatnonzero(fit)
        sizes = ends - starts
        order = np.concatenate([together, alone])
        run = joined[tb.ragged(starts[together], sizes[together])]
        stops = np.cumsum(sizes[together])
        cuts = np.unique(np.searchsorted(stops, np.arange(JOINED_BYTES, int(stops[-1]) if len(stops) else 0, JOINED_BYTES)))
        flat = np.fromiter((x for e in self.ids(strings(run, np.append(stops[cuts[cuts < len(stops) - 1]], len(run)))) for x in e), np.int32)
        lengths = np.diff(np.searchsorted(np.cumsum(self.n_bytes[flat]), stops, side="right"), prepend=0) if len(stops) else np.zeros(0, np.int64)
        raw = joined.tobytes()
        more, counts = flattened(self.ids([raw[starts[k] : ends[k]].decode("utf-8") for k in alone.tolist()]))
        flat, lengths = np.concatenate([flat, more]), np.concatenate([lengths, counts])
        back = np.argsort(order)
        at = np.cumsum(lengths) - lengths
        return flat[tb.ragged(at[back], lengths[back])], lengths[back]


def library_cache(path: str) -> ChunkCache:
    """A worker's cache over the tokenizers file at ``path``."""
    if ("ids", path) not in _caches:
        _caches["ids", path] = ChunkCache(LibraryEncoder(path))
    return _caches["ids", path]


def encoded(texts: pa.Array, path: str, end_id: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, end document, ids, id counts by document) for each slice; ``end_id`` closes each document."""
    cache = library_cache(path)
    for lo, hi, data, offsets in tb.text_slices(texts):
        starts = chunk_starts(data, offsets)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        rows = cache.rows_of(data, starts, ends)
        lengths = cache.lengths[rows]
        ids = cache.flat[tb.ragged(cache.starts[rows], lengths)]
        counts = tb.per_document(lengths, tb.documents_of(starts, offsets), hi - lo)
        stops = np.cumsum(counts)
        out = np.empty(len(ids) + hi - lo, np.uint32)
        closing = stops + np.arange(hi - lo)
        keep = np.ones(len(out), bool)
        keep[closing] = False
        out[keep], out[closing] = ids, end_id
        yield lo, hi, out, counts + 1
