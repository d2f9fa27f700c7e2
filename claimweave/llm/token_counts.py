"""Exact token counts at every prefix of a text, by dynamic programming over byte-pair tokens.

Byte-pair encoding is decided by neighbours: a row of tokens is an encoding if, and only if, each
two in a row encode to themselves. So the encoding of a chunk's prefix of i bytes ends in the one
token t whose predecessor, the last token of the prefix of i - len(t) bytes, stands with it; its
count is that prefix's count plus one. One pass gives the count at every prefix, which answers
"how many tokens has this" and "where does a budget end" without encoding again.

Chunks (see ``tokenizing``) are independent, so a text's counts are sums over its chunks. Each
worker solves each distinct chunk once.

Defined cases: a null text counts as empty, with no token; special strings inside texts are one
token each, as the library takes them by default; documents with one id stay apart; an empty table
yields no row; other columns are not read; texts of any length go by slices, never by prefixes.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .tokenizing import ChunkCache, chunk_starts, flattened, strings

#: Fixed value: the published pattern that splits text before byte-level merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What a worker keeps of prefixes and of neighbours; beyond it begins anew, so its memory stays bounded.
KEPT_PREFIXES = 600_000
#: A longer word (in bytes) is solved without keeping its prefixes.
LONG_WORD = 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class PrefixCounter:
    """Prefix counts of words (pre-tokens) for the byte-level BPE file at ``path``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("ignore_merges") or spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("only byte-level BPE without a normaliser or added prefix is supported")
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        raw = lambda token: bytes(byte_of[c] for c in token)
        self.ids: dict[bytes, int] = {raw(t): i for t, i in model["vocab"].items() if t not in special}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pattern = regex.compile(PATTERN)
        self.stands: dict[tuple[bytes, bytes], bool] = {}
        #: The lengths of the tokens that end in two given bytes, or are one given byte.
        self.lengths: dict[bytes, list[int]] = {}
        for size in sorted({len(t) for t in self.ids}):
            for tail in {t[-2:] for t in self.ids if len(t) == size}:
                self.lengths.setdefault(tail, []).append(size)
        #: Of each prefix met so far, the last token and the count: words share prefixes.
        self.prefixes: dict[bytes, tuple[bytes, int]] = {b"": (b"", 0)}

    def merged(self, word: bytes) -> list[bytes]:
        """The merges' own result for a short word."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def fits(self, left: bytes, right: bytes) -> bool:
        """Do these two tokens stand side by side in an encoding?"""
        key = (left, right)
        if (known := self.stands.get(key)) is None:
            if len(self.stands) > KEPT_PREFIXES:
                self.stands.clear()
            known = self.stands[key] = self.merged(left + right) == ([left, right] if left else [right])
        return known

    def prefix_counts(self, word: bytes) -> list[int]:
        """Counts of the encodings of word[:1], word[:2], ..., word."""
        if len(self.prefixes) > KEPT_PREFIXES:
            self.prefixes = {b"": (b"", 0)}
        if len(word) > LONG_WORD:
            return self._long(word)
        prefixes, counts = self.prefixes, []
        for end in range(1, len(word) + 1):
            prefix = word[:end]
            state = prefixes.get(prefix)
            if state is None:
                state = prefixes[prefix] = self._step(word, end, lambda begin: prefixes[word[:begin]])
            counts.append(state[1])
        return counts

    def _long(self, word: bytes) -> list[int]:
        """The same for a long word, whose prefixes aren't worth keeping."""
        longest = max(map(len, self.ids))
        states: dict[int, tuple[bytes, int]] = {0: (b"", 0)}
        counts = []
        for end in range(1, len(word) + 1):
            states[end] = self._step(word, end, states.__getitem__)
            states.pop(end - longest, None)
            counts.append(states[end][1])
        return counts

    def _step(self, word: bytes, end: int, state: Callable[[int], tuple[bytes, int]]) -> tuple[bytes, int]:
        ids = self.ids
        for size in (1, *self.lengths.get(word[end - 2 : end], ())) if end > 1 else (1,):
            begin = end - size
            if begin < 0:
                break
            token = word[begin:end]
            if token in ids:
                last, count = state(begin)
                if self.fits(last, token):
                    return token, count + 1
        raise ValueError("no token ends here")

    def chunk_prefixes(self, chunk: str) -> list[int]:
        """Counts after each byte of a chunk; within a special string the count is that of its start."""
        out, total, at = [], 0, 0
        specials = self.special.finditer(chunk) if self.special else ()
        for match in [*specials, None]:
            for word in self.pattern.findall(chunk[at : match.start() if match else len(chunk)]):
                counts = self.prefix_counts(word.encode("utf-8"))
                out.extend([total + c for c in counts] if total else counts)
                total += counts[-1]
            if match:
                out.extend([total] * (len(match[0].encode("utf-8")) - 1) + [total + 1])
                total, at = total + 1, match.end()
        return out


_caches: dict[str, tuple[PrefixCounter, ChunkCache]] = {}


def prefix_cache(path: str) -> ChunkCache:
    """A worker's cache of chunks' prefix counts."""
    if path not in _caches:
        counter = PrefixCounter(path)
        _caches[path] = counter, ChunkCache(lambda joined, ends: flattened([counter.chunk_prefixes(c) for c in strings(joined, ends)]))
    return _caches[path][1]


def prefix_counts(text: str | None, path: str) -> np.ndarray:
    """The token count at every byte prefix of one text."""
    data, offsets = tb.text_buffer(pa.array([text], pa.string()))
    cache = prefix_cache(path)
    starts = chunk_starts(data, offsets)
    rows = cache.rows_of(data, starts, np.append(starts[1:], len(data)) if len(starts) else starts)
    lengths = cache.lengths[rows]
    totals = np.where(lengths > 0, cache.flat[np.maximum(cache.starts[rows] + lengths - 1, 0)], 0)
    return cache.flat[tb.ragged(cache.starts[rows], lengths)] + np.repeat(np.cumsum(totals) - totals, lengths)


def count_tokens(docs: DataFrame, path: str, budget: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and budget_bytes: the bytes of the longest prefix of whole
    characters that has at most ``budget`` tokens by the chunks' prefix counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = prefix_cache(path)
        for batch in batches:
            for lo, hi, data, offsets in tb.text_slices(batch.column(1)):
                starts = chunk_starts(data, offsets)
                rows = cache.rows_of(data, starts, np.append(starts[1:], len(data)) if len(starts) else starts)
                lengths = cache.lengths[rows]
                totals = cache.flat[cache.starts[rows] + lengths - 1].astype(np.int64) if len(rows) else lengths
                owners = tb.documents_of(starts, offsets)
                n_tokens = tb.per_document(totals, owners, hi - lo)
                fit = np.diff(offsets).copy()
                if len(rows):
                    before = np.cumsum(totals) - totals
                    firsts = np.searchsorted(owners, np.arange(hi - lo))
                    for d in np.flatnonzero(n_tokens > budget).tolist():
                        first, stop = firsts[d], firsts[d + 1] if d + 1 < hi - lo else len(rows)
                        k = first + int(np.searchsorted(before[first:stop] - before[first], budget, side="right")) - 1
                        run = cache.flat[cache.starts[rows[k]] : cache.starts[rows[k]] + lengths[k]]
                        end = starts[k] + int(np.flatnonzero(run <= budget - (before[k] - before[first]))[-1] + 1 if (run <= budget - (before[k] - before[first])).any() else 0)
                        while end < offsets[d + 1] and data[end] & 0xC0 == 0x80:
                            end -= 1
                        fit[d] = end - offsets[d]
                yield pa.record_batch([batch.column(0)[lo:hi], pa.array(np.diff(offsets)), pa.array(n_tokens), pa.array(n_tokens > budget), pa.array(fit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "budget_bytes"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, budget_bytes long")
