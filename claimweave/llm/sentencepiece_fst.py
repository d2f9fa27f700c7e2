"""SentencePiece encoding and decoding as shortest paths through a weighted transducer.

The compiled machine has three parts. The normaliser rewrites the longest match of its character map,
or copies a character, then escapes white space. The pieces map strings to ids, with minus their score
as weight. Byte fallback maps any character without a piece to its bytes' ids. Composed with an input,
they give a lattice of states (position, last piece), and the tropical-semiring shortest path to the
end is the encoding. For unigram models the last piece doesn't matter. For BPE models a piece pair
acceptor is composed in: two pieces may stand side by side only if merging their characters gives
just these two, which has weight 0, and else infinity; one path is left, and it is what merging gives.

Pieces never go on with white space after another character (compiling checks it), so a text is the
row of its chunks, white space first; each distinct chunk is solved once in a worker, and chunks share
the states of their common prefixes.

Defined cases: a null text counts as empty, with no id; documents with one id stay apart; a null id
stays null; an empty table gives no rows; other columns are not read; texts of any length are whole.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .tokenizing import ChunkCache, chunk_starts, flattened, strings

SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
KEPT_PREFIXES, KEPT_CHUNKS, LONG_CHUNK = 300_000, 600_000, 64
#: Rows that a task decodes at a time.
_ROWS = 512


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, raw[at : at + size]
            at += size


class Normaliser:
    """The character map, prefix and white-space rules of a model."""

    def __init__(self, spec: bytes):
        given = dict(fields(spec))
        self.prefix, self.squeeze, self.escape = (bool(given.get(k, 1)) for k in (3, 4, 5))
        self.rules: dict[str, str] = {}
        if blob := given.get(2, b""):
            size = struct.unpack_from("<I", blob)[0]
            self.rules = self._rules(np.frombuffer(blob[4 : 4 + size], "<u4").tolist(), blob[4 + size :])
        self.longest = max(map(len, self.rules), default=0)

    @staticmethod
    def _rules(units: list[int], texts: bytes) -> dict[str, str]:
        """All keys of the double-array trie, with their replacements."""
        rules, stack = {}, [(0, b"")]
        offset = lambda unit: (unit >> 10) << ((unit & (1 << 9)) >> 6)
        while stack:
            node, key = stack.pop()
            base = node ^ offset(units[node])
            if units[node] >> 8 & 1:
                at = units[base] & ((1 << 31) - 1)
                rules[key.decode("utf-8", "ignore")] = texts[at : texts.index(b"\0", at)].decode("utf-8")
            for c in range(1, 256):
                child = base ^ c
                if child < len(units) and units[child] & ((1 << 31) | 0xFF) == c:
                    stack.append((child, key + bytes([c])))
        return rules

    def __call__(self, text: str | None) -> str:
        """The normalised text, white space still as spaces."""
        text = text or ""
        if self.rules:
            out, at = [], 0
            while at < len(text):
                for size in range(min(self.longest, len(text) - at), 0, -1):
                    if (found := self.rules.get(text[at : at + size])) is not None:
                        out.append(found)
                        at += size
                        break
                else:
                    out.append(text[at])
                    at += 1
            text = "".join(out)
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        return " " + text if self.prefix and text else text


class Machine:
    """The compiled transducer of a model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            parts = list(fields(f.read()))
        trainer = dict(fields(next(v for k, v in parts if k == 2)))
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.normaliser = Normaliser(next((v for k, v in parts if k == 3), b""))
        if not self.normaliser.escape:
            raise ValueError("only models that escape white space are supported")
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes_of: list[bytes] = []
        self.byte_ids = [-1] * 256
        self.unknown = 0
        for k, raw in enumerate(v for number, v in parts if number == 1):
            piece = dict(fields(raw))
            text, kind = piece[1].decode("utf-8"), piece.get(3, NORMAL)
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            self.bytes_of.append(b"" if kind == CONTROL else text.replace(SPACE, " ").encode("utf-8"))
            if kind in (NORMAL, USER):
                self.ids[text], self.scores[text] = k, score
            elif kind == BYTE:
                value = int(text[3:5], 16)
                self.byte_ids[value], self.bytes_of[k] = k, bytes([value])
            elif kind == UNKNOWN:
                self.unknown, self.bytes_of[k] = k, " ⁇ ".encode()
            if kind == USER:
                raise ValueError("models with user-defined pieces are not supported")
        if any(SPACE in t.lstrip(SPACE) for t in self.ids):
            raise ValueError("a piece holds white space after another character")
        self.worst = max((-s for s in self.scores.values()), default=0.0) + 10.0
        self.lengths: dict[str, tuple[int, ...]] = {}
        for size in sorted({len(t) for t in self.ids}):
            for tail in {t[-2:] for t in self.ids if len(t) == size}:
                self.lengths[tail] = (size, *self.lengths.get(tail, ()))
        self.lengths = {tail: (*(s for s in sizes if s > 1), 1) for tail, sizes in self.lengths.items()}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.states: dict[str, tuple[float, str]] = {}

    def merged(self, text: str) -> list[str]:
        """What merging gives: the best-scored neighbours first, the left ones first among equals."""
        parts = list(text)
        while len(parts) > 1:
            scores = [self.scores.get(a + b, -np.inf) for a, b in zip(parts, parts[1:])]
            best = max(range(len(scores)), key=scores.__getitem__)
            if scores[best] == -np.inf:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def weight(self, last: str, piece: str) -> float:
        """The weight of ``piece`` after ``last``."""
        if self.kind == UNIGRAM:
            return -self.scores[piece] if piece in self.scores else self.worst
        known = self.pairs.get((last, piece))
        if known is None:
            if len(self.pairs) > KEPT_PREFIXES:
                self.pairs.clear()
            known = self.pairs[last, piece] = self.merged(last + piece) == ([last, piece] if last else [piece])
        return 0.0 if known else np.inf

    def path(self, chunk: str) -> list[int]:
        """Ids of the shortest path through an escaped chunk; short chunks share the states of their prefixes."""
        short = len(chunk) <= LONG_CHUNK
        if len(self.states) > KEPT_PREFIXES:
            self.states.clear()
        ids, lengths, pairs, merging = self.ids, self.lengths, self.pairs, self.kind == BPE
        cost, pieces = [0.0], [""]
        for end in range(1, len(chunk) + 1):
            best = self.states.get(chunk[:end]) if short else None
            if best is None:
                best = (np.inf, "")
                for size in lengths.get(chunk[max(end - 2, 0) : end], (1,)):
                    if size > end:
                        continue
                    piece = chunk[end - size : end]
                    if size > 1 and piece not in ids:
                        continue
                    last = pieces[end - size]
                    known = pairs.get((last, piece)) if merging else None
                    weight = (0.0 if known else np.inf) if known is not None else cost[end - size] + self.weight(last, piece)
                    if weight < best[0]:
                        best = (weight, piece)
                        if merging:  # the only one
                            break
                if short:
                    self.states[chunk[:end]] = best
            cost.append(best[0])
            pieces.append(best[1])
        out, at = [], len(chunk)
        while at:
            piece = pieces[at]
            if piece in self.ids:
                out.append(self.ids[piece])
            else:
                found = [self.byte_ids[b] for b in piece.encode("utf-8")]
                out.extend(reversed(found) if -1 not in found else [self.unknown])
            at -= len(piece)
        return out[::-1]

    def decode(self, ids: np.ndarray) -> bytes:
        text = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        return text[1:] if self.normaliser.prefix and text[:1] == b" " else text


_machines: dict[str, tuple[Machine, ChunkCache]] = {}


def machine(path: str) -> tuple[Machine, ChunkCache]:
    """A worker's machine and its cache of chunks."""
    if path not in _machines:
        made = Machine(path)

        def solve(joined: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return flattened([made.path(c.replace(" ", SPACE)) for c in strings(joined, ends)])

        _machines[path] = made, ChunkCache(solve, KEPT_CHUNKS)
    return _machines[path]


def _encoded(batch: pa.RecordBatch, path: str) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """Row ids and token ids of the rows (id, text) of a batch, some rows at a time."""
    made, cache = machine(path)
    for first, end in tb.slices(tb.text_buffer(batch.column(1))[1]):  # as many rows as a slice of bytes holds
        part = batch.slice(first, end - first)
        texts = pa.array(map(made.normaliser, part.column(1).to_pylist()), pa.large_string())
        for lo, hi, data, offsets in tb.text_slices(texts):
            starts = chunk_starts(data, offsets)
            rows = cache.rows_of(data, starts, np.append(starts[1:], len(data)) if len(starts) else starts)
            lengths = cache.lengths[rows]
            ids = cache.flat[tb.ragged(cache.starts[rows], lengths)].astype("<u4")
            stops = np.cumsum(tb.per_document(lengths, tb.documents_of(starts, offsets), hi - lo))
            yield part.column(0)[lo:hi], np.split(ids, stops[:-1])


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and ids (little-endian unsigned 32 bits) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_ids, ids in _encoded(batch, path):
                yield pa.record_batch([doc_ids, pa.array([x.tobytes() for x in ids], pa.binary())], names=["doc_id", "ids"])

    return _rows(docs, id_column, text_column).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the text of rows (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, _ = machine(path)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                texts = [made.decode(np.frombuffer(x.as_buffer(), "<u4")).decode("utf-8", "replace") if x.is_valid else None for x in part.column(1)]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def round_trip(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, ids, and the text that these decode to, in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, _ = machine(path)
        for batch in batches:
            for doc_ids, ids in _encoded(batch, path):
                texts = [made.decode(x).decode("utf-8", "replace") for x in ids]
                yield pa.record_batch([doc_ids, pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return _rows(docs, id_column, text_column).mapInArrow(run, "doc_id long, ids binary, text string")


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())
