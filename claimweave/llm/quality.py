"""Quality rules: fixed base rules, then gradient-boosted trees over document statistics.

The trees are fitted here, on at most ``TRAINING_ROWS`` labelled documents (the smallest by a hash
of their id), with logistic loss over quantile bins. Chosen features are monotonic: more symbols,
repeated lines or repeated words never make a document look better. All trees lie in flat numpy
arrays (feature, threshold, left, right, value), and a batch walks each level of a tree at once.

Words are runs without space and 0x09 to 0x0D. Base statistics: see ``STATISTICS``; a document
fails the base rules with fewer than 50 words, or if more than half of its words lie in three-word
windows found twice or more.

Defined cases: a null text has no words and fails; repeated rows are judged each; a null id stays
null; an empty table gives no rows; without labels of both kinds the base rules decide alone;
labels that are null, or of documents not there, are left out; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb

#: At most so many labelled documents are fitted on.
TRAINING_ROWS = 20_000
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbol_share", "duplicate_lines", "repeated_words", "upper_share", "digit_share", "mark_share", "line_words", "distinct_words", "marked_words")
#: For these, the score of being bad never falls as the feature rises.
RISING = ("symbol_share", "duplicate_lines", "repeated_words", "marked_words")
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LETTER = _UPPER | ((np.arange(256) >= 97) & (np.arange(256) <= 122))
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_MARK = (np.arange(256) > 32) & (np.arange(256) < 127) & ~_LETTER & ~_DIGIT


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return np.diff(total[offsets])


def _counts(documents: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(documents, minlength=n).astype(np.int64)


def _repeats(values: np.ndarray, documents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value: how often it comes in its document, and whether it stands first among its equals."""
    keyed = tb.mix(values + documents.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    _, first, inverse, counts = np.unique(keyed, return_index=True, return_inverse=True, return_counts=True)
    is_first = np.zeros(len(values), bool)
    is_first[first] = True
    return counts[inverse], is_first


def statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Base statistics and the trees' features of the documents of a slice."""
    n = len(offsets) - 1
    starts, ends, owners = tb.word_spans(data, offsets)
    n_words = _counts(owners, n)
    points = (data & 0xC0) != 0x80
    word_chars = _sums(points & ~tb.SEPARATOR[data], offsets)
    n_symbols = _sums(_SYMBOL[data], offsets)

    hashes = tb.hash_spans(data, starts, ends)
    in_repeat = np.zeros(len(hashes), bool)
    if len(hashes) > 2:
        whole = np.flatnonzero(owners[:-2] == owners[2:])
        a, b, c = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
        windows = hashes[whole] * a + tb.mix(hashes[whole + 1] * b) + tb.mix(hashes[whole + 2] ^ c) * c
        again = whole[_repeats(windows, owners[whole])[0] > 1]
        for k in range(3):
            in_repeat[again + k] = True
    n_repeat_words = _counts(owners[in_repeat], n)
    distinct = _counts(owners[_repeats(hashes, owners)[1]], n) if len(hashes) else np.zeros(n, np.int64)
    marked = _counts(owners[_MARK[data[np.maximum(ends - 1, 0)]] & _MARK[data[np.maximum(ends - 2, 0)]]], n) if len(ends) else np.zeros(n, np.int64)

    breaks = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
    line_starts = line_starts[line_starts < len(data)]
    line_starts = line_starts[data[line_starts] != 10]  # not the empty ones
    stop_at = np.unique(np.concatenate([breaks, offsets[1:]]))
    line_ends = stop_at[np.searchsorted(stop_at, line_starts, side="right")] if len(line_starts) else line_starts
    words_before = np.searchsorted(starts, line_starts), np.searchsorted(starts, line_ends)
    spoken = words_before[1] > words_before[0]
    line_owner = tb.documents_of(line_starts[spoken], offsets)
    line_hash = tb.hash_spans(data, line_starts[spoken], line_ends[spoken])
    n_lines = _counts(line_owner, n)
    n_dup_lines = n_lines - _counts(line_owner[_repeats(line_hash, line_owner)[1]], n) if len(line_hash) else np.zeros(n, np.int64)

    base = dict(zip(STATISTICS, (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)))
    some = np.maximum(n_words, 1)
    letters = np.maximum(_sums(_LETTER[data], offsets), 1)
    chars = np.maximum(word_chars, 1)
    features = np.column_stack([
        np.log1p(n_words), word_chars / some, n_symbols / chars, n_dup_lines / np.maximum(n_lines, 1), n_repeat_words / some,
        _sums(_UPPER[data], offsets) / letters, _sums(_DIGIT[data], offsets) / chars, _sums(_MARK[data], offsets) / chars,
        n_words / np.maximum(n_lines, 1), distinct / np.sqrt(some), marked / some,
    ])
    return base, features


def base_failed(base: dict[str, np.ndarray]) -> np.ndarray:
    return (base["n_words"] < 50) | (100 * base["n_repeat_words"] > 50 * base["n_words"])


@dataclass
class Trees:
    """All nodes of all trees: a leaf is its own child, with its value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out += self.value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit_trees(x: np.ndarray, y: np.ndarray, signs: np.ndarray, n_trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: float = 5.0, penalty: float = 1.0) -> Trees:
    """Boosted trees on ``y`` (0 or 1); ``signs`` is 1 for features under which the margin never falls."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)])
    rate_of = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    start = float(np.log(rate_of / (1 - rate_of)))
    margin = np.full(len(y), start)
    nodes: list[list[float]] = []
    roots = []

    def weight(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + penalty), low, high))

    def grow(rows: np.ndarray, level: int, low: float, high: float, g: np.ndarray, h: np.ndarray) -> int:
        at = len(nodes)
        gs, hs = g[rows].sum(), h[rows].sum()
        nodes.append([0, np.inf, at, at, rate * weight(gs, hs, low, high)])
        if level == depth or len(rows) < 2 * least:
            return at
        best = (1e-6, -1, -1, 0.0)
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            gl = np.cumsum(np.bincount(binned[rows, f], g[rows], len(c) + 1))[:-1]
            hl = np.cumsum(np.bincount(binned[rows, f], h[rows], len(c) + 1))[:-1]
            nl = np.cumsum(np.bincount(binned[rows, f], minlength=len(c) + 1))[:-1]
            gain = gl**2 / (hl + penalty) + (gs - gl) ** 2 / (hs - hl + penalty) - gs**2 / (hs + penalty)
            gain[(nl < least) | (len(rows) - nl < least)] = -1
            if signs[f]:
                gain[np.clip(-gl / (hl + penalty), low, high) > np.clip(-(gs - gl) / (hs - hl + penalty), low, high)] = -1
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                left, right = weight(gl[k], hl[k], low, high), weight(gs - gl[k], hs - hl[k], low, high)
                best = (float(gain[k]), f, k, (left + right) / 2)
        _, f, k, middle = best
        if f < 0:
            return at
        goes_left = binned[rows, f] <= k
        bounds = ((low, middle), (middle, high)) if signs[f] else ((low, high), (low, high))
        nodes[at][0], nodes[at][1] = f, float(cuts[f][k])
        nodes[at][2] = grow(rows[goes_left], level + 1, *bounds[0], g, h)
        nodes[at][3] = grow(rows[~goes_left], level + 1, *bounds[1], g, h)
        return at

    def flat() -> Trees:
        a = np.array(nodes, float).reshape(-1, 5)
        return Trees(a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4], np.array(roots, int), depth, start)

    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        roots.append(len(nodes))
        grow(np.arange(len(y)), 0, -np.inf, np.inf, p - y, np.maximum(p * (1 - p), 1e-9))
        one = flat()
        one.roots, one.start = one.roots[-1:], 0.0
        margin += one.margin(x)
    return flat()


def labelled(docs: DataFrame, labels: DataFrame, label: str, limit: int, id_column: str, text_column: str) -> DataFrame:
    """At most ``limit`` documents (doc_id, text, label) with labels 0 or 1, the smallest by a hash of the id."""
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    # ``limit`` rows of two numbers: small enough for every executor.
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return texts.join(F.broadcast(some), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS, id_column: str = "doc_id", text_column: str = "text") -> Trees | None:
    """Trees for the probability that quality is 0, or None without labels of both kinds."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in tb.text_slices(batch.column(1)):
                _, x = statistics(data, offsets)
                yield pa.record_batch([batch.column(0)[lo:hi], batch.column(2)[lo:hi], pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    measured = labelled(docs, labels, "quality", limit, id_column, text_column).mapInArrow(measure, "doc_id long, label int, x array<double>")
    rows = measured.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(limit).toArrow()  # bounded though ids may repeat
    y = 1.0 - rows.column("label").to_numpy()
    if len(y) == 0 or y.min() == y.max():
        return None
    x = np.array(rows.column("x").to_pylist(), float)
    return fit_trees(x, y, np.array([f in RISING for f in FEATURES]))


def judge(docs: DataFrame, trees: Trees | None, threshold: float = 0.5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, the base statistics, base_failed, bad_score (by the trees) and kept of every row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in tb.text_slices(batch.column(1)):
                base, x = statistics(data, offsets)
                failed = base_failed(base)
                bad = trees.probability(x) if trees is not None else np.zeros(hi - lo)
                yield pa.record_batch([batch.column(0)[lo:hi], *(pa.array(base[k]) for k in STATISTICS), pa.array(failed), pa.array(bad), pa.array(~failed & (bad < threshold))], names=["doc_id", *STATISTICS, "base_failed", "bad_score", "kept"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, " + ", ".join(f"{k} long" for k in STATISTICS) + ", base_failed boolean, bad_score double, kept boolean")


def kept_rows(docs: DataFrame, trees: Trees | None, threshold: float = 0.5, text_column: str = "text") -> DataFrame:
    """The rows, with all their columns, that ``judge`` keeps; no shuffle, as each batch is filtered where it lies."""
    at = docs.columns.index(text_column)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in tb.text_slices(batch.column(at)):
                base, x = statistics(data, offsets)
                good = ~base_failed(base)
                if trees is not None:
                    good &= trees.probability(x) < threshold
                yield batch.slice(lo, hi - lo).filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)
