"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct n-grams of a text's lower-cased words, each word between two spaces, known
by hashed buckets. A bucket's ratio is the log of its smoothed share among toxic training texts over
that among the others; its presence, times the ratio, is the input of a logistic regression with an
L2 penalty. Weights and ratios fold into one weight a bucket, so scoring is a sum over the distinct
buckets of a whole text. Buckets with a negligible weight are left out of the model, which is part
of fitting it and the same for every text.

Fitted on at most ``TRAINING_ROWS`` labelled documents (the smallest by a hash of their id).

Defined cases: null and empty texts have no n-gram and score by the intercept alone; repeated rows
are scored each; an empty table gives no rows; without labels of both kinds every score is the share
of toxic labels, at most 0.499; labels that are null or of documents not there are left out; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .quality import labelled

#: At most so many labelled documents are fitted on.
TRAINING_ROWS = 5_000
BITS = 18
SIZES = (4, 5, 6)
#: A slice's arrays take some hundred times its bytes, and every worker of an executor holds one.
SLICE_BYTES = 256 << 10
#: Features of texts that a step of fitting takes at a time.
_AT_ONCE = 500_000
_LATIN = np.arange(0x250, dtype=np.uint32)
_LATIN[[*range(65, 91), *range(0xC0, 0xD7), *range(0xD8, 0xDF)]] += 32
_LATIN[[c for c in range(128) if not chr(c).isalnum()]] = 32


def n_gram_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every n-gram of a slice, with repetitions."""
    spaced = np.insert(data, offsets, 32)  # a space before each document and after the last
    starts = offsets + np.arange(len(offsets))
    points = np.frombuffer(spaced.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).copy()
    at = np.cumsum((spaced & 0xC0) != 0x80)[starts] - 1
    plain = points < len(_LATIN)
    points[plain] = _LATIN[points[plain]]
    space = points == 32
    spaces = np.zeros(len(points) + 1, np.int32)
    np.cumsum(space, out=spaces[1:])
    coded = tb.mix(points.astype(np.uint64) + np.uint64(1))
    documents, buckets = [], []
    for n in SIZES:
        if len(points) < n:
            continue
        m = len(points) - n + 1
        inner = np.flatnonzero(spaces[n - 1 : n - 1 + m] == spaces[1 : 1 + m])  # spaces at the ends alone
        value = np.full(len(inner), n, np.uint64)
        for k in range(n):
            value = value * np.uint64(0x9E3779B97F4A7C15) + coded[inner + k]
        buckets.append((tb.mix(value) >> np.uint64(64 - BITS)).astype(np.int64))
        documents.append(np.searchsorted(at, inner, side="right") - 1)
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    documents, buckets = np.concatenate(documents), np.concatenate(buckets)
    return documents, buckets


def distinct_buckets(documents: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.unique((documents << BITS) | buckets)
    return keys >> BITS, keys & ((1 << BITS) - 1)


@dataclass
class Linear:
    weights: np.ndarray  # ratio times coefficient by bucket; 0 if left out
    intercept: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        documents, buckets = n_gram_buckets(data, offsets)
        counts = self.weights[buckets] != 0
        documents, buckets = distinct_buckets(documents[counts], buckets[counts])
        margin = np.bincount(documents, self.weights[buckets], len(offsets) - 1) + self.intercept
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def fit_linear(indices: list[np.ndarray], y: np.ndarray, smoothing: float = 1.0, penalty: float = 1.0, least: int = 3, telling: float = 1.2, steps: int = 60, negligible: float = 0.02) -> Linear:
    """Ratios, then logistic regression on scaled presence, by Newton steps with conjugate gradients.

    Buckets met in fewer than ``least`` texts, or with a ratio below ``telling``, are left out."""
    size = 1 << BITS
    seen, toxic = np.zeros(size), np.full(size, smoothing)
    for own, label in zip(indices, y):
        seen[own] += 1
        toxic[own] += label
    other = seen - (toxic - smoothing) + smoothing
    ratio = np.log(toxic / toxic.sum()) - np.log(other / other.sum())
    used = (seen >= least) & (np.abs(ratio) >= telling)
    code = (np.cumsum(used) - 1).astype(np.int32)
    chosen = [code[own[used[own]]] for own in indices]
    rows = np.repeat(np.arange(len(indices), dtype=np.int32), [len(c) for c in chosen])
    columns = np.concatenate(chosen)
    r = ratio[used]
    n, d = len(y), int(used.sum())
    runs = [slice(at, at + _AT_ONCE) for at in range(0, len(rows), _AT_ONCE)]

    def forward(w: np.ndarray) -> np.ndarray:
        scaled = w * r
        return sum((np.bincount(rows[c], scaled[columns[c]], n) for c in runs), np.zeros(n))

    def backward(e: np.ndarray) -> np.ndarray:
        return r * sum((np.bincount(columns[c], e[rows[c]], d) for c in runs), np.zeros(d))

    w, b = np.zeros(d), float(np.log(y.mean() / (1 - y.mean())))
    for _ in range(6):
        p = 1 / (1 + np.exp(-np.clip(forward(w) + b, -500, 500)))
        h = np.maximum(p * (1 - p), 1e-6)
        gw, gb = backward(p - y) + penalty * w, (p - y).sum()
        x, xb = np.zeros(d), 0.0
        res, res_b = -gw, -gb
        q, q_b = res.copy(), res_b
        norm = first = res @ res + res_b**2
        for _ in range(steps // 4):
            u = h * (forward(q) + q_b)
            aq, aq_b = backward(u) + penalty * q, u.sum()
            alpha = norm / max(q @ aq + q_b * aq_b, 1e-300)
            x, xb = x + alpha * q, xb + alpha * q_b
            res, res_b = res - alpha * aq, res_b - alpha * aq_b
            new = res @ res + res_b**2
            if new < 1e-4 * first:
                break
            q, q_b, norm = res + new / norm * q, res_b + new / norm * q_b, new
        w, b = w + x, b + xb
    folded = w * r
    folded[np.abs(folded) < negligible] = 0
    weights = np.zeros(size)
    weights[used] = folded
    margin = forward(folded / np.where(r == 0, 1, r))
    for _ in range(25):  # the intercept that fits the weights that stayed
        p = 1 / (1 + np.exp(-np.clip(margin + b, -500, 500)))
        b -= (p - y).sum() / max((p * (1 - p)).sum(), 1e-6)
        b = float(np.clip(b, -50, 50))
    return Linear(weights, b)


def fit(docs: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS, id_column: str = "doc_id", text_column: str = "text") -> Linear:
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in tb.text_slices(batch.column(1), SLICE_BYTES):
                documents, buckets = distinct_buckets(*n_gram_buckets(data, offsets))
                parts = np.split(buckets.astype("<u4"), np.searchsorted(documents, np.arange(1, hi - lo)))
                yield pa.record_batch([batch.column(0)[lo:hi], batch.column(2)[lo:hi], pa.array([x.tobytes() for x in parts], pa.binary())], names=["doc_id", "label", "x"])

    found = labelled(docs, labels, "toxic", limit, id_column, text_column).mapInArrow(features, "doc_id long, label int, x binary")
    rows = found.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(limit).toArrow()  # bounded though ids may repeat
    y = rows.column("label").to_numpy().astype(float)
    if len(y) == 0 or y.min() == y.max():
        share = min(float(y.mean()) if len(y) else 0.0, 0.499)
        return Linear(np.zeros(1 << BITS), float(np.log((share + 1e-9) / (1 - share))))
    return fit_linear([np.frombuffer(x.as_buffer(), "<u4") for x in rows.column("x")], y)


def score(docs: DataFrame, model: Linear, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in tb.text_slices(batch.column(1), SLICE_BYTES):
                scores = shared.value.scores(data, offsets)
                yield pa.record_batch([batch.column(0)[lo:hi], pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")


def clean_rows(docs: DataFrame, model: Linear, text_column: str = "text") -> DataFrame:
    """The rows, with all their columns, that are not predicted to be toxic; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_column)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in tb.text_slices(batch.column(at), SLICE_BYTES):
                yield batch.slice(lo, hi - lo).filter(pa.array(shared.value.scores(data, offsets) < 0.5))

    return docs.mapInArrow(keep, docs.schema)


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels outside the held-out fifth: crc32 of the id's text, modulo 5, is not 0."""
    return labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
