"""Filters in every order: what each removes, alone, after others, and on average over all orders.

One pass over the texts gives each document the set of filters that it fails, as a mask. Documents are
counted by part and mask, and all figures of a part follow from these counts, at most 2^k of them.

With x_i the share at which filter i is applied, independently of the others, a part's expected removals are
a polynomial that is linear in each x_i, the multilinear extension of the removals of a set of filters:

    r(x) = sum over masks m of n_m * (1 - product over i in m of (1 - x_i))

Its coefficient at a set T is (-1)^(|T|+1) times the documents that fail all of T. The partial derivative in x_i,
integrated along the diagonal from 0 to 1 in exact rationals, is the filter's Shapley value; times k! it is the sum
of its removals over all orders. At corners, where each x_i is 0 or 1, r counts what a set of filters removes: the
difference of two corners is what a step of an order removes, the total less a corner is what survives.

Defined cases of ``failures``: a null text is empty; a null part is the empty string; documents with equal texts are
copies of the one with the smallest id (rows that repeat an id with one text are no copies of each other; a row
with a null id neither is a copy nor has one); a document with several labels has each of them; labels that are null or
of other documents don't count; an empty table has no part, so no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .storage import stored

#: The filters, in the order of their bits: few words, few distinct words, capitals, symbols, copies.
FILTERS = "ABCDE"
_CAPITAL = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#$%&*|", np.uint8))


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return np.diff(total[offsets])


def text_failures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Masks of the filters A to D for the documents of a slice."""
    n = len(offsets) - 1
    starts, ends, owners = tb.word_spans(data, offsets)
    words = np.bincount(owners, minlength=n)
    hashes = tb.hash_spans(data, starts, ends)
    order = np.lexsort((hashes, owners))
    hashes, sorted_owners = hashes[order], owners[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (sorted_owners[1:] != sorted_owners[:-1])
    distinct = np.bincount(sorted_owners[fresh], minlength=n)
    fails = (
        words < 50,
        100 * distinct < 65 * words,
        100 * _sums(_CAPITAL[data], offsets) > 5 * _sums((data & 0xC0) != 0x80, offsets),
        _sums(_SYMBOL[data], offsets) > 0,
    )
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def _measured(docs: DataFrame, part_column: str) -> DataFrame:
    """(doc_id, part, text_mask, digest): the digest stands for the whole text."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part_column), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = [np.zeros(0, np.int32), *(text_failures(data, offsets) for _, _, data, offsets in tb.text_slices(batch.column("text")))]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "part": batch.column("part"), "digest": batch.column("digest"), "text_mask": pa.array(np.concatenate(masks).astype(np.int32))})

    return rows.mapInArrow(measure, "doc_id long, part string, digest binary, text_mask int")


def failures(docs: DataFrame, labels: DataFrame, part_column: str = "source") -> DataFrame:
    """(doc_id, part, mask, good, toxic): the filters each document fails, bit k for the k-th of ``FILTERS``, and its labels.

    A text's first document is found by an aggregate over digests, and met again by id and digest, so a text with
    very many copies is no task's burden.
    """
    rows = stored(_measured(docs, part_column), "audit-measured")
    first = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    copy = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    marked = rows.join(first, ["doc_id", "digest"], "left").join(known, "doc_id", "left")
    return marked.select("doc_id", "part", (F.col("text_mask") + copy).alias("mask"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))


def mask_counts(rows: DataFrame) -> DataFrame:
    """(part, counts): an entry (mask, n, good, toxic) for each mask that a part's documents have."""
    by_mask = rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    return by_mask.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))


class RemovalPolynomial:
    """The expected removals of a part by the shares at which its filters are applied; exact integers and rationals."""

    def __init__(self, counts: dict[int, int], k: int):
        self.k, self.total = k, sum(counts.values())
        failing = [counts.get(m, 0) for m in range(1 << k)]  # all of a set: sums over the masks that hold it
        for i in range(k):
            for m in range(1 << k):
                if not m >> i & 1:
                    failing[m] += failing[m | 1 << i]
        self.coefficients = [0 if not t else (failing[t] if t.bit_count() % 2 else -failing[t]) for t in range(1 << k)]
        self._corners = list(self.coefficients)  # sums over the sets within a corner
        for i in range(k):
            for m in range(1 << k):
                if m >> i & 1:
                    self._corners[m] += self._corners[m ^ 1 << i]

    def corner(self, applied: int) -> int:
        """Removals where the filters of a mask are applied wholly and the others not at all."""
        return self._corners[applied]

    def shapley(self, i: int) -> Fraction:
        """The partial derivative in x_i, integrated over the diagonal: t^(|T|-1) gives 1 / |T|."""
        return sum((Fraction(c, t.bit_count()) for t, c in enumerate(self.coefficients) if t >> i & 1), Fraction(0))


def order_figures(counts: list[dict], names: str) -> dict[str, list]:
    """Columns of a part's rows: each order of the filters and each of its steps."""
    k = len(names)
    every, good, toxic = (RemovalPolynomial({c["mask"]: c[of] for c in counts}, k) for of in ("n", "good", "toxic"))
    full = (1 << k) - 1
    unique = [every.corner(full) - every.corner(full ^ 1 << i) for i in range(k)]
    scaled = [int(every.shapley(i) * factorial(k)) for i in range(k)]
    out: dict[str, list] = {c: [] for c in ("filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")}
    for order in permutations(range(k)):
        name, before = "".join(names[i] for i in order), 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed = every.corner(after) - every.corner(before)
            row = (name, step, every.total - every.corner(after), removed, every.corner(1 << i) - removed, unique[i], good.corner(after) - good.corner(before), toxic.corner(after) - toxic.corner(before), scaled[i])
            for column, value in zip(out.values(), row):
                column.append(value)
            before = after
    return out


def audit(counts: DataFrame, names: str = FILTERS) -> DataFrame:
    """A row for each part, order and step, from ``mask_counts`` of filters with one-letter names. k filters give k! * k rows a part."""

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, entries in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
                columns = order_figures(entries, names)
                typed = {c: pa.array(v, {"filter_order": pa.string(), "step": pa.int32()}.get(c, pa.int64())) for c, v in columns.items()}
                yield pa.record_batch({"part": pa.array([part] * len(columns["step"]), pa.string())} | typed)

    longs = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return counts.mapInArrow(figures, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in longs))
