"""Near-duplicate vectors of one label by a pivot-permutation index.

Reference points, the pivots, are vectors of a bounded sample that keep their distance from each other. A vector is
described by its ``NEAREST`` nearest pivots in order. The inverted lists hold, for a label and two pivots, the vectors
that have both among their nearest: two vectors share a list as soon as they share two pivots, the count that makes
them candidates. A list's pairs are verified by their cosine in double precision. A pair that shares several lists counts
in one only, that of the two smallest pivots it shares.

Nothing is emitted for a pair: a list gives each vector its number of links, and a spanning forest of the links
found, at most an edge a vector. Equal vectors are one class, with a count. Vectors nearer to a pivot than half
the links' angle make a ball: all of them are linked by the triangle inequality, so a ball counts its own pairs at once,
however large, and no list compares them. A list longer than ``BLOCK`` is cut into blocks, by ball first; pairs of
blocks are met by a join, which adaptive execution can split.

The number of pivots follows the labels' sizes, up to ``PIVOTS``; beyond that, lists grow with the table. Recall
depends on the pivots that near vectors share: over 0.97 by tests at a cosine of exactly the threshold, for 16, 64 and
384 dimensions, scattered or clustered.

Defined cases: rows with a null id or label, and vectors that are null, empty, zero or hold null or non-finite components,
link with nothing and are kept; so do vectors of different lengths; rows that repeat an id are vectors of their own;
a component's id is its smallest id; tiny and huge components are scaled; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, cos

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import dropped, stored

#: Most vectors that pivots are chosen from, and most pivots.
SAMPLE, PIVOTS, LEAST_PIVOTS = 4096, 512, 24
#: Pivots that describe a vector, in order.
NEAREST = 6
#: Cosines that pivots keep below, the later ones only if too few keep the first.
SEPARATION = (0.8, 0.95)
#: Vectors of a list that are compared at once.
BLOCK = 512
_LIST = ("label", "dim", "p", "q")


def _unit(flat: np.ndarray) -> np.ndarray:
    scaled = flat / np.abs(flat).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def classes(rows: DataFrame) -> DataFrame:
    """(label, v, first, n): distinct usable vectors of a label, their smallest id and their number."""
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(F.coalesce(x, F.lit(0.0))) & (F.abs(F.coalesce(x, F.lit(0.0))) < float("inf")))
    usable = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").where(whole).where(F.exists("v", lambda x: x != 0))
    return usable.groupBy("label", "v").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"))


def choose_pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """Rows of a sample of unit vectors that keep apart; fewer than ``most`` where the sample has no more."""
    chosen = np.zeros((0, sample.shape[1]))
    for apart in SEPARATION:
        for x in sample:
            if len(chosen) == most:
                return chosen
            if not len(chosen) or float((chosen @ x).max()) < apart:
                chosen = np.vstack([chosen, x])
    return chosen


def fit(distinct: DataFrame) -> dict[int, np.ndarray]:
    """Pivots by length of vectors, from about ``SAMPLE`` classes chosen by a hash."""
    by_label = distinct.groupBy("label").agg(F.count(F.lit(1)).alias("m")).agg(F.sum("m").alias("n"), (F.sum(F.col("m") * F.col("m").cast("double")) / F.sum("m")).alias("usual")).first()
    if not by_label.n:
        return {}
    most = int(min(PIVOTS, max(LEAST_PIVOTS, 0.8 * by_label.usual**0.5)))
    hashed = F.xxhash64("label", "v")
    sample = distinct.where(F.pmod(hashed, F.lit(-(-by_label.n // SAMPLE))) == 0).select(hashed.alias("h"), "v").limit(2 * SAMPLE).toArrow().sort_by("h").column("v").to_pylist()
    out = {}
    for dim in sorted({len(v) for v in sample}):
        out[dim] = choose_pivots(_unit(np.array([v for v in sample if len(v) == dim], np.float64)), most)
    return out


def describe(distinct: DataFrame, pivots: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """Adds ``near``, the nearest pivots in order of distance, and ``ball``, the first of them if it is near enough, else -1.

    Vectors of a length without pivots are described by none."""
    reach = cos(acos(threshold) / 2) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            dims = pa.compute.list_value_length(column).to_numpy()
            near, ball = [None] * len(dims), np.full(len(dims), -1, np.int32)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                points = pivots.get(int(dim))
                if points is None:
                    for r in rows:
                        near[r] = []
                    continue
                for at in range(0, len(rows), 1024):
                    part = rows[at : at + 1024]
                    by = _unit(_matrix(column.take(pa.array(part)), int(dim))) @ points.T
                    k = min(NEAREST, len(points))
                    best = np.argpartition(-by, k - 1, axis=1)[:, :k]
                    best = np.take_along_axis(best, np.argsort(-np.take_along_axis(by, best, 1), axis=1, kind="stable"), 1)
                    ball[part] = np.where(by[np.arange(len(part)), best[:, 0]] >= reach, best[:, 0], -1)
                    for r, b in zip(part, best.tolist()):
                        near[r] = b
            yield pa.record_batch([*batch.columns, pa.array(dims.astype(np.int32)), pa.array(near, pa.list_(pa.int32())), pa.array(ball)], names=[*batch.schema.names, "dim", "near", "ball"])

    import pyarrow.compute  # noqa: F401

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in distinct.schema.fields)
    return distinct.mapInArrow(run, f"{shape}, dim int, near array<int>, ball int")


def lists(described: DataFrame) -> DataFrame:
    """A row for each vector and each two of its pivots, p < q; ``lower`` are its other pivots below q. Without two pivots, the one list of its length."""
    ordered = F.array_sort("near")
    two = F.flatten(F.transform(ordered, lambda p: F.transform(F.filter(ordered, lambda q: q > p), lambda q: F.struct(p.alias("p"), q.alias("q"), F.filter(ordered, lambda r: (r < q) & (r != p)).alias("lower")))))
    alone = F.array(F.struct(F.lit(-1).alias("p"), F.lit(-1).alias("q"), F.array().cast("array<int>").alias("lower")))
    return described.withColumn("list", F.explode(F.when(F.size("near") < 2, alone).otherwise(two))).select("label", "dim", "list.*", "cls", "n", "ball", "v")


class _Rows:
    """Rows of a list or a block: classes, counts, balls, lower pivots and unit vectors."""

    def __init__(self, table: pa.Table):
        self.cls, self.n, self.ball = (table.column(c).to_numpy() for c in ("cls", "n", "ball"))
        self.unit = _unit(_matrix(table.column("v").combine_chunks(), int(table.column("dim")[0].as_py())))
        lower = table.column("lower").combine_chunks()
        self.lengths, self.values = pa.compute.list_value_length(lower).to_numpy(), lower.flatten().to_numpy()

    def has(self, pivots: np.ndarray) -> np.ndarray:
        """Which of some sorted pivots each row has below the list's."""
        out = np.zeros((len(self.cls), len(pivots)), np.float32)
        if len(pivots):
            at = np.minimum(np.searchsorted(pivots, self.values), len(pivots) - 1)
            hit = pivots[at] == self.values
            out[np.repeat(np.arange(len(self.cls)), self.lengths)[hit], at[hit]] = 1
        return out


def links(a: _Rows, b: _Rows | None, threshold: float) -> np.ndarray:
    """Pairs (row of a, row of b) linked here; without b, the pairs within a, smaller row first."""
    both = b or a
    open_ = (a.ball[:, None] != both.ball[None, :]) | (a.ball[:, None] < 0)
    shared = np.intersect1d(a.values, both.values)
    if len(shared):
        open_ &= (a.has(shared) @ both.has(shared).T) == 0  # else another list has the pair
    if b is None:
        open_ &= np.tri(len(a.cls), k=-1, dtype=bool).T
    if not open_.any():
        return np.zeros((0, 2), np.int64)
    return np.argwhere(open_ & (a.unit @ both.unit.T >= threshold))


def spanning(cls: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """For each row the least class that the pairs lead to."""
    root = cls.copy()
    while len(pairs):
        before = root.copy()
        least = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
        np.minimum.at(root, pairs[:, 0], least)
        np.minimum.at(root, pairs[:, 1], least)
        if (root == before).all():
            break
    return root


_FOUND = "cls long, links long, root long"


def _found(a: _Rows, b: _Rows | None, threshold: float) -> pa.Table:
    pairs = links(a, b, threshold)
    cls, n = a.cls, a.n
    if b is not None:
        pairs = pairs + np.array([[0, len(a.cls)]])
        cls, n = np.concatenate([a.cls, b.cls]), np.concatenate([a.n, b.n])
    count = np.zeros(len(cls), np.int64)
    np.add.at(count, pairs[:, 0], n[pairs[:, 1]])
    np.add.at(count, pairs[:, 1], n[pairs[:, 0]])
    linked = np.flatnonzero(count)
    return pa.table({"cls": cls[linked], "links": count[linked], "root": spanning(cls, pairs)[linked]})


def linked_in_lists(entries: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(cls, links, root): by list or pair of blocks, how many vectors each class links with, and a class it leads to."""
    sizes = stored(entries.groupBy(*_LIST).agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "dedup-sizes")

    def short(table: pa.Table) -> pa.Table:
        return _found(_Rows(table), None, threshold)

    found = entries.join(sizes.where(F.col("size") <= block), list(_LIST)).groupBy(*_LIST).applyInArrow(short, _FOUND)

    long = entries.join(sizes.where(F.col("size") > block), list(_LIST))
    part = F.pmod(F.xxhash64("cls"), F.ceil(F.col("size") / block)).cast("int")
    key = [*_LIST, "ball", "part"]
    typed = long.schema
    value = typed["v"].dataType.simpleString()
    fields = f"cls array<long>, n array<long>, lower array<array<int>>, v array<{value}>"

    def pack(table: pa.Table) -> pa.Table:
        one = lambda c: pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), table.column(c).combine_chunks())
        return pa.table({**{k: table.column(k)[:1] for k in key}, **{c: one(c) for c in ("cls", "n", "lower", "v")}})

    # Blocks of one ball have no pair within; a block of no ball meets itself too.
    packed = long.withColumn("part", part).select(*key, "cls", "n", "lower", "v").groupBy(*key).applyInArrow(pack, ", ".join(f"{k} {typed[k].dataType.simpleString() if k != 'part' else 'int'}" for k in key) + f", {fields}")
    packed = stored(packed, "dedup-blocks")
    sides = [packed.select(*_LIST, *(F.col(c).alias(f"{c}_{s}") for c in ("ball", "part", "cls", "n", "lower", "v"))) for s in "ab"]
    met = sides[0].join(sides[1], list(_LIST)).where("struct(ball_a, part_a) <= struct(ball_b, part_b) AND (ball_a != ball_b OR ball_a < 0)")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)

                def side(s: str) -> _Rows:
                    n = len(row.column(f"cls_{s}")[0])
                    columns = {c: row.column(f"{c}_{s}").flatten() for c in ("cls", "n", "lower", "v")}
                    return _Rows(pa.table(columns | {"ball": np.full(n, row.column(f"ball_{s}")[0].as_py(), np.int32), "dim": np.full(n, row.column("dim")[0].as_py(), np.int32)}))

                same = row.column("ball_a")[0] == row.column("ball_b")[0] and row.column("part_a")[0] == row.column("part_b")[0]
                yield from _found(side("a"), None if same else side("b"), threshold).to_batches()

    return found.union(met.mapInArrow(verify, _FOUND))


def linked_in_balls(described: DataFrame) -> DataFrame:
    """The same of the balls: each member links with all others."""
    members = described.where("ball >= 0").select("label", "dim", "ball", "cls", "n")
    whole = members.groupBy("label", "dim", "ball").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("size"), F.min("cls").alias("root")).where("size > 1")
    return members.join(whole, ["label", "dim", "ball"]).select("cls", (F.col("all") - F.col("n")).alias("links"), "root")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).alias("label"), F.col(vector_column).alias("v"))
    digest = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")]
    distinct = stored(classes(rows).withColumn("cls", F.monotonically_increasing_id()), "dedup-classes")
    described = stored(describe(distinct, fit(distinct), threshold), "dedup-described")
    dropped(distinct)
    found = stored(linked_in_lists(lists(described), threshold, block).union(linked_in_balls(described)), "dedup-links")
    counts = found.groupBy("cls").agg(F.sum("links").alias("links"))
    member = components(found.select(F.col("cls").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("cls"), "component")
    named = described.select("cls", "first").join(member, "cls")
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    joined = member.join(least, "component").join(counts, "cls").select("cls", "links", "component_id")
    result = described.join(joined, "cls", "left").select(
        "label", *digest, (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "first").alias("component_id"),
    )
    # A row that takes no part may hold the same bits as none of the classes: its label or id is null, or its vector unusable.
    keyed = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("label")).alias("label"), *digest)
    out = keyed.join(result, ["label", "h1", "h2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
