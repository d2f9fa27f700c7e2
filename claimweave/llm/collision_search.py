"""Largest inner products by collision counting over single projections.

Vectors lie in blocks of about equal length. Appending sqrt(M^2 - |x|^2) to a block's vectors, M its
largest norm, and 0 to a query scaled to M turns the largest inner product into the smallest distance.
A block's index is, for each of ``PROJECTIONS`` random directions, its vectors' projections in sorted
order. A query opens a window around its own projection in each of these; virtual rehashing widens all
windows, and only the vectors that enter are counted, by walking the arrays outwards. A vector that
has collided in ``THRESHOLD`` of the windows is verified by its true inner product.

Windows end at REACH times the distance of the ``k``-th best vector verified so far: one at that
distance or nearer lies in a window of that width with probability 2 * Phi(REACH) - 1, and so, by the
binomial distribution, in fewer windows than the threshold with a probability of about 0.02. That holds
for any dimension and any norms; where distances hardly differ, more vectors pass the threshold, up
to all of a block. Windows that hold the whole block end the search there, with all verified.

Blocks of the longest vectors come first. They bound each query's ``k``-th best product from below,
and a run of queries meets only those other blocks whose largest norm can reach it. Pairs of a block
and a run are bounded in size, so a task's memory doesn't follow the table.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows
with a null id, take no part; vectors of another length than the query's aren't candidates; rows
with the query's id aren't its candidates; ties go to the smaller id; rows that repeat an id with
equal scores are separate candidates; tiny and huge components are scaled for the index only, so a
score may be infinite, and one that is not a number counts as the smallest; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from math import erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.functions.binding import let

from .storage import dropped, stored

BLOCK, RUN = 16384, 2048
PROJECTIONS, REACH = 48, 1.3
_INSIDE = erf(REACH / sqrt(2))
#: Windows that a vector is met in before it is verified: 2.05 standard deviations below the mean at the last width.
THRESHOLD = int(PROJECTIONS * _INSIDE - 2.05 * sqrt(PROJECTIONS * _INSIDE * (1 - _INSIDE)))
#: The first windows' half width by the norm; so many times ``k`` vectors, those met most often, are verified there.
FIRST, FIRST_VERIFIED = 0.35, 5
#: Steps of the last width in which windows widen.
STEPS = (0.85, 1.0)
#: Queries whose counts are held at a time.
_AT_ONCE = 256
#: Norms of a block lie within this factor.
NORM_CLASS = 1.25
#: The blocks of the longest vectors that come first hold at least this many times ``k``.
LEADERS = 20


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v, dim, size): size is the logarithm of the norm, which no component overflows."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(F.coalesce(x, F.lit(0.0))) & (F.abs(F.coalesce(x, F.lit(0.0))) < float("inf")))
    squares = lambda most: F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / most) * (x / most))
    size = let({"most": F.array_max(F.transform("v", F.abs))}, lambda t: F.log(t["most"]) + F.log(squares(t["most"])) / 2)
    return rows.where(finite).where(F.exists("v", lambda x: x != 0)).select("id", "v", F.size("v").alias("dim"), size.alias("size"))


def packed(rows: DataFrame, size: int, by: Column) -> DataFrame:
    """Rows of one length and class, packed into matrices of about ``size`` vectors; ``top`` is the largest size."""
    classed = rows.withColumn("class", by.cast("int"))
    parts = classed.groupBy("dim", "class").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("parts"))
    placed = classed.join(parts, ["dim", "class"]).withColumn("part", F.pmod(F.xxhash64("id", "v"), "parts").cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        top = float(np.max(table.column("size").to_numpy()))
        return pa.table({
            "dim": table.column("dim")[:1], "class": table.column("class")[:1], "part": table.column("part")[:1], "top": pa.array([top]),
            "ids": pa.array([ids[order].astype("<i8").tobytes()], pa.binary()), "vectors": pa.array([flat[order].astype("<f8").tobytes()], pa.binary()),
        })

    return placed.select("dim", "class", "part", "id", "v", "size").groupBy("dim", "class", "part").applyInArrow(pack, "dim int, class int, part int, top double, ids binary, vectors binary")


def search_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row of the block, score) of the best ``k`` found for each query."""
    n, dim = x.shape
    scaled = x / np.abs(x).max()
    norms = np.linalg.norm(scaled, axis=1)
    norm = float(norms.max())
    towards = q / np.abs(q).max(axis=1, keepdims=True)
    towards /= np.linalg.norm(towards, axis=1, keepdims=True)
    directions = np.random.default_rng(seed).normal(size=(dim + 1, PROJECTIONS))
    projected = scaled @ directions[:dim] + np.outer(np.sqrt(np.maximum(norm**2 - norms**2, 0)), directions[dim])
    orders = np.ascontiguousarray(np.argsort(projected, axis=0, kind="stable").T)
    arrays = [np.ascontiguousarray(projected[o, j]) for j, o in enumerate(orders)]
    centres = norm * (towards @ directions[:dim])
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(q), _AT_ONCE):
        asked = np.arange(at, min(at + _AT_ONCE, len(q)))
        searches = [_Search(n, k, query_ids[a], ids, scaled, towards[a], norm) for a in asked]
        pending = list(range(len(asked)))
        while pending:
            half = np.array([searches[p].half for p in pending])
            own = centres[asked[pending]]
            low = np.stack([np.searchsorted(a, own[:, j] - half, side="left") for j, a in enumerate(arrays)], 1)
            high = np.stack([np.searchsorted(a, own[:, j] + half, side="right") for j, a in enumerate(arrays)], 1)
            pending = [p for p, lo, hi in zip(pending, low.tolist(), high.tolist()) if not searches[p].widen(orders, lo, hi)]
        for a, s in zip(asked.tolist(), searches):
            found = s.best()
            with np.errstate(over="ignore", invalid="ignore"):
                scores = (x[found] * q[a]).sum(axis=1)
            best = np.lexsort((ids[found], -np.where(np.isnan(scores), -np.inf, scores), np.isnan(scores)))[:k]
            out.append((np.full(len(best), a), found[best], scores[best]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


class _Search:
    """One query's windows in a block: how often each vector was met, and the products of those verified."""

    def __init__(self, n: int, k: int, query_id: int, ids: np.ndarray, scaled: np.ndarray, towards: np.ndarray, norm: float):
        self.counts, self.product = np.zeros(n, np.uint8), np.full(n, -np.inf)
        self.k, self.other, self.scaled, self.towards, self.norm = k, ids != query_id, scaled, towards, norm
        self.half, self.steps, self.low, self.high, self.verified = FIRST * norm, list(STEPS), None, None, 0

    def widen(self, orders: np.ndarray, low: list[int], high: list[int]) -> bool:
        """Counts what enters the windows of ``half`` and verifies; true once the search is done."""
        counts, n = self.counts, len(self.counts)
        if first := self.low is None:
            entered = [order[lo:hi] for order, lo, hi in zip(orders, low, high)]
        else:
            entered = [order[a:b] for order, *ends in zip(orders, low, self.low, self.high, high) for a, b in (ends[:2], ends[2:])]
        counts += np.bincount(np.concatenate(entered), minlength=n).astype(np.uint8)
        self.low, self.high = low, high
        everything = not any(low) and min(high) == n
        fresh = (counts >= THRESHOLD) & self.other & (self.product == -np.inf)
        if first:
            likely = np.argpartition(counts, max(0, n - FIRST_VERIFIED * self.k))[-FIRST_VERIFIED * self.k :]
            fresh[likely] = self.other[likely]
        rows = np.flatnonzero(fresh)
        self.product[rows] = self.scaled[rows] @ self.towards
        self.verified += len(rows)
        if everything:
            return True
        if self.verified < self.k:
            self.half *= 1 / FIRST
            return False
        kth = np.partition(self.product, n - self.k)[n - self.k]
        last = REACH * sqrt(max(2 * self.norm**2 - 2 * self.norm * kth, 0.0)) + 1e-9 * self.norm
        if self.half >= last:
            return True
        while self.steps and self.steps[0] * last <= self.half:
            self.steps.pop(0)
        self.half = (self.steps.pop(0) if self.steps else 1.0) * last
        return False

    def best(self) -> np.ndarray:
        """Rows that may be among the ``k`` best, ties included."""
        found = np.flatnonzero(self.product > -np.inf)
        if len(found) > self.k:
            near = self.product[found]
            found = found[near >= np.partition(near, len(found) - self.k)[len(found) - self.k] - 1e-9 * self.norm]
        return found


def met(blocks: DataFrame, runs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id and score of the best ``k`` of each block for the queries of each run, for pairs (dim, class, part, run)."""

    def search(block: pa.Table, run: pa.Table) -> pa.Table:
        if not block.num_rows or not run.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, query_ids = (np.frombuffer(t.column("ids")[0].as_buffer(), "<i8") for t in (block, run))
        x, q = (np.frombuffer(t.column("vectors")[0].as_buffer(), "<f8").reshape(len(i), -1) for t, i in ((block, ids), (run, query_ids)))
        query, row, score = search_block(ids, x, query_ids, q, k, seed=1 + block.column("part")[0].as_py())
        return pa.table({"query_id": query_ids[query], "vec_id": ids[row], "score": score})

    keys = ["dim", "class", "part", "run"]
    left = pairs.join(blocks, ["dim", "class", "part"]).select(*keys, "ids", "vectors")
    named = [f"run_{k}" for k in keys]  # other names: both sides come of ``pairs``
    right = pairs.join(runs.select("dim", F.col("part").alias("run"), "ids", "vectors"), ["dim", "run"]).select(*keys, "ids", "vectors").toDF(*named, "ids", "vectors")
    return left.groupBy(*keys).cogroup(right.groupBy(*named)).applyInArrow(search, "query_id long, vec_id long, score double")


def ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.isnan("score"), F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's best ``k``."""
    rows = stored(usable(vectors, id_column, vector_column), "search-vectors")
    blocks = stored(packed(rows, BLOCK, F.round(F.col("size") / float(np.log(NORM_CLASS)))), "search-blocks")  # unit vectors make one class
    dropped(rows)
    runs = stored(packed(usable(queries, id_column, vector_column), RUN, F.lit(0)), "search-runs")
    held = blocks.select("dim", "class", "part", "top", (F.octet_length("ids") / 8).cast("long").alias("n"))
    # The classes of the longest vectors, until they hold enough: a few rows for each length.
    classes = held.groupBy("dim", "class").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("dim").orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, -1)
    leading = classes.withColumn("longer", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("longer") < LEADERS * k).select("dim", "class")
    by_run = runs.select("dim", F.col("part").alias("run"))
    pairs = held.join(leading, ["dim", "class"], "left_semi").join(by_run, "dim").select("dim", "class", "part", "run")
    first = stored(ranked(met(blocks, runs, pairs, k), k), "search-first")

    # A query's k-th best so far over its norm: no block of shorter vectors can better it.
    def split(table: pa.Table) -> pa.Table:
        ids = np.frombuffer(table.column("ids")[0].as_buffer(), "<i8")
        q = np.frombuffer(table.column("vectors")[0].as_buffer(), "<f8").reshape(len(ids), -1)
        most = np.abs(q).max(axis=1)
        size = np.log(most) + np.log(np.linalg.norm(q / most[:, None], axis=1))
        return pa.table({"dim": pa.array(np.full(len(ids), q.shape[1], np.int32)), "run": pa.array(np.full(len(ids), table.column("part")[0].as_py(), np.int32)), "query_id": pa.array(ids), "size": pa.array(size)})

    asked = runs.groupBy("dim", "part").applyInArrow(split, "dim int, run int, query_id long, size double")
    kth = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).where(F.col("n") >= k)
    low = F.when((F.col("score") > 0) & (F.col("score") < float("inf")), F.log("score") - F.col("size")).otherwise(float("-inf"))
    bounds = asked.join(kth, "query_id", "left").groupBy("dim", "run").agg(F.min(low).alias("bound"))
    rest = held.join(leading, ["dim", "class"], "left_anti").join(bounds, "dim").where("top + 1e-9 >= bound").select("dim", "class", "part", "run")
    rest = stored(rest, "search-rest")
    if rest.isEmpty():
        return first
    second = stored(ranked(met(blocks, runs, rest, k), k), "search-second")
    dropped(blocks, runs, rest)
    return ranked(first.select("query_id", "vec_id", "score").union(second.select("query_id", "vec_id", "score")), k)
