"""Importance resampling towards a target distribution, by hashed n-grams and Gumbel noise.

Features of a text are its runs of one to ``order`` consecutive words, each hashed to one of ``buckets`` buckets. A
bucket's gain is a thousand times the logarithm of its smoothed share in the target over that in the source; a
document's weight is its features' mean gain. Weight plus Gumbel noise of a hash of the id is the score, and the
highest scores are a draw without replacement, in proportion to the exponentials of the weights.

A pass over both tables counts buckets: tasks send one row for each bucket, so the sums stay as small. A second
pass scores texts by an array of gains.

The draw sorts what it has to: the scores, integers between fixed bounds, are counted; from the counts follow the
score at which the draw ends, and ranges of scores of at most ``RANGE_ROWS`` rows. Each partition sorts its eligible
rows above that score, a run, and cuts it at the ranges' bounds. A task merges the pieces of a range by a tournament
tree of losers; its first rank is the prefix sum of the ranges before it, and the merge stops once the draw
is full. A score with more rows than a range is cut by ids too, at their quantiles, and an id that repeats so often
that it makes up a range of its own is dealt over many tasks by run, as its rows are alike.

Defined cases: a null text has no words; a null id hashes as the empty string and comes last among ties; rows that
repeat an id are separate, in any order among themselves; an empty target has gains from its smoothing alone; without
eligible rows nothing is drawn; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .storage import stored

#: Rows of a run sorted at a time, and rows that one task merges.
RUN_ROWS, RANGE_ROWS = 1 << 20, 1 << 20
#: Ranges hold no fewer rows than this, unless ``RANGE_ROWS`` is less, where a small draw is shared out over all tasks.
LEAST_ROWS = 256
#: Tasks that the rows of one id are dealt over, where it fills a range of its own.
DEALT = 256
#: Bytes of a feature up to which checksums are computed for all features at once.
_SHORT = 48
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SEPARATOR = ~(((_FOLD >= 48) & (_FOLD <= 57)) | ((_FOLD >= 97) & (_FOLD <= 122)) | (_FOLD >= 128))
_NO_ID = np.iinfo(np.int64).max


def _checksum_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> 1), table >> 1)
    return table


_CHECKSUM = _checksum_table()


def checksums(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of spans: a byte of all of them at a time, longest first; the very long one by one."""
    order = np.argsort(-lengths, kind="stable")
    at, left = starts[order], lengths[order]
    state = np.full(len(order), 0xFFFFFFFF, np.uint32)
    long = int(np.searchsorted(-left, -_SHORT, side="left"))
    short_at, short_left, short = at[long:], left[long:], state[long:]
    for k in range(int(short_left[0]) if len(short_left) else 0):
        m = int(np.searchsorted(-short_left, -k, side="left"))
        head = short[:m]
        short[:m] = _CHECKSUM[(head ^ data[short_at[:m] + k]) & 0xFF] ^ (head >> np.uint32(8))
    out = np.empty(len(order), np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    for row, s, n in zip(order[:long], at[:long], left[:long]):
        out[row] = zlib.crc32(data[s : s + n].tobytes())
    return out


def features(data: np.ndarray, offsets: np.ndarray, order: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of every feature of a slice's documents."""
    data = _FOLD[data]
    starts, ends, owners = tb.word_spans(data, offsets, _SEPARATOR)
    if order > 1 and len(starts):  # words joined by one space, so that a run of them is a span
        lengths = ends - starts
        at = np.cumsum(lengths + 1) - lengths - 1
        joined = np.full(int(lengths.sum()) + len(lengths), 32, np.uint8)
        joined[tb.ragged(at, lengths)] = data[tb.ragged(starts, lengths)]
        data, starts, ends = joined, at, at + lengths
    out, documents = [], []
    for n in range(1, order + 1):
        last = np.arange(n - 1, len(starts))
        whole = last[owners[last - n + 1] == owners[last]] if n > 1 else last
        first = whole - n + 1
        out.append((checksums(data, starts[first], ends[whole] - starts[first]) % np.uint32(buckets)).astype(np.int64))
        documents.append(owners[whole])
    return np.concatenate(out), np.concatenate(documents)


def bucket_counts(texts: DataFrame, order: int, buckets: int) -> np.ndarray:
    """Occurrences of the features of all texts by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in tb.text_slices(batch.column("text")):
                total += np.bincount(features(data, offsets, order, buckets)[0], minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(seen.astype(np.int32)), "n": pa.array(total[seen])})

    summed = texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[summed.column("bucket").to_numpy()] = summed.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the logarithm of the ratio of smoothed shares, rounded down, by bucket."""
    s, t, n = source.astype(np.float64), target.astype(np.float64), float(len(source))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, order: int) -> DataFrame:
    """(doc_id, n_features, weight): the mean gain, rounded down, of every document."""
    buckets, packed = len(gain), gain.astype("<i8").tobytes()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = np.frombuffer(packed, "<i8")
        for batch in batches:
            counts, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for lo, hi, data, offsets in tb.text_slices(batch.column("text")):
                bucket, owners = features(data, offsets, order, buckets)
                by_owner = np.argsort(owners, kind="stable")
                total = np.zeros(len(owners) + 1, np.int64)
                np.cumsum(gain[bucket[by_owner]], out=total[1:])  # integers: sums of any length are exact
                cuts = np.searchsorted(owners[by_owner], np.arange(hi - lo + 1))
                counts.append(np.diff(cuts))
                sums.append(np.diff(total[cuts]))
            n, s = np.concatenate(counts), np.concatenate(sums)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_features": pa.array(n), "weight": pa.array(np.where(n > 0, s // np.maximum(n, 1), 0))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(weigh, "doc_id long, n_features long, weight long")


def with_scores(weighed: DataFrame, seed: int) -> DataFrame:
    """Adds ``score``: the weight and Gumbel noise of a hash of seed and id."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double")
    return weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))))


class LoserTree:
    """A tournament of k sorted runs: the winner is the least key at the runs' heads, each match keeps its loser."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.heads = [next(r, None) for r in runs] + [None] * (self.size - len(runs))
        self.losers = [0] * self.size
        winners = list(range(self.size))
        node = self.size
        while len(winners) > 1:
            node //= 2
            pairs = list(zip(winners[::2], winners[1::2]))
            for k, (a, b) in enumerate(pairs):
                won, lost = (a, b) if self._before(a, b) else (b, a)
                self.losers[node + k], winners[k] = lost, won
            winners = winners[: len(pairs)]
        self.winner = winners[0]

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x <= y)

    def __iter__(self) -> Iterator[tuple[int, tuple]]:
        while (key := self.heads[self.winner]) is not None:
            yield self.winner, key
            self.heads[self.winner] = next(self.runs[self.winner], None)
            at, node = self.winner, (self.winner + self.size) // 2
            while node:
                if self._before(self.losers[node], at):
                    self.losers[node], at = at, self.losers[node]
                node //= 2
            self.winner = at


@dataclass(frozen=True)
class Plan:
    """Where the draw ends, and the ranges of scores, with cuts by id in those that a range can't hold."""

    draw: int
    cutoff: int
    #: Lowest score of each range, highest range first.
    floors: np.ndarray
    #: Ids at which a range of one score is cut, by range.
    cuts: dict[int, np.ndarray]

    def place(self, score: np.ndarray, ids: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Range, cut and slot: cut 2k lies between ids, 2k+1 is the k-th id itself, which slots share out by run."""
        where = np.searchsorted(-self.floors, -score, side="left")
        cut = np.zeros(len(score), np.int64)
        for r, bounds in self.cuts.items():
            inside = where == r
            at = np.searchsorted(bounds, ids[inside], side="left")
            cut[inside] = 2 * at + (bounds[np.minimum(at, len(bounds) - 1)] == ids[inside])
        return where, cut, np.where(cut % 2 == 1, run % DEALT, 0)


def _plan(eligible: DataFrame, percent: int, range_rows: int, tasks: int) -> Plan | None:
    """Counts the scores: whole numbers between about -47,000 and 66,000, as gains and noise are logarithms of bounded ratios."""
    counted = eligible.groupBy("score").agg(F.count(F.lit(1)).alias("n")).toArrow()
    scores, n = counted.column("score").to_numpy(), counted.column("n").to_numpy()
    order = np.argsort(-scores)
    scores, n = scores[order], n[order]
    draw = int(percent * int(n.sum()) // 100)
    if not draw:
        return None
    range_rows = min(range_rows, max(LEAST_ROWS, draw // tasks))
    last = int(np.searchsorted(np.cumsum(n), draw, side="left"))
    floors, held, hot = [], 0, {}
    for k in range(last + 1):
        if n[k] > range_rows:
            if held:
                floors.append(int(scores[k - 1]))
            hot[int(scores[k])] = (len(floors), int(n[k]))
            floors.append(int(scores[k]))
            held = 0
            continue
        if held + n[k] > range_rows and held:
            floors.append(int(scores[k - 1]))
            held = 0
        held += n[k]
    if held:
        floors.append(int(scores[last]))
    cuts = {}
    if hot:
        parts = min(1 + max(c for _, c in hot.values()) // range_rows, 1000)
        shares = [k / parts for k in range(1, parts)]
        id_ = F.coalesce("doc_id", F.lit(int(_NO_ID)))
        for r in eligible.where(F.col("score").isin(list(hot))).groupBy("score").agg(F.percentile_approx(id_, shares, 10_000).alias("ids")).collect():
            cuts[hot[r.score][0]] = np.unique(np.array(r.ids, np.int64))
    return Plan(draw, int(scores[last]), np.array(floors, np.int64), cuts)


_FIELDS = ("score", "doc_id", "void", "n_features", "weight")


def _runs(rows: DataFrame, plan: Plan, run_rows: int) -> DataFrame:
    """(range, cut, slot, n, rows): a piece for each range that a partition's sorted run has rows in."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        run, held, size = TaskContext.get().partitionId(), [], 0

        def pieces() -> Iterator[pa.RecordBatch]:
            table = np.concatenate(held, axis=1)
            where, part, slot = plan.place(table[0], table[1], run)
            order = np.lexsort((table[2], table[1], -table[0], part, where))
            table, where, part, slot = table[:, order], where[order], part[order], slot[order]
            starts = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]) | (part[1:] != part[:-1])])
            ends = np.r_[starts[1:], len(where)]
            yield pa.record_batch({
                "range": pa.array(where[starts].astype(np.int32)), "cut": pa.array(part[starts].astype(np.int32)), "slot": pa.array(slot[starts].astype(np.int32)), "n": pa.array(ends - starts),
                "rows": pa.array([np.ascontiguousarray(table[:, a:b]).astype("<i8").tobytes() for a, b in zip(starts, ends)], pa.binary()),
            })

        for batch in batches:
            ids = batch.column("doc_id")
            plain = {"doc_id": ids.fill_null(int(_NO_ID)), "void": ids.is_null().cast(pa.int64())}
            held.append(np.stack([plain.get(f, batch.column(f) if f in batch.schema.names else None).to_numpy(zero_copy_only=False).astype(np.int64) for f in _FIELDS]))
            size += batch.num_rows
            if size >= run_rows:
                yield from pieces()
                held, size, run = [], 0, run + 1
        if size:
            yield from pieces()

    return rows.select("doc_id", "n_features", "weight", "score").mapInArrow(cut, "range int, cut int, slot int, n long, rows binary")


def merged(pieces: list[np.ndarray], wanted: int) -> tuple[np.ndarray, int]:
    """Rows of sorted pieces, the first ``wanted`` of them in order, and how many these are; the rest as they lie."""
    keys = [zip((-p[0]).tolist(), p[1].tolist(), p[2].tolist()) for p in pieces]
    taken, order = [0] * len(pieces), []
    at = np.cumsum([0, *(p.shape[1] for p in pieces)])
    if wanted > 0:
        for run, _ in LoserTree(keys):
            order.append(int(at[run]) + taken[run])
            taken[run] += 1
            if len(order) == wanted:
                break
    rest = [np.arange(at[k] + t, at[k + 1]) for k, t in enumerate(taken)]
    return np.concatenate(pieces, axis=1)[:, np.concatenate([np.array(order, np.int64), *rest])], len(order)


def draw_highest(scored: DataFrame, percent: int, least: int, range_rows: int = RANGE_ROWS, run_rows: int = RUN_ROWS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of all rows of a stored table: ranks for the highest ``percent`` per cent of those with ``least`` features or more."""
    eligible = F.col("n_features") >= least
    tasks = 4 * int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plan = _plan(scored.where(eligible), percent, range_rows, tasks)
    none = F.lit(None).cast("long").alias("rank")
    columns = ("doc_id", "n_features", "weight", "score")
    if plan is None:
        return scored.select(*columns, none)
    near = eligible & (F.col("score") >= plan.cutoff)
    pieces = stored(_runs(scored.where(near), plan, run_rows), "resample-runs")
    held = sorted((r.range, r.cut, r.slot, r.n) for r in pieces.groupBy("range", "cut", "slot").agg(F.sum("n").alias("n")).collect())
    before, first = 0, {}
    for *key, n in held:
        first[tuple(key)] = before
        before += n
    draw = plan.draw

    def merge(table: pa.Table) -> pa.Table:
        begun = first[tuple(table.column(c)[0].as_py() for c in ("range", "cut", "slot"))]
        rows, ranked = merged([np.frombuffer(b, "<i8").reshape(len(_FIELDS), -1) for b in table.column("rows").to_pylist()], draw - begun)
        by = dict(zip(_FIELDS, rows))
        places = np.arange(rows.shape[1])
        out = {c: pa.array(by[c], pa.int64(), mask=by["void"] == 1 if c == "doc_id" else None) for c in columns}
        return pa.table(out | {"rank": pa.array(begun + 1 + places, pa.int64(), mask=places >= ranked)})

    drawn = pieces.groupBy("range", "cut", "slot").applyInArrow(merge, ", ".join(f"{c} long" for c in (*columns, "rank")))
    return drawn.union(scored.where(~near).select(*columns, none))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least: int = 20, order: int = 1, buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and, if drawn, rank."""
    gain = gains(bucket_counts(docs, order, buckets), bucket_counts(target, order, buckets))
    return draw_highest(stored(with_scores(weights(docs, gain, order), seed), "resample-scored"), percent, least)
