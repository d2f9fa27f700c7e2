"""Documents' states by a stream of events: what a state may follow, counters, and documents that have stalled.

Event: document_id, status (what is asked for), ts, version (unique, rising with ts), pages and attempts (added if the event is accepted).
An event that may not follow the document's state is refused and counted. ``walked`` is the same over a whole table.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from claimweave.functions.fixed_values import STATES

QUEUED, COMPLETED, FAILED = STATES[0], STATES[-2], STATES[-1]
#: What each state may be followed by: the next one, or failure until the end; a failed document may be queued again.
FOLLOWING: dict[str | None, tuple[str, ...]] = {None: (QUEUED,), FAILED: (QUEUED,), COMPLETED: ()} | {a: (b, FAILED) for a, b in zip(STATES[:-2], STATES[1:-1])}
_STATE = "status string, ts timestamp, version bigint, accepted bigint, refused bigint, pages bigint, attempts bigint"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def may_follow(before: Column, after: Column) -> Column:
    legal = [f"{a or ''}>{b}" for a, bs in FOLLOWING.items() for b in bs]
    return F.coalesce(F.concat(F.coalesce(before, F.lit("")), F.lit(">"), after).isin(legal), F.lit(False))


def walked(events: DataFrame) -> DataFrame:
    """document_id and its state after all events, in order of ts and version: a fold over each document's own events."""
    listed = events.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("ts", "version", "status", "pages", "attempts"))).alias("es"))
    none = F.struct(*(F.lit(None if c in ("status", "ts", "version") else 0).cast(k).alias(c) for c, k in (x.split() for x in _STATE.split(", "))))

    def step(acc: Column, e: Column) -> Column:
        ok = may_follow(acc["status"], e["status"])
        taken = {c: F.when(ok, e[c]).otherwise(acc[c]) for c in ("status", "ts", "version")}
        sums = {c: acc[c] + F.when(ok, F.coalesce(e[c], F.lit(0))).otherwise(0) for c in ("pages", "attempts")}
        counts = {"accepted": acc["accepted"] + ok.cast("bigint"), "refused": acc["refused"] + (~ok).cast("bigint")}
        both = taken | counts | sums
        return F.struct(*(both[x.split()[0]].cast(x.split()[1]).alias(x.split()[0]) for x in _STATE.split(", ")))

    return listed.select("document_id", F.aggregate("es", none, step).alias("s")).select("document_id", "s.*")


class Lifecycle(StatefulProcessor):
    """A document's state and counters in the state store; a timer for one that no event moves on."""

    def __init__(self, stall_ms: int | None = None):
        self.stall_ms = stall_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("document", _STATE)

    def _row(self, key, s: tuple, stalled: bool) -> Row:
        return Row(document_id=key[0], status=s[0], ts=s[1], version=s[2], accepted=s[3], refused=s[4], pages=s[5], attempts=s[6], stalled=stalled)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        status, ts, version, accepted, refused, pages, attempts = tuple(self.state.get()) if self.state.exists() else (None, None, None, 0, 0, 0, 0)
        for e in sorted(rows, key=lambda r: (r.ts, r.version)):
            if e.status in FOLLOWING[status]:
                status, ts, version, accepted = e.status, e.ts, e.version, accepted + 1
                pages, attempts = pages + (e.pages or 0), attempts + (e.attempts or 0)
            else:
                refused += 1
        s = (status, ts, version, accepted, refused, pages, attempts)
        self.state.update(s)
        if self.stall_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if status not in (None, COMPLETED, FAILED):
                self.handle.registerTimer(int(ts.timestamp() * 1000) + self.stall_ms)
        yield self._row(key, s, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.state.exists():
            yield self._row(key, tuple(self.state.get()), True)


def live_states(events: DataFrame, stall_ms: int | None = None) -> DataFrame:
    """A row for each document that a micro-batch has events of, with its state after them; with ``stall_ms``, and a watermark on
    ts, also one marked ``stalled`` once the watermark is so far behind a document's last step. The state lies in RocksDB."""
    events.sparkSession.conf.set(*_PROVIDER)
    kind = events.schema["document_id"].dataType.simpleString()
    return events.groupBy("document_id").transformWithState(
        Lifecycle(stall_ms), f"document_id {kind}, {_STATE}, stalled boolean", outputMode="Update", timeMode="None" if stall_ms is None else "EventTime",
    )
