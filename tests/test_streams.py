"""Streams against whole tables: states with refusals and restarts, stalls, contents once with bounded state."""

import random
from datetime import datetime, timedelta

from claimweave.operators.pages import first_by_hash
from claimweave.sources.versioned import VersionedTables
from claimweave.streaming import incremental, lifecycle

EVENT = "document_id long, status string, ts timestamp, version long, pages long, attempts long"


def feed(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def by_hand(rows):
    out = {}
    for d, status, ts, version, pages, attempts in sorted(rows, key=lambda r: (r[2], r[3])):
        s = out.setdefault(d, [None, None, None, 0, 0, 0, 0])
        if status in lifecycle.FOLLOWING[s[0]]:
            s[:] = [status, ts, version, s[3] + 1, s[4], s[5] + (pages or 0), s[6] + (attempts or 0)]
        else:
            s[4] += 1
    return {d: tuple(s) for d, s in out.items()}


def test_states_in_micro_batches_with_a_restart(spark, tmp_path):
    rng, begin = random.Random(3), datetime(2024, 1, 1)
    likely = [*lifecycle.STATES[:7], *lifecycle.STATES[:2], "failed", "nonsense"]
    rows = [(rng.randrange(6), rng.choice(likely), begin + timedelta(minutes=k), k, rng.choice([None, 1, 2]), 1) for k in range(300)]
    source, tables = str(tmp_path / "in"), VersionedTables(spark, str(tmp_path / "out"), incremental.STATES)

    def run():
        stream = lifecycle.live_states(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(source))
        incremental.start(stream, incremental.state_writer(tables), str(tmp_path / "ck"), once=True, mode="update").awaitTermination(300)
        return {r.document_id: tuple(r)[1:8] for r in tables.read("states").collect()}

    for k in range(2):
        feed(spark, source, rows[k * 60 : k * 60 + 60], EVENT)
    assert run() == by_hand(rows[:120])
    feed(spark, source, rows[120:], EVENT)
    assert run() == by_hand(rows)  # another query, on the state that the first left
    whole = {r.document_id: tuple(r)[1:] for r in lifecycle.walked(spark.createDataFrame(rows, EVENT)).collect()}
    assert whole == by_hand(rows)


def test_stalled_documents(spark, tmp_path):
    begin = datetime(2024, 1, 1)
    source, seen = str(tmp_path / "in"), []
    feed(spark, source, [(1, "queued", begin, 1, None, None), (2, "queued", begin, 2, None, None)], EVENT)

    def run():
        events = spark.readStream.schema(EVENT).parquet(source).withWatermark("ts", "1 minute")
        stream = lifecycle.live_states(events, stall_ms=600_000)
        incremental.start(stream, lambda b, n: seen.extend((r.document_id, r.status, r.stalled) for r in b.collect()), str(tmp_path / "ck"), once=True, mode="update").awaitTermination(300)

    run()
    feed(spark, source, [(2, "ingesting", begin + timedelta(minutes=5), 3, None, None), (3, "queued", begin + timedelta(minutes=14), 4, None, None)], EVENT)
    run()
    assert [s for s in seen if s[2]] == [(1, "queued", True)]


def test_contents_once_over_many_batches(spark, tmp_path):
    rng = random.Random(8)
    texts = [rng.choice(["", "a", "b", None, *(f"text {k % 40}" for k in range(80))]) for _ in range(400)]
    rows = [(k, t) for k, t in enumerate(texts)]
    tables = VersionedTables(spark, str(tmp_path / "seen"), incremental.SEEN, buckets=4, most_parts=4)
    work, schema, sizes = incremental.arrival_writer(tables), "document_id long, text string", []
    for n in range(8):
        batch = spark.createDataFrame(rows[n * 50 : n * 50 + 50], schema)
        work(batch, n)
        if n == 3:
            work(batch, n)  # repeated after a restart
        sizes.append((tables.read("seen").count(), len(tables.snapshot()["tables"]["seen"]["parts"])))
    got = {r.document_id: (r.sha256, r.first_id, r.duplicate_reused) for r in tables.read("arrivals").collect()}
    want = {r.document_id: (r.sha256, r.first_id, r.duplicate_reused) for r in first_by_hash(spark.createDataFrame(rows, schema), "document_id").collect()}
    assert got == want
    assert sizes[-1][0] == len({t for t in texts if t is not None}) and max(parts for _, parts in sizes) <= 4
