"""Versioned tables against dictionaries: random changes, kills, conflicts, readers of old snapshots."""

import random

import pytest

from claimweave.sources import files
from claimweave.sources.versioned import Conflict, Table, VersionedTables

TABLES = {"facts": Table(("document_id", "fact_id"), ("document_id",)), "rel": Table(("a", "b"), ("a", "b"))}
FACT, REL = "document_id string, fact_id long, value string", "a long, b long, version long, note string"


def contents(store, snapshot=None):
    out = {}
    for name in TABLES:
        rows = store.read(name, snapshot)
        out[name] = sorted(tuple(r) for r in rows.collect()) if rows is not None else []
    return out


def test_random_changes(spark, tmp_path):
    rng = random.Random(5)
    store = VersionedTables(spark, str(tmp_path / "s"), TABLES, buckets=4, most_parts=5)
    facts, rel, seen = {}, {}, []
    for step in range(14):
        change = store.begin()
        for _ in range(rng.randint(1, 2)):
            what = rng.choice(["upsert", "delete", "merge", "unlink", "replace" if step == 7 else "upsert"])
            if what == "upsert":
                new = {(f"d{rng.randrange(6)}", rng.randrange(5)): f"v{step}-{k}" for k in range(rng.randint(0, 6))}
                change.upsert("facts", spark.createDataFrame([(*k, v) for k, v in new.items()], FACT))
                facts |= new
            elif what == "replace":
                facts = {("d0", 1): "again"}
                change.replace("facts", spark.createDataFrame([("d0", 1, "again")], FACT))
            elif what == "delete":
                gone = {f"d{rng.randrange(6)}"}
                change.delete("facts", spark.createDataFrame([(g,) for g in gone], "document_id string"), ["document_id"])
                facts = {k: v for k, v in facts.items() if k[0] not in gone}
            elif what == "merge":
                new = [(rng.randrange(4), rng.randrange(4), rng.randrange(100) * 100 + k, f"n{step}") for k in range(rng.randint(1, 5))]
                change.upsert("rel", spark.createDataFrame(new, REL), order=["version"])
                for a, b, v, n in new:
                    rel[a, b] = max(rel.get((a, b), (-1, "")), (v, n))
            else:
                gone = rng.randrange(4)
                change.delete("rel", spark.createDataFrame([(gone,)], "b long"), ["b"])
                rel = {k: v for k, v in rel.items() if k[1] != gone}
        change.commit()
        want = {"facts": sorted((*k, v) for k, v in facts.items()), "rel": sorted((*k, *v) for k, v in rel.items())}
        assert contents(store) == want
        seen.append((store.snapshot(), want))
    for snapshot, want in seen:  # readers keep to the snapshot they opened
        assert contents(store, snapshot) == want
    store.compact()
    assert contents(store) == seen[-1][1] and all(not t["marks"] and len(t["parts"]) <= 1 for t in store.snapshot()["tables"].values())
    store.vacuum(keep=1)
    assert contents(store) == seen[-1][1] and len(store.versions()) == 1


def test_killed_and_conflicting_changes(spark, tmp_path, monkeypatch):
    store = VersionedTables(spark, str(tmp_path / "s"), TABLES, buckets=4)
    row = lambda *r: spark.createDataFrame([r], FACT)
    change = store.begin()
    change.append("facts", row("d", 1, "old"))
    assert change.commit() == 1

    def killed(*_):
        raise KeyboardInterrupt

    change = store.begin()
    change.upsert("facts", row("d", 1, "new"))
    change.delete("rel", spark.createDataFrame([(1,)], "a long"), ["a"])
    with monkeypatch.context() as m:
        m.setattr(files, "write_new", killed)
        with pytest.raises(KeyboardInterrupt):
            change.commit()
    assert contents(store)["facts"] == [("d", 1, "old")]
    first, second = store.begin(), store.begin()
    first.upsert("facts", row("d", 2, "first"))
    second.upsert("facts", row("d", 2, "second"))
    first.commit()
    with pytest.raises(Conflict):
        second.commit()
    assert contents(store)["facts"] == [("d", 1, "old"), ("d", 2, "first")]
    store.vacuum(keep=1)  # what the killed and the refused change wrote
    assert len(files.names(spark, f"{store.folder}/facts")) == 2
    assert contents(store)["facts"] == [("d", 1, "old"), ("d", 2, "first")]


def test_only_touched_buckets_are_read(spark, tmp_path):
    store = VersionedTables(spark, str(tmp_path / "s"), TABLES, buckets=16)
    change = store.begin()
    change.append("facts", spark.range(200).selectExpr("concat('d', id) AS document_id", "id AS fact_id", "'v' AS value"))
    change.commit()
    change = store.begin()
    state = change.state["tables"]["facts"]
    buckets = change._buckets_of("facts", spark.createDataFrame([("d7",)], "document_id string"))
    live = store._live("facts", state, buckets)
    assert len(buckets) == 1 and 0 < len(live.inputFiles()) <= 16 and live.count() < 60
    assert "PartitionFilters: [isnotnull(_bucket" in live._jdf.queryExecution().executedPlan().toString()


def test_columns_may_come_but_not_change(spark, tmp_path):
    store = VersionedTables(spark, str(tmp_path / "s"), TABLES)
    change = store.begin()
    change.append("facts", spark.createDataFrame([("d", 1, "x")], FACT))
    change.append("facts", spark.createDataFrame([("e", 2, "y", 3)], FACT + ", more int"))
    change.commit()
    assert sorted(tuple(r) for r in store.read("facts").collect()) == [("d", 1, "x", None), ("e", 2, "y", 3)]
    with pytest.raises(ValueError):
        store.begin().append("facts", spark.createDataFrame([("e", 2, 5)], "document_id string, fact_id long, value int"))
