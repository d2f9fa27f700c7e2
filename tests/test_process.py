"""The process loop: resume behind the last commit, failures, duplicates, retries, deletions."""

import os

import pytest
from pyspark.sql import functions as F

from claimweave.engine import Ledger, Settings
from claimweave.process import NO_PAGES, Workspace

SMALL = Settings(batch_pages=2, backoff=0.0)
COUNTERS = ("status", "processed_page_count", "extraction_batch_count", "provider_attempt_count", "retry_count")


def files(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "document_id string, text string")


def reader(folder, fail_on=None, flaky=None):
    """A provider that reads claims off its pages, notes each call in a folder, and fails on a page as told."""
    import os  # for the workers: they can't import this module

    def claim(page, subject, value):
        return {"page": page, "subject": subject, "predicate": "Revenue", "value": value, "currency": "USD", "temporal_scope": "FY2024", "quote": f"{subject} revenue {value}"}

    def provide(document, given):
        name = f"{document}-{given[0][0]}"
        with open(os.path.join(folder, name), "a") as f:
            f.write("x")
        if fail_on and any(fail_on in text for _, text in given):
            raise ValueError("no answer")
        if flaky and flaky in given[0][1] and os.path.getsize(os.path.join(folder, name)) < 3:
            raise ConnectionError("later")
        out = []
        for page, text in given:
            subject, _, value = text.split()[:3]
            out.append(claim(page, subject, value))
        return [*out, out[0], claim(given[0][0], " ", "1"), claim(99, "Acme", "7")]

    return provide


def states(work):
    return {r.document_id: tuple(r[c] for c in COUNTERS) for r in work.ledger().documents.collect()}


def test_resume_after_failure(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    work = Workspace(spark, str(tmp_path / "w"), SMALL)
    long = "\f".join(f"Acme revenue {k}" + (" bad" if k == 5 else "") for k in range(1, 8))
    taken = {r.document_id: (r.used_id, r.status, r.duplicate_reused) for r in work.submit(files(spark, a=long, b="Nord revenue 5\fNord revenue 6", c="Nord revenue 5\fNord revenue 6", d=None, e="Acme revenue 1 flaky")).collect()}
    assert taken == {"a": ("a", "queued", False), "b": ("b", "queued", False), "c": ("b", "queued", True), "d": ("d", "queued", False), "e": ("e", "queued", False)}
    work.process(reader(str(calls), fail_on="bad", flaky="flaky"), "m", "p", per_round=2)
    assert states(work) == {"a": ("failed", 4, 2, 2, 0), "b": ("completed", 2, 1, 1, 0), "d": ("failed", 0, 0, 0, 0), "e": ("completed", 1, 1, 3, 0)}
    book = work.ledger()
    assert {r.document_id: r.failure_reason for r in book.documents.where("status = 'failed'").collect()} == {"a": "ValueError: no answer", "d": NO_PAGES}
    # Each batch's candidates are stored once: two claims of a page, the equal one as well, and the cited page that wasn't supplied.
    count = lambda: {r.document_id: r["count"] for r in work.ledger().facts.groupBy("document_id").count().collect()}
    assert count() == {"a": 8, "b": 4, "e": 3}
    assert book.facts.where("page = 99").select("status", "eligible").distinct().collect()[0][:] == ("failed", False)
    assert book.quarantine.groupBy("problem").count().collect()[0][:] == ("blank subject", 4)
    before = {r.fact_id for r in book.facts.collect()}
    # a goes on at its third batch; its calls of the first two are not repeated.
    again = {r.document_id: (r.status, r.duplicate_reused, r.retry_started) for r in work.submit(files(spark, x=long, y="Nord revenue 5\fNord revenue 6"), retry_failed=True, model="m", prompt_version="p").collect()}
    assert again == {"x": ("queued", False, True), "y": ("completed", True, False)}
    work.process(reader(str(calls)), "m", "p", per_round=2)
    assert states(work)["a"] == ("completed", 7, 4, 4, 1)
    assert count() == {"a": 15, "b": 4, "e": 3} and before <= {r.fact_id for r in work.ledger().facts.collect()}
    assert {f: os.path.getsize(calls / f) for f in os.listdir(calls)} == {"a-1": 1, "a-3": 1, "a-5": 2, "a-7": 1, "b-1": 1, "e-1": 3}
    pairs = {frozenset((r.fact_a.document_id, r.fact_b.document_id)) for r in work.ledger().decisions(limit=500).collect()}
    assert pairs == {frozenset("ae")}


def test_another_model_starts_anew(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    work = Workspace(spark, str(tmp_path / "w"), SMALL)
    text = "\f".join(["Acme revenue 1", "Acme revenue 2", "Acme revenue 3 bad"])
    work.submit(files(spark, a=text))
    work.process(reader(str(calls), fail_on="bad"), "m", "p")
    assert states(work)["a"] == ("failed", 2, 1, 1, 0) and work.ledger().facts.count() == 4
    work.retry(spark.createDataFrame([("a",)], "document_id string"), "other", "p")
    assert states(work)["a"] == ("queued", 0, 0, 0, 1) and work.ledger().facts.count() == 0 and work.ledger().pages.count() == 3
    work.process(reader(str(calls)), "other", "p")
    assert states(work)["a"] == ("completed", 3, 2, 2, 1) and work.ledger().facts.count() == 7


def test_a_killed_run_is_taken_up(spark, tmp_path, monkeypatch):
    calls = tmp_path / "calls"
    calls.mkdir()
    work = Workspace(spark, str(tmp_path / "w"), SMALL)
    work.submit(files(spark, a="\f".join(f"Acme revenue {k}" for k in range(1, 7)), b="Acme revenue 1"))
    from claimweave.sources import files as small_files

    rounds, write = [], small_files.write_new

    def dies(*args):
        rounds.append(1)
        if len(rounds) == 4:  # begin, two rounds, then killed before the third round's commit
            raise KeyboardInterrupt
        write(*args)

    with monkeypatch.context() as m:
        m.setattr(small_files, "write_new", dies)
        with pytest.raises(KeyboardInterrupt):
            work.process(reader(str(calls)), "m", "p", per_round=1)
    assert states(work)["a"] == ("extracting", 4, 2, 2, 0)
    work.process(reader(str(calls)), "m", "p", per_round=1)
    assert states(work) == {"a": ("completed", 6, 3, 3, 0), "b": ("completed", 1, 1, 1, 0)}
    assert work.ledger().facts.groupBy("document_id").count().orderBy("document_id").collect()[0][:] == ("a", 12)


def test_deletion_and_rewriting_the_same_folder(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    work = Workspace(spark, str(tmp_path / "w"), SMALL)
    work.submit(files(spark, a="Acme revenue 1", b="Acme revenue 2", c="Acme revenue 3"))
    work.process(reader(str(calls)), "m", "p")
    size = lambda: tuple(t.count() for t in (work.ledger().documents, work.ledger().pages, work.ledger().facts, work.ledger().relationships))
    assert size() == (3, 3, 9, 12)
    old = work.ledger()
    work.delete(spark.createDataFrame([("b",)], "document_id string"))
    assert size() == (2, 2, 6, 4) and old.facts.count() == 9
    # A ledger read from a folder, changed, and written to it again.
    gone = spark.createDataFrame([("c",)], "document_id string")
    Ledger.read(spark, work.folder).delete(gone).write(work.folder, "overwrite")
    assert size() == (1, 1, 3, 0)
    Ledger.read(spark, work.folder).write(work.folder)  # the same rows once more
    assert size() == (1, 1, 3, 0)
    failed = work.ledger()
    marked = Ledger(failed.documents.withColumn("status", F.lit("failed")), failed.pages, failed.facts, failed.relationships)
    marked.retry("m", "p").write(work.folder, "overwrite")
    assert states(work)["a"] == ("queued", 1, 1, 1, 1) and size() == (1, 1, 3, 0)


def test_relationships_by_pair(spark, tmp_path):
    work = Workspace(spark, str(tmp_path / "w"))
    rel = lambda *rows: spark.createDataFrame(rows, "fact_a_id string, fact_b_id string, classification string, version long")
    work.save_relationships(rel(("x", "a", "contradicts", 1), ("a", "b", "uncertain", 5)))
    work.save_relationships(rel(("a", "x", "reconciled", 2), ("b", "a", "corroborates", 3)), order=["version"])
    assert {tuple(r) for r in work.tables.read("relationships").collect()} == {("a", "x", "reconciled", 2), ("a", "b", "uncertain", 5)}
