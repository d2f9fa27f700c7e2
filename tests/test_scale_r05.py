"""What grows with documents: calls of the provider, facts and pages that are stored, blocks of one document."""

from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

from claimweave import process
from claimweave.engine import Settings
from claimweave.operators import evaluation, pages, pairs
from claimweave.plans import queries_claims
from claimweave.process import Workspace
from claimweave.sources.versioned import Change, VersionedTables
from claimweave.streaming import incremental


def _provider():
    """Not a function of this module, which workers can't import."""

    def provide(document, given):
        if any("bad" in text for _, text in given):
            raise ValueError("no answer")
        return [{"page": page, "subject": f"Acme {document}", "predicate": "Revenue", "value": str(page), "quote": text} for page, text in given]

    return provide


def test_documents_are_asked_in_one_pass_over_a_task(spark, tmp_path, monkeypatch):
    def grouped(*args, **kwargs):
        raise AssertionError("a table of its own for each document")

    stored = []
    kinds = {name: getattr(Change, name) for name in ("append", "upsert")}
    for kind, call in kinds.items():
        monkeypatch.setattr(Change, kind, lambda self, name, *a, kind=kind, call=call, **b: (stored.append((kind, name)), call(self, name, *a, **b))[1])
    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInPandas", grouped)
    monkeypatch.setattr(process, "ANSWERS", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # a batch of pages goes on in the next record batch
    try:
        work = Workspace(spark, str(tmp_path / "w"), Settings(batch_pages=2, attempts=1))
        texts = [(k, "\f".join(f"line {k} {p}" + (" bad" if k % 7 == 0 and p == 5 else "") for p in range(1, k % 9 + 2))) for k in range(60)]
        work.submit(spark.createDataFrame(texts, "document_id long, text string"))
        work.process(_provider(), "m", "p", per_round=100)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    facts = {r.document_id: r["count"] for r in work.ledger().facts.groupBy("document_id").count().collect()}
    for row in work.ledger().documents.collect():
        length = row.document_id % 9 + 1
        fails = row.document_id % 7 == 0 and length >= 5
        done = 4 if fails else length
        assert (row.status, row.processed_page_count, row.extraction_batch_count, facts[row.document_id]) == ("failed" if fails else "completed", done, -(-done // 2), done)
    # Keys of a new batch's facts and of new documents' pages are new: wide rows aren't sorted to tell them apart.
    assert {("append", "pages"), ("append", "facts"), ("append", "quarantine")} <= set(stored)
    assert not {("upsert", "pages"), ("upsert", "facts"), ("upsert", "quarantine")} & set(stored)


def test_an_id_that_comes_again_has_its_pages_once(spark, tmp_path):
    work = Workspace(spark, str(tmp_path / "w"))
    work.submit(spark.createDataFrame([(1, "a\fb"), (1, "a\fb"), (2, "c"), (3, "c")], "document_id long, text string"))
    rows = lambda: sorted(tuple(r) for r in work.ledger().pages.select("document_id", "page", "text").collect())
    assert rows() == [(1, 1, "a"), (1, 2, "b"), (2, 1, "c")]
    work.submit(spark.createDataFrame([(4, "d\fe"), (5, "a\fb")], "document_id long, text string"))
    assert rows() == [(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (4, 1, "d"), (4, 2, "e")]
    assert work.ledger().documents.count() == 3


def test_blocks_of_one_document_have_no_pairs(spark):
    rows = [(k, k % 3, f"e{k % 5}" if k < 30 else f"alone{k % 3}" if k < 60 else None, "p") for k in range(70)]
    facts = spark.createDataFrame(rows, "fact_id long, document_id long, entity_key string, predicate_key string")
    new = spark.createDataFrame([(0,)], "document_id long")
    kept = pairs.in_shared_blocks(facts)
    assert {r.fact_id for r in kept.collect()} == set(range(30))
    whole, cut = (pairs.delta_pairs(f, new).select("a_fact_id", "b_fact_id") for f in (facts, kept))
    assert whole.count() == 40 and whole.exceptAll(cut).isEmpty() and cut.exceptAll(whole).isEmpty()


def test_contents_are_not_sent_to_the_driver(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(k, None if k % 11 == 0 else f"text {k % 40}") for k in range(100)], "document_id long, text string")
    plans = []
    for kind, call in {name: getattr(Change, name) for name in ("append", "upsert")}.items():
        monkeypatch.setattr(Change, kind, lambda self, name, rows, *a, call=call, **b: (plans.append(rows), call(self, name, rows, *a, **b))[1])
    tables = VersionedTables(spark, str(tmp_path / "seen"), incremental.SEEN)
    work = incremental.arrival_writer(tables)
    for number in range(3):
        work(docs.where(f"document_id div 34 = {number}"), number)
    whole = pages.first_by_hash(docs, "document_id").select("document_id", "sha256", "first_id", "duplicate_reused")
    got = tables.read("arrivals").select(whole.columns)
    assert got.exceptAll(whole).isEmpty() and whole.exceptAll(got).isEmpty()
    assert len(plans) == 6
    for rows in (whole, *plans):
        assert "BroadcastHashJoin" not in rows._jdf.queryExecution().sparkPlan().toString()


def test_only_facts_in_scope_are_signed_and_spread(spark, sf, monkeypatch):
    asked, sign = [], evaluation.with_signature
    monkeypatch.setattr(evaluation, "with_signature", lambda facts, *a, **b: (asked.append(facts), sign(facts, *a, **b))[1])
    expected, scoped, matches = queries_claims._matched(spark, sf)
    n = [f.count() for f in asked]
    assert n == [expected.count(), scoped.count()] and n[1] < queries_claims._labelled(spark, sf)[1].count()
    assert all(f.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism for f in asked)
    # The row of counts doesn't sign facts once more.
    plan = evaluation.precision_recall(expected, scoped, matches)._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" not in plan and "percentile_approx" not in plan


def test_numbers_of_rows_with_and_without_frequent_keys(spark):
    rows = spark.createDataFrame([(f"k{i % 3}" if i % 2 else f"r{i}", i) for i in range(300)], "k string, o long")
    whole, cut = (evaluation.numbered(rows, "k", "o", "n", part) for part in (1000, 7))
    assert whole.schema["n"].dataType == cut.schema["n"].dataType
    assert {tuple(r) for r in whole.select("k", "o", "n").collect()} == {tuple(r) for r in cut.select("k", "o", "n").collect()}
    assert "percentile_approx" not in whole._jdf.queryExecution().optimizedPlan().toString()
