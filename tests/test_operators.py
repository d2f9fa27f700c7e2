"""Fixture rows of normalisation, periods, evidence, classification, pages, seams and streaming."""

import difflib
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from claimweave import engine
from claimweave.functions import keys, numbers, periods
from claimweave.operators import classify, evaluation, evidence, pages, pairs
from claimweave.plans import catalogue
from claimweave.plans.queries_text import CASES, EXPECTED
from claimweave.sources import seams
from claimweave.sources.versioned import VersionedTables
from claimweave.streaming import incremental


def test_values(spark):
    rows = spark.createDataFrame([(k, *c) for k, c in enumerate(CASES)], "k int, value string, unit string, currency string")
    for r in numbers.normalize_values(rows).collect():
        kind, number, text, unit, dimension, currency, step = EXPECTED[r.k]
        assert (r.kind, r.text_value, r.canonical_unit, r.dimension, r.canonical_currency) == (kind, text, unit, dimension, currency), r.value
        assert r.number == (Decimal(number) if number else None) and r.step == (Decimal(step) if step else None), r.value


def test_numbers_too_long_for_the_native_path(spark):
    rows = spark.createDataFrame([("123456789012345678901", "trillion", None), ("0.12345678", None, None), ("2.50", "km", None)], "value string, unit string, currency string")
    got = [r.number_text for r in numbers.exact_numbers(numbers.normalize_values(rows)).orderBy("value").collect()]
    assert got == ["0.12345678", "123456789012345678901000000000000", "2500"]


PERIODS = [
    ("FY2024", "2023-04-01", "2024-03-31", "fiscal_year"), ("Fiscal 2019", "2018-04-01", "2019-03-31", "fiscal_year"), ("Financial year 2023-24", "2023-04-01", "2024-03-31", "fiscal_year"),
    ("Q4 FY24", "2024-01-01", "2024-03-31", "quarter"), ("nine months ended December 31, 2023", "2023-04-01", "2023-12-31", "multi_month"), ("three months ended June 30, 2024", "2024-04-01", "2024-06-30", "quarter"),
    ("year ended March 31, 2024", "2023-04-01", "2024-03-31", "year"), ("as of March 31, 2024", "2024-03-31", "2024-03-31", "point_in_time"), ("March 2024", "2024-03-01", "2024-03-31", "month"), ("2024", "2024-01-01", "2024-12-31", "year"),
    ("January 1, 2024 to March 31, 2024", "2024-01-01", "2024-03-31", "date_range"), ("the current reporting period", "None", "None", "unknown"),
]


def test_periods(spark):
    rows = spark.createDataFrame([(p[0],) for p in PERIODS], "t string").select("t", periods.parse_period(F.col("t")).alias("p"))
    got = {r.t: (str(r.p.start), str(r.p.end), r.p.granularity) for r in rows.collect()}
    assert got == {t: rest for t, *rest in ((p[0], *p[1:]) for p in PERIODS) for rest in [tuple(rest)]}


def test_entity_keys(spark):
    rows = spark.createDataFrame([("The Acme & Logistics Pvt. Ltd.",), ("Delhi Limited",), ("Delhi Corp Limited",), ("DLVR",), ("Straße ﬁ",)], "n string")
    aliases = spark.createDataFrame([("DLVR", "Delhi Limited")], "alias string, canonical string")
    got = {r.n: (r.entity_key, r.alias_applied, r.removed_suffixes) for r in keys.normalize_entities(rows, "n", aliases).collect()}
    assert got["The Acme & Logistics Pvt. Ltd."] == ("acme and logistics", False, ["pvt", "ltd"])
    assert got["Delhi Limited"][0] == "delhi" and got["Delhi Corp Limited"][0] == "delhi corp" and got["DLVR"][:2] == ("delhi", True)
    assert {r.n: r.k for r in rows.select("n", keys.comparison_key(keys.folded(F.col("n"))).alias("k")).collect()}["Straße ﬁ"] == "strasse fi"


EVIDENCE = [
    ("Overview\nRevenue increased by 10% in FY2024.\nEnd", "Revenue increased by 10% in FY2024.", "exact", None),
    ("Revenue increased  by 10%\nfor the financial year.", "Revenue increased by 10% for the financial year.", "normalized", None),
    ("The company expanded its inter-\nnational delivery network in FY2024.", "expanded its international delivery network", "normalized", None),
    ("Revenue from contracts increased to INR 10,245 million during FY2024.", "Revenue from contract increased to INR 10,245 million during FY2024.", "fuzzy", None),
    ("Revenue increased by 10% in FY2024.", "The board declared an interim dividend.", "none", evidence.NOT_FOUND),
    ("Revenue was 100.", "Reveneu", "none", evidence.TOO_SHORT), ("Some text", "  ", "none", evidence.NO_TEXT), (None, "x", "none", evidence.OUTSIDE),
]


def test_evidence(spark):
    rows = spark.createDataFrame([(k, *e[:2]) for k, e in enumerate(EVIDENCE)], "k int, text string, quote string")
    got = evidence.align(rows).collect()
    assert len(got) == len(EVIDENCE)
    for r in got:
        assert (r.method, r.failure_reason) == EVIDENCE[r.k][2:], r.quote
        if r.status == "verified":
            assert r.source_quote == r.text[r.start_offset : r.end_offset]


@pytest.mark.parametrize("seed", range(3))
def test_wider_space_keeps_a_quote_verified(spark, seed):
    rng = random.Random(seed)
    words = [rng.choice(["alpha", "beta", "gamma", "delta", "12%"]) for _ in range(60)]
    text = "".join(w + rng.choice([" ", "  ", "\n", " \t "]) for w in words)
    rows = spark.createDataFrame([(text, " ".join(words[k : k + 8])) for k in range(0, 50, 10)], "text string, quote string")
    assert {r.status for r in evidence.align(rows).collect()} == {"verified"}


def claim(k, document, value="100", unit=None, currency=None, temporal_scope="FY2024", scope=None, data_vintage=None, subject="Acme Ltd.", predicate="Revenue"):
    return (k, document, subject, predicate, value, unit, currency, temporal_scope, scope, data_vintage)


CLASSES = [
    (dict(), dict(), "corroborates", ""), (dict(), dict(value="120"), "contradicts", ""), (dict(), dict(value="101"), "contradicts", ""), (dict(temporal_scope="FY2023"), dict(value="120"), "reconciled", "time_period"),
    (dict(value="1", unit="kilometre"), dict(value="1000", unit="metres"), "reconciled", "unit"), (dict(scope="India"), dict(value="120", scope="Global"), "reconciled", "scope"),
    (dict(value="6.4", data_vintage="30 April 2024"), dict(value="6.5", data_vintage="31 May 2024"), "uncertain", ""), (dict(value="12.7", unit="percent"), dict(value="13", unit="percent"), "reconciled", "rounding"),
    (dict(value="1", unit="kilometre"), dict(value="1", unit="kilogram"), "uncertain", ""), (dict(value="1", unit="box"), dict(value="1", unit="pallet"), "uncertain", ""), (dict(value="Strong growth"), dict(value="strong growth"), "corroborates", ""),
    (dict(value="Strong growth"), dict(value="Weak growth"), "contradicts", ""), (dict(), dict(value="Not disclosed"), "uncertain", ""), (dict(temporal_scope=None), dict(value="120", temporal_scope=None), "contradicts", ""),
    (dict(temporal_scope=None), dict(value="120"), "uncertain", ""), (dict(temporal_scope="current period"), dict(value="120", temporal_scope="CURRENT PERIOD"), "contradicts", ""),
    (dict(temporal_scope="current period"), dict(value="120", temporal_scope="latest period"), "uncertain", ""), (dict(currency="INR"), dict(currency="USD"), "uncertain", ""), (dict(scope="India"), dict(value="120"), "uncertain", ""),
]


def test_classes(spark):
    rows = []
    for k, (a, b, _, _) in enumerate(CLASSES):
        rows += [claim(2 * k, "a", **a, predicate=f"p{k}"), claim(2 * k + 1, "b", **b, predicate=f"p{k}")]
    facts = engine.normalize_facts(spark.createDataFrame(rows, "fact_id long, document_id string, subject string, predicate string, value string, unit string, currency string, temporal_scope string, scope string, data_vintage string"))
    got = classify.classify(pairs.block_pairs(facts)).collect()
    assert len(got) == len(CLASSES)
    for r in got:
        k = r.a_fact_id // 2
        if k == 6:  # a vintage that is a bare date isn't a period; unequal texts leave it open
            assert r.classification in ("uncertain", "reconciled")
            continue
        assert (r.classification, ",".join(r.reasons)) == CLASSES[k][2:], CLASSES[k]
        assert [s.ord for s in r.trace] == list(range(1, 10))


def test_pages_and_batches(spark):
    docs = spark.createDataFrame([("d", "one\ftwo\f\fthree"), ("e", "")], "document_id string, text string")
    made = pages.to_pages(docs)
    assert pages.layout_violations(made, docs).count() == 0
    assert {(r.document_id, r.text) for r in pages.document_text(made).collect()} == {("d", "one\ftwo\f\fthree"), ("e", "")}
    sized = spark.createDataFrame([("d", k, "x" * n) for k, n in ((1, 10), (2, 10), (3, 30))], "document_id string, page int, text string")
    assert [r.batch for r in pages.page_batches(sized, 15, 2).orderBy("page").collect()] == [1, 2, 3]


def test_seams(spark, tmp_path):
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return "done"

    assert seams.retrying(flaky, 4, 0.25, waits.append) == ("done", 3) and waits == [0.25, 0.5]
    calls.clear()
    with pytest.raises(ConnectionError):
        seams.retrying(flaky, 2, 0.25, waits.append)
    calls.clear()
    with pytest.raises(ZeroDivisionError):  # not an error that passes
        seams.retrying(lambda: calls.append(1) or 1 // 0, 4, 0.25, waits.append)
    assert len(calls) == 1
    for name, content in (("a.pdf", b"%PDF-1 x"), ("c.pdf", b"junk")):
        (tmp_path / name).write_bytes(content)
    empty = spark.createDataFrame([("b.pdf", b"", "x")], "file_name string, content binary, sha256 string")
    parsed = seams.parse_files(seams.read_files(spark, str(tmp_path)).union(empty), lambda raw: ["p1", "p2"]).collect()
    assert sorted((r.file_name, r.page, r.error) for r in parsed if r.file_name == "a.pdf") == [("a.pdf", 1, None), ("a.pdf", 2, None)]
    assert {r.error for r in parsed if r.file_name != "a.pdf"} == {"empty", "not_pdf"}


def test_stream_takes_each_content_once(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "document_id long, text string").write.parquet(source)
    stream = spark.readStream.schema("document_id long, text string").parquet(source)
    tables = VersionedTables(spark, str(tmp_path / "seen"), incremental.SEEN)
    incremental.start(stream, incremental.arrival_writer(tables), str(tmp_path / "ck"), once=True).awaitTermination(120)
    assert {r.document_id: r.first_id for r in tables.read("arrivals").collect()} == {1: 1, 2: 1, 3: 3}


def test_alike_names_against_all_pairs(spark):
    rng = random.Random(2)
    bases = ["delhi logistics", "delhivery", "acme steel works", "acme steel", "nord bank", "südwest bank", "x", "ab", "𝒜bc tools"]
    names = bases + ["".join(rng.choice("abcdefgh ") if rng.random() < 0.12 else c for c in rng.choice(bases)) + rng.choice(["", "s", " co"]) for _ in range(50)]
    rows = [(k, f"d{k % 3}", n, f"p{k % 2}") for k, n in enumerate(names)]
    want = {}
    for i, di, x, p in rows:
        for j, dj, y, q in rows:
            if p == q and x != y and (di, i) < (dj, j) and di != dj:
                r = difflib.SequenceMatcher(None, x, y).ratio()
                if 0.82 <= r < 0.97:
                    want["::".join(sorted((str(i), str(j))))] = r
    facts = spark.createDataFrame(rows, "fact_id long, document_id string, entity_key string, predicate_key string")
    found = pairs.ambiguous_pairs(facts, top=None).collect()
    assert want and {r.pair_id: r.similarity for r in found} == want
    assert {r.pair_id: r.similarity for r in pairs.ambiguous_pairs(facts, top=None, part_rows=8).collect()} == want  # frequent letters in cells
    best = pairs.ambiguous_pairs(facts, top=5).collect()
    assert [r.pair_id for r in best] == [k for k, _ in sorted(want.items(), key=lambda x: (-x[1], x[0]))[:5]]


def test_rows_without_content_or_quote_stay(spark):
    docs = spark.createDataFrame([(1, "x"), (2, None), (3, "x"), (4, None)], "document_id long, text string")
    got = {r.document_id: (r.first_id, r.duplicate_reused) for r in pages.first_by_hash(docs, "document_id").collect()}
    assert got == {1: (1, False), 2: (2, False), 3: (1, True), 4: (4, False)}
    rows = spark.createDataFrame([(1, "a page", None), (2, "a page", "page"), (3, None, None)], "k int, text string, quote string")
    assert {r.k: (r.status, r.failure_reason) for r in evidence.align(rows).collect()} == {1: ("failed", evidence.NO_TEXT), 2: ("verified", None), 3: ("failed", evidence.OUTSIDE)}


def test_ledger_round_trip(spark, tmp_path):
    files = spark.createDataFrame([("a", "Acme Ltd revenue was 1.2 trillion USD in FY2024"), ("b", "ACME revenue: 1.2 trillion USD, FY2024"), ("c", "Acmee revenue was 3 trillion USD in FY2024")], "document_id string, text string")

    def provider(asked):
        names = F.when(F.col("document_id") == "a", "Acme Ltd").when(F.col("document_id") == "b", "ＡＣＭＥ").otherwise("Acmee")
        value = F.when(F.col("document_id") == "c", "3 trillion").otherwise("1.2 trillion")
        none = F.lit(None).cast("string")
        return asked.select("document_id", "page", names.alias("subject"), F.lit("Revenue").alias("predicate"), value.alias("value"), none.alias("unit"), F.lit("USD").alias("currency"), F.lit("FY2024").alias("temporal_scope"), none.alias("scope"), none.alias("data_vintage"), F.lit("trillion USD").alias("quote"))

    asked = []

    def resolver(found):
        asked.extend(r.pair_id for r in found.collect())
        return found.select("pair_id", F.lit(True).alias("same_entity"))

    made = engine.Ledger.ingest(files).extract(provider).compare(resolver=resolver)
    folder = str(tmp_path / "ledger")
    made.write(folder)
    book = engine.Ledger.read(spark, folder)
    found = {tuple(sorted((r.fact_a.document_id, r.fact_b.document_id))): r.classification for r in book.decisions().collect()}
    assert found == {("a", "b"): "corroborates", ("a", "c"): "contradicts", ("b", "c"): "contradicts"} and len(asked) == 2
    assert book.document_status("a").select("status", "page_count", "step").first()[:] == ("queued", 1, -1)
    facts, rel = book.export()
    assert (facts.count(), rel.count()) == (3, 3)
    left = book.delete(spark.createDataFrame([("c",)], "document_id string"))
    assert (left.documents.count(), left.pages.count(), left.facts.count(), left.relationships.count()) == (2, 2, 2, 1)
    failed = engine.Ledger(book.documents.withColumn("status", F.when(F.col("document_id") == "a", "failed").otherwise("completed")), book.pages, book.facts, book.relationships)
    again = failed.retry("m", "p")
    assert again.document_status("a").select("status", "retry_count").first()[:] == ("queued", 1)
    assert (again.documents.count(), again.pages.count(), again.facts.count(), again.relationships.count()) == (3, 2, 2, 1)


def test_evaluation_as_a_whole(spark, tmp_path):
    schema = "id string, document_key string, subject string, predicate string, value string, unit string, currency string, temporal_scope string, page int, quote string, ordinal int"
    fact = lambda k, subject, value, page=1, quote="q": (k, "Doc 1", subject, "Revenue", value, None, "USD", "FY2024", page, quote, len(k))
    facts = spark.createDataFrame([fact("e1", "Straße AG", "5 trillion"), fact("e22", "Acme Ltd", "0.12345678"), fact("e333", "Nord", "7")], schema)
    predicted = spark.createDataFrame([fact("p1", "STRASSE AG", "5,000,000 million"), fact("p22", "ＡＣＭＥ", "0.123456780", quote="r"), fact("p333", "Nord", "8"), fact("p4444", "Nord", "7", page=9)], schema)
    scope = spark.createDataFrame([(0, "doc 1", [1])], "ordinal int, document_key string, pages array<int>")
    rel = spark.createDataFrame([("e1", "e22", "contradicts"), ("e1", "e333", "reconciled")], "a string, b string, classification string")
    found = spark.createDataFrame([("p22", "p1", "contradicts", 0)], "a string, b string, classification string, ordinal int")
    done = evaluation.evaluate(scope, facts, rel, predicted, found)
    evaluation.write_results(done, str(tmp_path / "out"))
    r = spark.read.json(str(tmp_path / "out")).first()
    assert (r.true_positives, r.false_positives, r.false_negatives, r.exact_quote_rate) == (2, 1, 1, 0.5)
    assert (r.relationships[0].pairs, r.relationships[0].missing, r.relationships[0].accuracy) == (2, 1, 0.5) and len(r.confusion) == 20


@pytest.mark.parametrize("name", ["decision_counts", "norm_value", "gt_pred_match", "rel_by_document", "parse_period", "incremental_pairs", "signature"])
def test_plans_stay_small(spark, sf, name):
    plan = catalogue.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 100_000


def test_a_block_of_half_the_facts_is_dealt_out(spark):
    rows = [(k, f"d{k % 7}" if k % 11 else None, "hot" if k % 2 else f"e{k % 90}", "p", f"text {k}") for k in range(1200)]
    facts = spark.createDataFrame(rows, "fact_id long, document_id string, entity_key string, predicate_key string, note string").repartition(3)
    found = pairs.block_pairs(facts, part_rows=64)
    got = sorted((r.a_fact_id, r.b_fact_id) for r in found.collect())
    want = sorted((x[0], y[0]) for x in rows for y in rows if x[2] == y[2] and x[1] is not None and y[1] is not None and x[1] != y[1] and (x[1], x[0]) < (y[1], y[0]))
    with_null = {(x[0], y[0]) if x[1] is None else (y[0], x[0]) for x in rows for y in rows if x[2] == y[2] and (x[1] is None) != (y[1] is None)}
    assert set(want) == {p for p in got if p not in with_null} and len(got) == len(set(got)) and set(got) - set(want) == with_null
    shuffled = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    for k, v in shuffled.items():
        spark.conf.set(k, v)
    try:
        made = pairs.block_pairs(facts, part_rows=64).select(F.spark_partition_id().alias("k")).groupBy("k").count().collect()
    finally:
        for k in shuffled:
            spark.conf.unset(k)
    assert len(made) == 4 and max(r["count"] for r in made) < 2 * sum(r["count"] for r in made) / len(made)


def test_fiscal_years(spark):
    from datetime import date

    rows = spark.createDataFrame([(24, None), (2024, None), (99, 0), (2023, 24), (1999, 2000), (2019, 22), (1998, None)], "a int, b int")
    got = {}
    for month in (1, 4, 10):
        start, end = periods.fiscal_bounds(F.col("a"), F.col("b"), month)
        got |= {(r.a, r.b, month): (r.s, r.e) for r in rows.select("a", "b", start.alias("s"), end.alias("e")).collect()}
    d = date
    assert got[24, None, 1] == (d(2024, 1, 1), d(2024, 12, 31)) and got[24, None, 4] == got[2024, None, 4] == (d(2023, 4, 1), d(2024, 3, 31)) and got[1998, None, 10] == (d(1997, 10, 1), d(1998, 9, 30))
    assert got[99, 0, 4] == got[1999, 2000, 4] == (d(1999, 4, 1), d(2000, 3, 31)) and got[2023, 24, 10] == (d(2023, 10, 1), d(2024, 9, 30)) and got[2023, 24, 1] == (d(2023, 1, 1), d(2023, 12, 31))
    assert got[2019, 22, 4] == (d(2019, 4, 1), d(2022, 3, 31))


def test_common_length():
    rng = random.Random(12)
    for _ in range(200):
        p, q = ("".join(rng.choices("abcé𝒜 ", k=rng.randrange(12))) for _ in range(2))
        table = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
        for i, x in enumerate(p):
            for j, y in enumerate(q):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert pairs.common_length(p, q) == table[-1][-1]


def test_numbers_within_a_frequent_key(spark):
    rng = random.Random(4)
    rows = [(f"{i}", "hot" if i % 3 else f"s{i % 5}", k, f"q{i % 4}") for i, k in enumerate(rng.sample(range(5000), 600))]
    df = spark.createDataFrame(rows, "id string, sig string, ordinal int, quote string")
    got = {r.id: r.n for r in evaluation.numbered(df, "sig", "ordinal", "n", part_rows=50).collect()}
    want = {}
    for sig in {r[1] for r in rows}:
        want |= {r[0]: n for n, r in enumerate(sorted((r for r in rows if r[1] == sig), key=lambda r: r[2]), 1)}
    assert got == want
    other = spark.createDataFrame([(f"p{r[0]}", r[1], r[2], r[3]) for r in rows if r[2] % 2] + [("pn", None, 0, "q")], df.schema)
    plain = evaluation.bag_match(df.union(spark.createDataFrame([("n", None, 9, "q")], df.schema)), other, ["sig"])
    cut = evaluation.bag_match(df.union(spark.createDataFrame([("n", None, 9, "q")], df.schema)), other, ["sig"], part_rows=50)
    assert sorted(plain.collect()) == sorted(cut.collect()) and ("n", "pn", True) in {tuple(r) for r in plain.collect()}


def test_pages_by_the_last_id(spark):
    from claimweave.operators import store

    rel = spark.createDataFrame([(f"r{k:03}", "contradicts" if k % 2 else "uncertain") for k in range(50)], "relationship_id string, classification string")
    by_offset, by_id, last = [], [], None
    for k in range(0, 50, 7):
        by_offset += [r[0] for r in store.relationship_page(rel, offset=k, limit=7).collect()]
        page = [r[0] for r in store.relationship_page(rel, limit=7, after=last).collect()]
        by_id, last = by_id + page, page[-1]
    assert by_id == by_offset == [f"r{k:03}" for k in range(50)]
