"""Queries of pairing, classification, the ledger and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.functions.fixed_values import CHECKS
from claimweave.engine import Ledger, Settings
from claimweave.operators import classify, evaluation, pairs, store
from claimweave.process import Workspace
from claimweave.sources.scratch import new_path

from .claims import CLAIMS_SQL, normal_claims, settled_claims, settled_keys, table

OUT = [f"out_{c}" for c in CHECKS]


def _ids(df: DataFrame) -> list[Column]:
    return [F.col("a_fact_id").alias("a_id"), F.col("b_fact_id").alias("b_id")]


def decisions(spark, sf, facts: DataFrame | None = None) -> DataFrame:
    return classify.classify(pairs.block_pairs(settled_claims(spark, sf) if facts is None else facts))


def block_pairs(spark, sf):
    p = pairs.block_pairs(settled_keys(spark, sf))
    return p.select(*_ids(p), F.col("a_document_id").alias("a_doc"), F.col("b_document_id").alias("b_doc"))


def delta_pairs(spark, sf):
    facts = settled_keys(spark, sf)
    new = facts.where("document_id IN ('1-URGENT', '5-LOW')")
    p = pairs.delta_pairs(facts, new)
    return p.select(*_ids(p))


def resolved_pairs(spark, sf):
    """Tie-breaks between each supplier and the next, on their nation."""
    s = table(spark, sf, "supplier")
    facts = s.select(F.col("s_suppkey").alias("fact_id"), (F.col("s_suppkey") % 3).alias("document_id"), F.lower("s_name").alias("entity_key"), F.col("s_nationkey").cast("string").alias("predicate_key"))
    asked = s.select(pairs.pair_id(F.col("s_suppkey"), F.col("s_suppkey") + 1).alias("pair_id"), (F.col("s_suppkey") % 2 == 0).alias("same_entity"), F.lit(0.9).alias("similarity"))
    near = s.select(pairs.pair_id(F.col("s_suppkey"), F.col("s_suppkey") + 25).alias("pair_id"), F.lit(True).alias("same_entity"), F.lit(0.85).alias("similarity"))
    p = pairs.resolved_pairs(facts, asked.unionByName(near))
    return p.select(*_ids(p), F.col("similarity").cast("decimal(18,6)").alias("similarity"))


def ambiguous_pairs(spark, sf):
    s = table(spark, sf, "supplier").where("s_suppkey IS NOT NULL")
    facts = s.select(F.col("s_suppkey").alias("fact_id"), (F.col("s_suppkey") % 3).alias("document_id"), F.lower("s_name").alias("entity_key"), F.col("s_nationkey").cast("string").alias("predicate_key"))
    return pairs.ambiguous_pairs(facts, top=None)


def topk_ambiguous(spark, sf):
    s = table(spark, sf, "supplier")
    facts = s.select(F.col("s_suppkey").alias("fact_id"), (F.col("s_suppkey") % 3).alias("document_id"), F.lower("s_name").alias("entity_key"), F.col("s_nationkey").cast("string").alias("predicate_key"))
    return pairs.ambiguous_pairs(facts)


def trace_outcomes(spark, sf):
    d = decisions(spark, sf)
    return d.select(*_ids(d), "classification", F.array_join("reasons", ",").alias("reason"), *OUT)


def check(name):
    def run(spark, sf):
        d = decisions(spark, sf)
        return d.groupBy(f"out_{name}").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed(f"out_{name}", "outcome")

    return run


def decision_counts(spark, sf):
    d = decisions(spark, sf)
    return d.groupBy("classification", F.array_join("reasons", ",").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def trace_complete(spark, sf):
    """Whole traces as text: nine steps in order, with their outcomes."""
    d = decisions(spark, sf)
    steps = F.array_join(F.transform(classify.steps(), lambda s: F.concat_ws(" ", s["ord"].cast("string"), s["check"], s["outcome"])), ";")
    return d.select(*_ids(d), steps.alias("steps"))


def conf_classification(spark, sf):
    d = decisions(spark, sf)
    value = classify.classification_confidence(classify.steps()).cast("decimal(18,6)")
    return d.select(*_ids(d), value.alias("confidence"))


def display_value(spark, sf):
    c = normal_claims(spark, sf)
    return c.select("fact_id", F.col("number").cast("decimal(18,2)").alias("shown"))


_OUTCOMES = f"WITH {CLAIMS_SQL}"
CHECK_SQL = {f"chk{k}_{name}": f"{_OUTCOMES} SELECT out_{c} AS outcome, count(*) AS n FROM outcomes GROUP BY 1" for k, name, c in zip(range(1, 10), ("entity", "predicate", "value", "rounding", "time", "vintage", "unit", "currency", "scope"), CHECKS)}


# ---- ledger ----

def relationships(spark, sf, facts: DataFrame | None = None):
    """Relationships of facts that are settled already, if given."""
    d = decisions(spark, sf, facts)
    return d.select(F.least("a_fact_id", "b_fact_id").alias("fact_a_id"), F.greatest("a_fact_id", "b_fact_id").alias("fact_b_id"), "classification").withColumn("relationship_id", F.concat_ws("-", "fact_a_id", "fact_b_id"))


REL_SQL = f"{_OUTCOMES}, rel AS (SELECT least(a_id, b_id) AS fact_a_id, greatest(a_id, b_id) AS fact_b_id, classification, least(a_id, b_id) || '-' || greatest(a_id, b_id) AS relationship_id FROM outcomes)"


def events(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("document_id"), F.col("event_type").alias("status"), "ts", F.col("event_id").alias("version"), F.col("value"))


def sink_status(spark, sf):
    return store.latest(events(spark, sf).select("document_id", "status", "ts", "version"), ["document_id"], ["ts", "version"]).select("document_id", "status", "version")


def sink_checkpoint(spark, sf):
    return store.checkpoints(events(spark, sf).select("document_id", "version", F.col("value").cast("decimal(18,6)").alias("counter")))


def sink_pages_once(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page"), F.col("n_chars"))
    return store.pages_once(docs, docs.where("document_id % 3 = 0")).select("document_id", "n_chars")


def workspace(spark, settings: Settings = Settings()) -> Workspace:
    """A new ledger in the shared scratch folder."""
    return Workspace(spark, new_path(spark, "ledger"), settings)


def upsert_relationship(spark, sf):
    """Orders as versions of relationships, stored in two changes, the later orders first."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("fact_a_id"), (F.col("o_orderkey") % 50).cast("string").alias("fact_b_id"), F.col("o_orderstatus").alias("classification"), F.col("o_orderkey").alias("version"))
    work = workspace(spark)
    for half in (o.where("version % 2 = 0"), o.where("version % 2 = 1")):
        work.save_relationships(half, order=["version"])
    return work.tables.read("relationships").select("fact_a_id", "fact_b_id", "classification", "version")


def retry_prepare(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("document_id"), F.when(F.col("doc_id") % 3 == 0, "failed").otherwise("completed").alias("status"), F.lit("x").alias("failure_reason"),
        (F.col("n_chars") % 4).cast("int").alias("processed_page_count"), F.lit(2).alias("extraction_batch_count"), F.lit(3).alias("provider_attempt_count"), F.lit(1).alias("retry_count"),
        F.when(F.col("doc_id") % 2 == 0, "m1").otherwise("m2").alias("checkpoint_model"), F.lit("p1").alias("checkpoint_prompt_version"),
    )
    work = workspace(spark)
    Ledger(docs, docs.where("document_id % 5 != 0").select("document_id", F.lit(1).alias("page"))).write(work.folder)
    work.retry(docs, "m1", "p1")
    again = work.tables.read("documents").where("status = 'queued'")
    return again.select("document_id", "status", "processed_page_count", "extraction_batch_count", "provider_attempt_count", "retry_count", F.col("checkpoint_model").isNotNull().alias("resumes"))


def cascade_delete(spark, sf):
    settled = settled_claims(spark, sf)
    facts = settled.select("fact_id", "document_id")
    docs = facts.select("document_id").distinct()
    work = workspace(spark)
    Ledger(docs, docs.withColumn("page", F.lit(1)), facts, relationships(spark, sf, settled)).write(work.folder)
    work.delete(docs.where("document_id = '1-URGENT'"))
    left = work.tables.read("facts").groupBy().agg(F.count(F.lit(1)).alias("facts"))
    return left.withColumn("relationships", work.tables.read("relationships").agg(F.count(F.lit(1))).scalar())


def process_run(spark, sf):
    """Documents with lines for pages through extraction, retry and comparison; every fifth fails at page 17 the first time."""

    def provider(fails: bool):
        def provide(document, given):
            if fails and document % 5 == 0 and any(page == 17 for page, _ in given):
                raise ValueError("page 17")
            return [{"page": page, "subject": f"Line of {document}" if text else "", "predicate": "Text", "value": str(page), "quote": text[:40]} for page, text in given]

        return provide

    work = workspace(spark, Settings(batch_chars=100_000_000, attempts=1))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "text")
    work.submit(docs, "\n")
    for fails in (True, False):
        work.process(provider(fails), "m", "p", per_round=4096)
        if fails:
            work.retry(work.ledger().documents.where("status = 'failed'"), "m", "p")
    book = work.ledger()
    count = lambda t, name: t.groupBy("document_id").agg(F.count(F.lit(1)).alias(name))
    out = book.documents.join(count(book.facts, "facts"), "document_id", "left").join(count(book.quarantine, "quarantined"), "document_id", "left")
    counters = ("processed_page_count", "extraction_batch_count", "provider_attempt_count", "retry_count")
    return out.select("document_id", "status", *(F.col(c).cast("long").alias(c) for c in counters), F.coalesce("facts", F.lit(0)).alias("facts"), F.coalesce("quarantined", F.lit(0)).alias("quarantined"))


def rel_by_document(spark, sf):
    facts = settled_claims(spark, sf)
    return store.touching(relationships(spark, sf, facts), facts.where("document_id = '2-HIGH'")).select("relationship_id", "classification")


def rel_with_facts(spark, sf):
    settled = settled_claims(spark, sf)
    facts = settled.select("fact_id", "document_id", F.col("number").cast("decimal(18,2)").alias("number"))
    page = store.relationship_page(relationships(spark, sf, settled), "contradicts", offset=5, limit=50)
    return store.with_facts(page, facts).select("relationship_id", F.col("fact_a.document_id").alias("doc_a"), F.col("fact_b.document_id").alias("doc_b"), F.col("fact_a.number").alias("number_a"), F.col("fact_b.number").alias("number_b"))


def filter_rel_class(spark, sf):
    return relationships(spark, sf).where("classification = 'contradicts'").select("relationship_id")


def sort_rel_page(spark, sf):
    return store.relationship_page(relationships(spark, sf), offset=100, limit=100).select("relationship_id", "classification")


def sort_facts(spark, sf):
    f = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("document_id"), F.col("l_linenumber").alias("page"), F.struct("l_orderkey", "l_partkey", "l_suppkey").alias("fact_id"))
    return store.facts_of(f, "A").groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.min("fact_id.l_orderkey").alias("first_order"))


def scan_facts_eligible(spark, sf):
    f = normal_claims(spark, sf).select("fact_id", (F.col("fact_id") % 2 == 0).alias("eligible"), F.when(F.col("fact_id") % 3 != 0, F.struct("entity_key")).alias("normalized"))
    return store.eligible_facts(f).select("fact_id", F.col("normalized.entity_key").alias("entity_key"))


def scan_store(spark, sf):
    return table(spark, sf, "documents").where(F.col("doc_id") == 7).select("doc_id", "lang", "n_chars")


def ui_search(spark, sf):
    f = table(spark, sf, "part").select(F.col("p_partkey").alias("fact_id"), F.col("p_name").alias("subject"), F.col("p_type").alias("predicate"), F.col("p_brand").alias("value"))
    return store.search(f, " Brand#1 ").select("fact_id", "subject")


def ui_counts(spark, sf):
    settled = settled_claims(spark, sf)
    return store.counts(settled.withColumn("eligible", F.col("fact_id") % 3 != 0), relationships(spark, sf, settled))


def related_decisions(spark, sf):
    chosen = table(spark, sf, "orders").where("o_orderkey % 100 = 7").select(F.col("o_orderkey").alias("fact_id"))
    return store.touching(relationships(spark, sf), chosen).select("relationship_id", "classification")


def latest_doc_list(spark, sf):
    docs = store.latest(events(spark, sf).select("document_id", "status", "ts", "version"), ["document_id"], ["ts", "version"])
    return docs.orderBy(F.desc("ts"), F.desc("version")).limit(50).select("document_id", "status", "version")


def lifecycle(spark, sf):
    named = events(spark, sf).withColumn("status", F.element_at(F.array(*map(F.lit, ("queued", "ingesting", "extracting", "verifying", "normalizing", "classifying", "completed", "failed"))), (F.col("version") % 8 + 1).cast("int")))
    last = store.latest(named.select("document_id", "status", "ts", "version"), ["document_id"], ["ts", "version"])
    return last.groupBy("status").agg(F.count(F.lit(1)).alias("documents"), F.min(store.step_index(F.col("status"))).alias("step"))


def exists_pages(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"))
    return docs.join(table(spark, sf, "labels").select(F.col("doc_id").alias("document_id")).distinct(), "document_id", "left_semi")


def export_json_eval(spark, sf):
    settled = settled_claims(spark, sf)
    f = settled.select("fact_id", F.when(F.col("fact_id") % 4 != 0, "verified").otherwise("failed").alias("status"))
    facts, rel = store.export_evaluation(f, relationships(spark, sf, settled))
    return facts.select(F.lit("fact").alias("record"), F.to_json(F.struct("fact_id")).alias("json")).union(rel.select(F.lit("relationship"), F.to_json(F.struct("fact_a_id", "fact_b_id", "classification"))))


def export_json_sample(spark, sf):
    docs = table(spark, sf, "conversations").select(F.col("conv_id").alias("document_id")).distinct()
    facts = table(spark, sf, "conversations").select(F.col("conv_id").alias("document_id"), "turn", "role")
    return store.export_sample(docs, facts)


def incremental_pairs(spark, sf):
    facts = settled_claims(spark, sf)
    d = classify.classify(pairs.delta_pairs(facts, facts.where("document_id = 'restated'")))
    return d.select(*_ids(d), "classification")


def set_ops(spark, sf):
    """Customers who ordered, have no order, or live in a supplier's nation with an order."""
    c, o, s = (table(spark, sf, t) for t in ("customer", "orders", "supplier"))
    ordered = o.select(F.col("o_custkey").alias("c_custkey")).distinct()
    none = c.select("c_custkey").join(ordered, "c_custkey", "left_anti").select(F.lit("anti").alias("op"), "c_custkey")
    both = c.select("c_nationkey").intersect(s.select("s_nationkey")).select(F.lit("intersect"), F.col("c_nationkey").cast("long"))
    return none.union(both)


LEDGER_SQL = {
    "sink_status": "SELECT document_id, status, version FROM (SELECT user_id AS document_id, event_type AS status, event_id AS version, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
    "sink_checkpoint": "SELECT document_id, version, counter FROM (SELECT user_id AS document_id, event_id AS version, CAST(value AS DECIMAL(18,6)) AS counter, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1",
    "sink_pages_once": "SELECT doc_id AS document_id, n_chars FROM documents WHERE doc_id % 3 <> 0",
    "upsert_relationship": "SELECT fact_a_id, fact_b_id, classification, version FROM (SELECT *, row_number() OVER (PARTITION BY fact_a_id, fact_b_id ORDER BY version DESC) AS k FROM (SELECT least(CAST(o_custkey AS VARCHAR), CAST(o_orderkey % 50 AS VARCHAR)) AS fact_a_id, greatest(CAST(o_custkey AS VARCHAR), CAST(o_orderkey % 50 AS VARCHAR)) AS fact_b_id, o_orderstatus AS classification, o_orderkey AS version FROM orders)) WHERE k = 1",
    "retry_prepare": """SELECT doc_id AS document_id, 'queued' AS status, CAST(CASE WHEN keep THEN n_chars % 4 ELSE 0 END AS INTEGER) AS processed_page_count, CASE WHEN keep THEN 2 ELSE 0 END AS extraction_batch_count,
        CASE WHEN keep THEN 3 ELSE 0 END AS provider_attempt_count, 2 AS retry_count, keep AS resumes FROM (SELECT *, n_chars % 4 > 0 AND doc_id % 2 = 0 AND doc_id % 5 <> 0 AS keep FROM documents WHERE doc_id % 3 = 0)""",
    "cascade_delete": f"{_OUTCOMES} SELECT (SELECT count(*) FROM claims WHERE document_id <> '1-URGENT') AS facts, (SELECT count(*) FROM outcomes WHERE a_doc <> '1-URGENT' AND b_doc <> '1-URGENT') AS relationships",
    "process_run": """WITH firsts AS (SELECT doc_id, text FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1 OR text IS NULL),
        p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM firsts WHERE text IS NOT NULL), n AS (SELECT doc_id, count(*) AS pages, count(*) FILTER (line <> '') AS facts FROM p GROUP BY 1)
        SELECT doc_id AS document_id, CASE WHEN pages IS NULL THEN 'failed' ELSE 'completed' END AS status, coalesce(pages, 0) AS processed_page_count, coalesce((pages + 7) // 8, 0) AS extraction_batch_count, coalesce((pages + 7) // 8, 0) AS provider_attempt_count,
        CASE WHEN pages IS NULL OR (doc_id % 5 = 0 AND pages >= 17) THEN 1 ELSE 0 END::BIGINT AS retry_count, coalesce(facts, 0) AS facts, coalesce(pages - facts, 0) AS quarantined FROM firsts LEFT JOIN n USING (doc_id)""",
    "rel_by_document": f"{REL_SQL} SELECT relationship_id, classification FROM rel WHERE fact_a_id IN (SELECT fact_id FROM claims WHERE document_id = '2-HIGH') OR fact_b_id IN (SELECT fact_id FROM claims WHERE document_id = '2-HIGH')",
    "rel_with_facts": f"{REL_SQL}, page AS (SELECT * FROM rel WHERE classification = 'contradicts' ORDER BY relationship_id LIMIT 50 OFFSET 5) SELECT relationship_id, a.document_id AS doc_a, b.document_id AS doc_b, CAST(a.number AS DECIMAL(18,2)) AS number_a, CAST(b.number AS DECIMAL(18,2)) AS number_b FROM page JOIN claims a ON a.fact_id = fact_a_id JOIN claims b ON b.fact_id = fact_b_id",
    "filter_rel_class": f"{REL_SQL} SELECT relationship_id FROM rel WHERE classification = 'contradicts'",
    "sort_rel_page": f"{REL_SQL} SELECT relationship_id, classification FROM rel ORDER BY relationship_id LIMIT 100 OFFSET 100",
    "sort_facts": "SELECT l_linenumber AS page, count(*) AS n, min(l_orderkey) AS first_order FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1",
    "scan_facts_eligible": f"{_OUTCOMES} SELECT fact_id, entity_key FROM claims WHERE fact_id % 2 = 0 AND fact_id % 3 <> 0",
    "scan_store": "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id = 7",
    "ui_search": "SELECT p_partkey AS fact_id, p_name AS subject FROM part WHERE contains(lower(p_name), 'brand#1') OR contains(lower(p_type), 'brand#1') OR contains(lower(p_brand), 'brand#1') OR contains(CAST(p_partkey AS VARCHAR), 'brand#1')",
    "ui_counts": f"{_OUTCOMES} SELECT (SELECT count(*) FROM claims) AS extracted, (SELECT count(*) FROM claims WHERE fact_id % 3 <> 0) AS verified, (SELECT count(*) FROM claims WHERE fact_id % 3 = 0) AS rejected, (SELECT count(*) FROM outcomes) AS decisions",
    "related_decisions": f"{REL_SQL} SELECT relationship_id, classification FROM rel WHERE fact_a_id IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 100 = 7) OR fact_b_id IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 100 = 7)",
    "latest_doc_list": "SELECT document_id, status, version FROM (SELECT user_id AS document_id, event_type AS status, event_id AS version, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 ORDER BY ts DESC, version DESC LIMIT 50",
    "lifecycle": """SELECT status, count(*) AS documents, min(step)::INTEGER AS step FROM (SELECT ['queued','ingesting','extracting','verifying','normalizing','classifying','completed','failed'][event_id % 8 + 1] AS status, [-1,0,1,2,2,3,4,-1][event_id % 8 + 1] AS step,
        row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 GROUP BY 1""",
    "exists_pages": "SELECT doc_id AS document_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "export_json_eval": f"""{REL_SQL} SELECT 'fact' AS record, '{{"fact_id":' || fact_id || '}}' AS json FROM claims WHERE fact_id % 4 <> 0
        UNION ALL SELECT 'relationship', '{{"fact_a_id":' || fact_a_id || ',"fact_b_id":' || fact_b_id || ',"classification":"' || classification || '"}}' FROM rel WHERE fact_a_id % 4 <> 0 AND fact_b_id % 4 <> 0""",
    "incremental_pairs": f"{_OUTCOMES} SELECT a_id, b_id, classification FROM outcomes WHERE a_doc = 'restated' OR b_doc = 'restated'",
    "set_ops": "SELECT 'anti' AS op, c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL (SELECT 'intersect', c_nationkey::BIGINT FROM customer INTERSECT SELECT 'intersect', s_nationkey::BIGINT FROM supplier)",
}


# ---- evaluation ----

def _labelled(spark, sf):
    """Expected and predicted facts: an order's total, and a prediction of it that errs for some, in two documents."""
    o = table(spark, sf, "orders").where("o_orderkey IS NOT NULL")
    money = F.col("o_totalprice").cast("decimal(18,2)")
    common = [F.concat(F.lit("Doc "), F.substring("o_orderpriority", 1, 1)).alias("document_key"), (F.col("o_orderkey") % 7 + 1).cast("int").alias("page"), F.concat(F.lit("The Customer "), (F.col("o_custkey") % 40).cast("string"), F.lit(" Ltd")).alias("subject"), F.concat(F.lit("Status-"), F.col("o_orderstatus")).alias("predicate")]
    rest = [F.lit(None).cast("string").alias("unit"), F.lit("usd").alias("currency"), F.concat(F.lit("fiscal "), F.year("o_orderdate").cast("string")).alias("temporal_scope"), F.col("o_orderkey").alias("ordinal")]
    rounded = F.round(money / 5000, 0).cast("decimal(18,0)")
    expected = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").cast("string").alias("id"), *common, rounded.cast("string").alias("value"), *rest, F.col("o_orderstatus").alias("quote"))
    wrong = F.when(F.col("o_orderkey") % 5 == 0, rounded + 1).otherwise(rounded)
    predicted = o.where("o_orderkey % 3 != 0").select(F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("id"), *common, F.format_string("%s.0", wrong.cast("string")).alias("value"), *rest, F.when(F.col("o_orderkey") % 7 == 0, "other").otherwise(F.col("o_orderstatus")).alias("quote"))
    scope = spark.sql("SELECT * FROM VALUES (0, 'doc 1', CAST(NULL AS ARRAY<INT>)), (1, 'DOC 2', array(1, 2, 3)), (2, 'Doc-2', CAST(NULL AS ARRAY<INT>)), (3, 'doc 3', array(4)) AS s(ordinal, document_key, pages)")
    return expected, predicted, scope


EVAL_SQL = """WITH src AS (
    SELECT o_orderkey AS k, 'doc ' || left(o_orderpriority, 1) AS doc, o_orderkey % 7 + 1 AS page, 'customer ' || (o_custkey % 40) AS entity, 'status ' || lower(o_orderstatus) AS pred,
        CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * 0.0002, 0) AS BIGINT) AS v, year(o_orderdate) AS fy, o_orderstatus AS quote FROM orders
), expected AS (SELECT * FROM src WHERE k % 2 = 0),
predicted AS (SELECT k, doc, page, entity, pred, CASE WHEN k % 5 = 0 THEN v + 1 ELSE v END AS v, fy, CASE WHEN k % 7 = 0 THEN 'other' ELSE quote END AS quote FROM src WHERE k % 3 <> 0),
scoped AS (SELECT * FROM predicted WHERE doc = 'doc 1' OR (doc = 'doc 2' AND page IN (1, 2, 3)) OR (doc = 'doc 3' AND page = 4)),
e AS (SELECT *, row_number() OVER (PARTITION BY doc, page, entity, pred, v, fy ORDER BY k) AS n FROM expected),
p AS (SELECT *, row_number() OVER (PARTITION BY doc, page, entity, pred, v, fy ORDER BY k) AS n FROM scoped),
matches AS (SELECT e.k AS ek, p.k AS pk, e.quote = p.quote AS same FROM e JOIN p USING (doc, page, entity, pred, v, fy, n))
"""


def _matched(spark, sf):
    expected, predicted, scope = _labelled(spark, sf)
    scoped = evaluation.in_scope(predicted, scope)
    return expected, scoped, evaluation.bag_match(evaluation.signed(expected), evaluation.signed(scoped))


def signature(spark, sf):
    expected, _, _ = _labelled(spark, sf)
    return evaluation.signed(expected).select("id", *evaluation.SIGNATURE)


def scope_join(spark, sf):
    _, predicted, scope = _labelled(spark, sf)
    return evaluation.in_scope(predicted, scope).select("id")


def gt_pred_match(spark, sf):
    return _matched(spark, sf)[2].select("expected_id", "predicted_id", "same_quote")


def agg_precision_recall(spark, sf):
    expected, scoped, matches = _matched(spark, sf)
    r = evaluation.precision_recall(expected, scoped, matches)
    return r.select("true_positives", "false_positives", "false_negatives", *(F.col(c).cast("decimal(18,6)").alias(c) for c in ("precision", "recall", "exact_quote_rate")))


def _labels(spark, sf):
    """Quality labels as expected pairs, against a rule on length."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    name = lambda c: F.element_at(F.array(*map(F.lit, ("corroborates", "contradicts", "reconciled", "uncertain"))), c)
    keys = [F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("a"), F.concat(F.lit("b"), F.col("doc_id").cast("string")).alias("b")]
    expected = d.select(*keys, name((F.col("quality") * 2 + F.col("toxic") + 1).cast("int")).alias("classification"))
    found = d.where("n_chars % 5 != 0").select(F.col("doc_id").alias("ordinal"), F.concat(F.lit("pb"), F.col("doc_id").cast("string")).alias("a"), F.concat(F.lit("pa"), F.col("doc_id").cast("string")).alias("b"), name((F.when(F.col("n_chars") > 1500, 3).otherwise(2)).cast("int")).alias("classification"))
    ids = expected.select(F.explode(F.array("a", "b")).alias("expected_id")).where("substring(expected_id, -1, 1) != '9' OR substring(expected_id, 1, 1) = 'b'")
    mapping = ids.select("expected_id", F.concat(F.lit("p"), F.col("expected_id")).alias("predicted_id"))
    return evaluation.relationship_labels(expected, found, mapping)


_LABELS = """WITH l AS (SELECT doc_id, ['corroborates','contradicts','reconciled','uncertain'][quality * 2 + toxic + 1] AS expected,
    CASE WHEN n_chars % 5 = 0 OR doc_id % 10 = 9 THEN 'missing' WHEN n_chars > 1500 THEN 'reconciled' ELSE 'contradicts' END AS predicted FROM documents JOIN labels USING (doc_id))"""


def rel_lookup(spark, sf):
    return _labels(spark, sf)


def agg_confusion(spark, sf):
    return evaluation.confusion(_labels(spark, sf))


def agg_accuracy(spark, sf):
    r = evaluation.accuracy(_labels(spark, sf))
    return r.select("pairs", "missing", F.col("accuracy").cast("decimal(18,6)").alias("accuracy"))


def scan_eval_json(spark, sf):
    """Problems of label sets: repeated ids, unknown ends."""
    facts = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"))
    rel = table(spark, sf, "orders").select(F.col("o_orderkey").alias("a"), (F.col("o_orderkey") + 1).alias("b"))
    return evaluation.label_problems(facts, rel)


EVALUATION_SQL = {
    "signature": EVAL_SQL + "SELECT CAST(k AS VARCHAR) AS id, doc AS sig_document, CAST(page AS INTEGER) AS sig_page, entity AS sig_entity, pred AS sig_predicate, 'numeric|' || v || '|-|USD' AS sig_value, (fy - 1) || '-04-01..' || fy || '-03-31' AS sig_period FROM expected",
    "scope_join": EVAL_SQL + "SELECT 'p' || k AS id FROM scoped",
    "gt_pred_match": EVAL_SQL + "SELECT CAST(ek AS VARCHAR) AS expected_id, 'p' || pk AS predicted_id, same AS same_quote FROM matches",
    "agg_precision_recall": EVAL_SQL + """, c AS (SELECT (SELECT count(*) FROM matches) AS tp, (SELECT count(*) FROM scoped) AS p, (SELECT count(*) FROM expected) AS e, (SELECT count(*) FROM matches WHERE same) AS q)
        SELECT tp AS true_positives, p - tp AS false_positives, e - tp AS false_negatives, CAST(tp / p AS DECIMAL(18,6)) AS precision, CAST(tp / e AS DECIMAL(18,6)) AS recall, CAST(q / tp AS DECIMAL(18,6)) AS exact_quote_rate FROM c""",
    "rel_lookup": _LABELS + " SELECT 'a' || doc_id AS a, 'b' || doc_id AS b, expected, predicted FROM l",
    "agg_confusion": _LABELS + """ SELECT e.x AS expected, p.x AS predicted, (SELECT count(*) FROM l WHERE expected = e.x AND predicted = p.x) AS n
        FROM (SELECT unnest(['corroborates','contradicts','reconciled','uncertain']) AS x) e CROSS JOIN (SELECT unnest(['corroborates','contradicts','reconciled','uncertain','missing']) AS x) p""",
    "agg_accuracy": _LABELS + " SELECT count(*) AS pairs, count(*) FILTER (predicted = 'missing') AS missing, CAST(count(*) FILTER (expected = predicted) / count(*) AS DECIMAL(18,6)) AS accuracy FROM l",
    "scan_eval_json": "SELECT l_orderkey AS id, 'duplicate fact id' AS problem FROM lineitem GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT id, 'unknown fact id' FROM (SELECT o_orderkey AS id FROM orders UNION SELECT o_orderkey + 1 FROM orders) WHERE id NOT IN (SELECT l_orderkey FROM lineitem)",
}

QUERIES = {f.__name__: f for f in (
    block_pairs, delta_pairs, resolved_pairs, ambiguous_pairs, topk_ambiguous, trace_outcomes, decision_counts, trace_complete, conf_classification, display_value,
    sink_status, sink_checkpoint, sink_pages_once, upsert_relationship, retry_prepare, cascade_delete, process_run, rel_by_document, rel_with_facts, filter_rel_class, sort_rel_page, sort_facts,
    scan_facts_eligible, scan_store, ui_search, ui_counts, related_decisions, latest_doc_list, lifecycle, exists_pages, export_json_eval, export_json_sample, incremental_pairs, set_ops,
    signature, scope_join, gt_pred_match, agg_precision_recall, rel_lookup, agg_confusion, agg_accuracy, scan_eval_json,
)} | {k: check(c) for k, c in zip(CHECK_SQL, CHECKS)}

SQL = CHECK_SQL | LEDGER_SQL | EVALUATION_SQL | {
    "block_pairs": f"{_OUTCOMES} SELECT a_id, b_id, a_doc, b_doc FROM outcomes",
    "delta_pairs": f"{_OUTCOMES} SELECT a_id, b_id FROM outcomes WHERE a_doc IN ('1-URGENT', '5-LOW') OR b_doc IN ('1-URGENT', '5-LOW')",
    "resolved_pairs": """WITH asked AS (SELECT s_suppkey AS x, s_suppkey + 1 AS y, 0.9 AS similarity FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, s_suppkey + 25, 0.85 FROM supplier),
        named AS (SELECT DISTINCT CAST(least(CAST(x AS VARCHAR), CAST(y AS VARCHAR)) AS BIGINT) AS a_id, CAST(greatest(CAST(x AS VARCHAR), CAST(y AS VARCHAR)) AS BIGINT) AS b_id, similarity FROM asked)
        SELECT a_id, b_id, CAST(similarity AS DECIMAL(18,6)) AS similarity FROM named JOIN supplier a ON a.s_suppkey = a_id JOIN supplier b ON b.s_suppkey = b_id WHERE a.s_nationkey = b.s_nationkey AND a_id % 3 <> b_id % 3""",
    "trace_outcomes": f"{_OUTCOMES} SELECT a_id, b_id, classification, reason, {', '.join(OUT)} FROM outcomes",
    "decision_counts": f"{_OUTCOMES} SELECT classification, reason, count(*) AS n FROM outcomes GROUP BY 1, 2",
    "trace_complete": f"{_OUTCOMES} SELECT a_id, b_id, " + " || ';' || ".join(f"'{k} {c} ' || out_{c}" for k, c in enumerate(CHECKS, 1)) + " AS steps FROM outcomes",
    "conf_classification": f"{_OUTCOMES} SELECT a_id, b_id, CAST((" + " + ".join(f"CASE WHEN {o} IN ('passed', 'failed') THEN 1 ELSE 0 END" for o in OUT) + ") / (" + " + ".join(f"CASE WHEN {o} <> 'skipped' THEN 1 ELSE 0 END" for o in OUT) + ") AS DECIMAL(18,6)) AS confidence FROM outcomes",
    "display_value": f"{_OUTCOMES} SELECT fact_id, CAST(number AS DECIMAL(18,2)) AS shown FROM claims",
}
