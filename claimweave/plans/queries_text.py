"""Queries of segmentation, evidence, keys, numbers and periods, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimweave.functions import keys, numbers, periods
from claimweave.functions.fixed_values import STATES
from claimweave.operators import classify, dictionary, evidence, pages, store
from claimweave.sources.scratch import new_path
from claimweave.sources.versioned import VersionedTables
from claimweave.streaming import incremental, lifecycle

from .claims import in_turn, table


def _docs(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "text")


def _pages(spark, sf):
    return pages.to_pages(_docs(spark, sf), "\n")


# ---- segmentation ----

def doc_sha256(spark, sf):
    return pages.hashed(_docs(spark, sf)).select("document_id", "sha256")


def dedup_by_hash(spark, sf):
    return pages.first_by_hash(_docs(spark, sf), "document_id").select("document_id", "first_id", "duplicate_reused")


def dedup_stream(spark, sf):
    """Contents as they arrive in several micro-batches, by ids; no state in the stream."""
    tables = VersionedTables(spark, new_path(spark, "seen"), incremental.SEEN)
    work, checkpoint = incremental.arrival_writer(tables), new_path(spark, "stream-checkpoint")
    in_turn(_docs(spark, sf), "document_id", lambda stream: incremental.start(stream, work, checkpoint, once=True).awaitTermination())
    return tables.read("arrivals").where("NOT duplicate_reused").select("sha256").distinct()


def _asked(spark, sf):
    """Events that ask for a state: the next one for most, by the event's number."""
    e = table(spark, sf, "events")
    named = F.element_at(F.array(*map(F.lit, STATES)), F.pmod(F.col("event_id"), F.lit(8)).cast("int") + 1)
    return e.where("user_id IS NOT NULL AND ts IS NOT NULL").select(F.col("user_id").alias("document_id"), named.alias("status"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("version"), (F.col("event_id") % 3).alias("pages"), F.lit(1).cast("long").alias("attempts"))


_WALKED = ("document_id", "status", "version", "accepted", "refused", "pages", "attempts")


def lifecycle_walk(spark, sf):
    return lifecycle.walked(_asked(spark, sf)).select(*_WALKED)


def lifecycle_stream(spark, sf):
    """The same from a stream in several micro-batches, states kept in the state store."""
    tables = VersionedTables(spark, new_path(spark, "states"), incremental.STATES)
    work, checkpoint = incremental.state_writer(tables), new_path(spark, "stream-checkpoint")
    in_turn(_asked(spark, sf), "ts", lambda stream: incremental.start(lifecycle.live_states(stream), work, checkpoint, once=True, mode="update").awaitTermination())
    return tables.read("states").select(*_WALKED)


_LIFECYCLE_SQL = """WITH e AS (SELECT user_id, ts, event_id, event_id % 8 AS s FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
    folded AS (SELECT user_id, list_reduce([{'s': -1, 'v': NULL::BIGINT, 'a': 0, 'r': 0, 'p': 0}] || list({'s': s, 'v': event_id, 'a': 0, 'r': 0, 'p': 0} ORDER BY ts, event_id),
        lambda x, y: CASE WHEN (x.s = -1 AND y.s = 0) OR (x.s BETWEEN 0 AND 5 AND y.s IN (x.s + 1, 7)) OR (x.s = 7 AND y.s = 0)
            THEN {'s': y.s, 'v': y.v, 'a': x.a + 1, 'r': x.r, 'p': x.p + y.v % 3} ELSE {'s': x.s, 'v': x.v, 'a': x.a, 'r': x.r + 1, 'p': x.p} END) AS f FROM e GROUP BY 1)
    SELECT user_id AS document_id, CASE WHEN f.s >= 0 THEN ['queued','ingesting','extracting','verifying','normalizing','classifying','completed','failed'][f.s + 1] END AS status,
        f.v AS version, f.a::BIGINT AS accepted, f.r::BIGINT AS refused, f.p::BIGINT AS pages, f.a::BIGINT AS attempts FROM folded"""


def pages_explode(spark, sf):
    return _pages(spark, sf).select("document_id", "page", "text")


def page_offsets(spark, sf):
    return pages.with_offsets(_pages(spark, sf).select("document_id", "page", "text")).select("document_id", "page", F.col("start_offset").cast("long"), F.col("end_offset").cast("long"))


def document_text(spark, sf):
    return pages.document_text(_pages(spark, sf)).select("document_id", F.sha2("text", 256).alias("sha256"))


def page_slice(spark, sf):
    p = _pages(spark, sf)
    return p.select("document_id", "page", pages.page_slice(F.col("text"), F.lit(3), F.lit(12)).alias("piece"))


def layout_audit(spark, sf):
    """Pages of which some are misnumbered, and some altered, by their document's id."""
    kind, text = F.col("document_id") % 5, F.col("text")
    page = F.when((kind == 0) & (F.col("page") > 1), F.col("page") + 1).otherwise(F.col("page"))
    altered = F.when((kind == 1) & (F.col("page") == 1) & (F.length(text) > 0), F.concat(F.lit("#"), F.substring(text, F.lit(2), F.length(text)))).otherwise(text)
    return pages.layout_violations(_pages(spark, sf).withColumns({"page": page, "text": altered}), _docs(spark, sf))


def _turns(spark, sf):
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("document_id"), (F.col("turn") + 1).alias("page"), "text")


def page_batches(spark, sf):
    return pages.page_batches(_turns(spark, sf), 1500, 3).select("document_id", F.col("batch").cast("long"), "page")


def batch_resume(spark, sf):
    return pages.page_batches(_turns(spark, sf), 1500, 3, resume_after=2).select("document_id", F.col("batch").cast("long"), "page")


def extract_run(spark, sf):
    turns = _turns(spark, sf)
    return pages.batch_counters(pages.page_batches(turns, 1500, 3), turns.where("page % 2 = 0")).select("document_id", F.col("batch").cast("long"), "completed_pages", "facts_seen")


_FOLD = """t AS (SELECT conv_id AS document_id, turn + 1 AS page, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations {where}),
    f AS (SELECT document_id, page, k, 1 AS batch, n AS chars, 1 AS pages FROM t WHERE k = 1
        UNION ALL SELECT t.document_id, t.page, t.k, CASE WHEN f.chars + t.n > 1500 OR f.pages >= 3 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.chars + t.n > 1500 OR f.pages >= 3 THEN t.n ELSE f.chars + t.n END,
            CASE WHEN f.chars + t.n > 1500 OR f.pages >= 3 THEN 1 ELSE f.pages + 1 END FROM f JOIN t ON t.document_id = f.document_id AND t.k = f.k + 1)"""


def _label_text():
    """Label-like texts made of order keys."""
    k = F.col("o_orderkey")
    forms = [F.concat(F.lit("Page "), k.cast("string"), F.lit(" of 900")), F.concat(F.lit("("), k.cast("string"), F.lit(")")), F.concat(F.lit("-"), (k % 4000).cast("string"), F.lit("-")), F.lit(" xiv "), F.concat(F.lit("- "), k.cast("string"), F.lit(" -")), F.concat((k % 300).cast("string"), F.lit(" / 300"))]
    return F.element_at(F.array(*forms), (k % 6 + 1).cast("int"))


_LABEL_SQL = "labelled AS (SELECT o_orderkey, ['Page ' || o_orderkey || ' of 900', '(' || o_orderkey || ')', '-' || (o_orderkey % 4000) || '-', ' xiv ', '- ' || o_orderkey || ' -', (o_orderkey % 300) || ' / 300'][o_orderkey % 6 + 1] AS s FROM orders), parsed AS (SELECT o_orderkey, CASE WHEN s[1] = '(' THEN NULL ELSE nullif(regexp_extract(trim(trim(s), '-'), '(?i)^(?:page\\s+)?([0-9]{1,4}|[ivxlcdm]{1,12})(?:\\s*(?:/|of)\\s*[0-9]{1,4})?$', 1), '') END AS label FROM labelled)"


def label_parse(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", pages.page_label(_label_text()).alias("label"))


def label_is_year(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", pages.label_is_year(pages.page_label(_label_text())).alias("is_year"))


def label_coalesce(spark, sf):
    label, source = pages.coalesce_labels(pages.page_label(_label_text()), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("A-"), F.col("o_orderkey").cast("string"))))
    return table(spark, sf, "orders").select("o_orderkey", label.alias("label"), source.alias("source"))


def label_detect(spark, sf):
    """Words of line items laid on pages."""
    li = table(spark, sf, "lineitem")
    x, y = (F.col("l_partkey") % 60) * 10.0, F.when(F.col("l_linenumber") % 2 == 0, 780.0).otherwise(F.col("l_suppkey") % 80 * 10.0)
    words = li.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page"), x.alias("x0"), y.alias("y0"), (x + 9).alias("x1"), (y + 8).alias("y1"), (F.col("l_suppkey") % 150).cast("string").alias("word"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))
    return pages.detect_labels(words)


# ---- evidence ----

def _quoted(spark, sf):
    """Each document against one quote, by its key: benchmark passages, its own words, short, blank and far ones."""
    docs = table(spark, sf, "documents")
    items = table(spark, sf, "benchmark")
    n = items.agg(F.max("item_id") + 1).scalar()
    both = docs.withColumn("item", F.col("doc_id") % n).join(items.select(F.col("item_id").alias("item"), F.col("text").alias("passage")), "item")
    kind = F.col("doc_id") % 6
    own = F.substring("text", 10, 40)
    quote = (
        F.when(kind == 0, F.col("passage")).when(kind == 1, own).when(kind == 2, F.regexp_replace(own, r"\s+", "  ")).when(kind == 3, "zq zq").when(kind == 4, "  ").otherwise(F.concat(F.lit("unseen "), F.substring("passage", 1, 30), F.lit(" qqq")))
    )
    return both.select(F.col("doc_id").alias("fact_id"), F.when(F.col("doc_id") % 11 != 0, F.col("text")).alias("text"), quote.alias("quote"))


def ev_exact(spark, sf):
    a = evidence.align(_quoted(spark, sf), exact_only=True)
    return a.select("fact_id", F.col("start_offset").cast("long"), F.col("end_offset").cast("long"), F.sha2("source_quote", 256).alias("quote_sha"))


def ev_status(spark, sf):
    """Outcome of every row. SQL can't tell those that need a fuzzy search: tests/test_evidence.py compares all by brute force."""
    return evidence.align(_quoted(spark, sf)).select("fact_id", "status", "method", "failure_reason")


def ev_fuzzy(spark, sf):
    docs = table(spark, sf, "documents")
    words = F.regexp_replace(F.substring("text", 20, 60), "e", "")
    rows = docs.select(F.col("doc_id").alias("fact_id"), "text", F.concat(F.substring("text", 20, 30), F.lit("x"), F.substring("text", 52, 40), F.when(F.col("doc_id") % 3 == 0, words).otherwise("")).alias("quote"))
    a = evidence.align(rows)
    return a.select("fact_id", "status", "method", F.col("similarity").cast("decimal(18,6)").alias("similarity"), "start_offset", "end_offset")


def ev_told(spark, sf):
    """Outcomes that SQL can tell as well: all but those that only a fuzzy search tells apart."""
    return evidence.align(_quoted(spark, sf).where("fact_id % 6 NOT IN (0, 5)")).select("fact_id", "status", "method", "failure_reason")


def ev_source_quote(spark, sf):
    """Exact rows whose quote isn't the slice that their offsets name: those whose start was moved, by their id."""
    a = evidence.align(_quoted(spark, sf), exact_only=True)
    moved = a.withColumn("start_offset", F.when(F.col("fact_id") % 5 == 0, F.col("start_offset") + 1).otherwise(F.col("start_offset")))
    return moved.where("source_quote != substring(text, start_offset + 1, end_offset - start_offset)").select("fact_id")


def ev_norm_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(evidence.normal_text(F.concat(F.lit("\n a "), F.col("text"), F.lit(" over-\n  lap "))), 256).alias("sha256"))


def ev_hyphen(spark, sf):
    made = F.concat(F.col("p_brand"), F.lit("inter-"), F.when(F.col("p_size") % 2 == 0, "\n  ").otherwise(" "), F.lit("national"))
    return table(spark, sf, "part").select("p_partkey", evidence.normal_text(made).alias("joined"))


def page_lookup(spark, sf):
    t = _turns(spark, sf)
    c = t.select("document_id", (F.col("page") + F.col("document_id") % 3).alias("page"), F.substring("text", 1, 30).alias("quote"))
    found = evidence.look_up_pages(c, t)
    return found.select("document_id", "page", F.col("text").isNull().alias("outside"))


def ev_support_guard(spark, sf):
    predicate = F.when(F.col("p_size") % 2 == 0, "Date  of incorporation").otherwise("revenue")
    quote = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("It was Founded by "), F.col("p_name"))).otherwise(F.col("p_name"))
    reason = evidence.exclusion_reason(predicate, quote)
    return table(spark, sf, "part").select("p_partkey", reason.isNotNull().alias("excluded"), evidence.eligible(F.when(F.col("p_partkey") % 4 != 0, "verified").otherwise("failed"), reason).alias("eligible"))


def conf_scores(spark, sf):
    d = table(spark, sf, "documents")
    ex = classify.extraction_confidence(F.when(F.col("doc_id") % 2 == 0, " ").otherwise("s"), F.lit("p"), F.when(F.col("doc_id") % 3 == 0, "").otherwise("1"), F.col("text"), F.when(F.col("doc_id") % 5 == 0, evidence.OUTSIDE))
    ev = classify.evidence_confidence(F.when(F.col("doc_id") % 2 == 0, "verified").otherwise("failed"), (F.col("n_chars") % 100).cast("double"), F.lit("exact"), F.lit(None).cast("string"))
    return d.select("doc_id", ex["value"].cast("decimal(18,6)").alias("extraction"), ev["value"].cast("decimal(18,6)").alias("evidence"), F.array_join(ex["reasons"], ";").alias("reasons"))


# ---- keys ----

def _names(spark, sf):
    forms = [F.concat(F.lit("The "), F.col("c_name"), F.lit(" & Sons Pvt. Ltd.")), F.concat(F.col("c_name"), F.lit(" Corp Limited")), F.lit("Limited"), F.concat(F.lit("the "), F.col("c_name")), F.concat(F.col("c_mktsegment"), F.lit(" Company"))]
    return table(spark, sf, "customer").select("c_custkey", F.element_at(F.array(*forms), (F.col("c_custkey") % 5 + 1).cast("int")).alias("name"))


_NAMES_SQL = r"""names AS (SELECT c_custkey, ['The ' || c_name || ' & Sons Pvt. Ltd.', c_name || ' Corp Limited', 'Limited', 'the ' || c_name, c_mktsegment || ' Company'][c_custkey % 5 + 1] AS name, c_custkey % 5 AS k, c_name, c_mktsegment FROM customer),
    keyed AS (SELECT *, array_to_string(regexp_extract_all(lower(replace(name, '&', ' and ')), '[\p{L}\p{N}]+'), ' ') AS key, array_to_string(regexp_extract_all(lower(c_name), '[\p{L}\p{N}]+'), ' ') AS ck FROM names)"""


def key_comparison(spark, sf):
    return _names(spark, sf).select("c_custkey", keys.comparison_key(F.col("name")).alias("key"))


def norm_entity(spark, sf):
    aliases = spark.sql("SELECT * FROM VALUES ('AUTOMOBILE Co', 'The Car Makers Ltd') AS a(alias, canonical)")
    return keys.normalize_entities(_names(spark, sf), "name", aliases).select("c_custkey", "entity_key", "alias_applied", F.array_join("removed_suffixes", ",").alias("removed"))


def norm_predicate(spark, sf):
    aliases = spark.sql("SELECT * FROM VALUES ('Promo--Plated', 'plating') AS a(alias, canonical)")
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.lit(" "), F.replace("p_type", F.lit(" "), F.lit("-"))).alias("predicate"))
    return keys.canonical_predicates(p, "predicate", aliases).select("p_partkey", "predicate_key")


def norm_scope(spark, sf):
    text = F.when(F.col("p_partkey") % 7 == 0, "  ").when(F.col("p_partkey") % 7 != 1, F.concat(F.col("p_type"), F.lit(" - "), F.col("p_brand")))
    return table(spark, sf, "part").select("p_partkey", keys.scope_key(text).alias("scope"), keys.clean(text).alias("cleaned"))


def ui_texts(spark, sf):
    e = table(spark, sf, "documents")
    return e.select("doc_id", store.sentence_case(F.concat(F.lit("judgment_"), F.col("lang"))).alias("sentence"), store.file_size(F.col("n_chars") * 700).alias("size"))


def scan_upload(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.concat("url", F.when(F.col("page_id") % 3 == 0, ".PDF").otherwise(".txt")).alias("file_name"), F.when(F.col("page_id") % 2 == 0, F.col("html")).otherwise("").cast("binary").alias("content"))
    return store.validate_uploads(p).select("page_id", "reject")


# ---- numbers ----

#: Values with unit and currency, one of which each line item takes.
CASES = [
    ("1.5", "kilometres", None), ("1,000", "grams", None), ("10", "%", None), ("2", "hours", None), ("INR 100 crore", "crore", "INR"), ("INR 1,000 million", "million", "INR"),
    ("CN¥ 100", None, None), ("June 22, 2011", None, None), ("22 June 2011", None, None), ("L63090DL2011PLC221234", None, None), ("100 crore", None, None), ("100", "crore", None),
    ("(8.29)", "%", None), ("₹5 m", None, None), ("₹(452) Cr / (6.3%)", None, None), ("Not disclosed", None, None), ("12345,678", None, "usd"), ("1 box", "box", None), ("3 lakh boxes", "boxes", None), ("US$ 7.25 bn", None, None),
    ("INR 100 trillion", None, None), ("0.12345678", None, "USD"), ("123456789012345678901234567890", None, "usd"), ("9" * 70, "kg", None), ("-2.5 trillion", None, "eur"),
]
_CASES_SQL = "cases(k, value, unit, currency) AS (VALUES " + ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "NULL" if x is None else f"'{x}'" for x in (k, *c)) + ")" for k, c in enumerate(CASES)) + ")"
#: What each case is, worked out by hand: kind, number, text, unit, dimension, currency, step.
EXPECTED = [
    ("numeric", "1500", None, "m", "length", None, "100"), ("numeric", "1", None, "kg", "mass", None, "0.001"), ("numeric", "0.1", None, "ratio", "ratio", None, "0.01"), ("numeric", "7200", None, "s", "duration", None, "3600"),
    ("numeric", "1000000000", None, None, None, "INR", "10000000"), ("numeric", "1000000000", None, None, None, "INR", "1000000"), ("numeric", "100", None, None, None, "CNY", "1"), ("text", None, "2011-06-22", None, None, None, None),
    ("text", None, "2011-06-22", None, None, None, None), ("text", None, "l63090dl2011plc221234", None, None, None, None), ("text", None, "100 crore", None, None, None, None), ("numeric", "1000000000", None, None, None, None, "10000000"),
    ("numeric", "-0.0829", None, "ratio", "ratio", None, "0.0001"), ("numeric", "5", None, "m", "length", "INR", "1"), ("numeric", "-45200000", None, "ratio", "ratio", "INR", "100000"), ("text", None, "not disclosed", None, None, None, None),
    ("numeric", "12345", None, None, None, "USD", "1"), ("numeric", "1", None, "box", "custom", None, "1"), ("numeric", "300000", None, "boxes", "custom", None, "100000"), ("numeric", "7250000000", None, None, None, "USD", "10000000"),
    ("numeric", "100000000000000", None, None, None, "INR", "1000000000000"), ("numeric", None, None, None, None, "USD", None), ("numeric", None, None, None, None, "USD", "1"), ("numeric", None, None, "kg", "mass", None, "1"), ("numeric", "-2500000000000", None, None, None, "EUR", "100000000000"),
]
#: Exact digits, where the native number has none.
DIGITS = [e[1] or (c[0] if e[0] == "numeric" else None) for c, e in zip(CASES, EXPECTED)]


def _cases(spark, sf):
    one = lambda i: F.element_at(F.array(*(F.lit(c[i]) for c in CASES)), (F.col("l_partkey") % len(CASES) + 1).cast("int"))
    return table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey"), one(0).alias("value"), one(1).alias("unit"), one(2).alias("currency"))


def norm_value(spark, sf):
    n = dictionary.normalised(_cases(spark, sf), ["value", "unit", "currency"], lambda t: numbers.exact_numbers(numbers.normalize_values(t)))
    short = lambda c: F.col(c).cast("decimal(30,6)").alias(c)
    return n.groupBy("value", "kind", "number", "number_text", "text_value", "canonical_unit", "dimension", "canonical_currency", "step").agg(F.count(F.lit(1)).alias("n")).select("value", "kind", short("number"), "number_text", "text_value", "canonical_unit", "dimension", "canonical_currency", short("step"), "n")


def num_parse(spark, sf):
    v = F.concat(F.when(F.col("l_linenumber") % 3 == 0, "(").when(F.col("l_linenumber") % 3 == 1, "about - ").otherwise("+"), F.format_number(F.col("l_extendedprice"), 2), F.lit(") approx"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", numbers.parsed_number(v).cast("decimal(18,2)").alias("number"), numbers.quantum(v).cast("decimal(18,6)").alias("quantum"))


def fx_convert(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 7, "100 trillion").when(F.col("o_orderkey") % 10 == 5, "123456789012.0625 million").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("value"), F.lit(None).cast("string").alias("unit"), F.element_at(F.array(*map(F.lit, ("INR", "usd", "eur", "XYZ"))), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("currency"))
    rates = spark.sql("SELECT * FROM VALUES (DATE '2026-09-08', 'USD', 1.0D), (DATE '2026-09-08', 'INR', 0.012D), (DATE '2026-09-08', 'EUR', 1.25D) AS r(as_of, currency, rate)").withColumn("rate", F.col("rate").cast("decimal(18,8)"))
    c = numbers.convert_currency(numbers.normalize_values(o), rates, "USD", "2026-09-08")
    return c.select("o_orderkey", F.round(F.col("number"), 4).cast("decimal(34,4)").alias("number"), "canonical_currency", F.col("conversion_error").isNotNull().alias("failed"))


# ---- periods ----

def _worded(spark, sf):
    d = F.to_date("o_orderdate")
    f = F.date_format
    forms = [
        f(d, "MMMM d, yyyy"), F.concat(F.lit("as of "), f(d, "MMMM d, yyyy")), F.concat(F.lit("three months ended "), f(d, "d MMM yyyy")), F.concat(F.lit("year ended "), f(d, "MMMM d, yyyy")),
        f(d, "MMMM yyyy"), f(d, "yyyy"), F.concat(F.lit("FY"), f(d, "yy")), F.concat(F.lit("Q2 fiscal year "), f(d, "yyyy")), F.concat(f(d, "yyyy-MM-dd"), F.lit(" to "), f(F.date_add(d, 40), "yyyy-MM-dd")),
        F.concat(F.lit("nine months ended "), f(F.last_day(d), "MMMM d, yyyy")), F.lit("the current period"), F.concat(F.lit("Financial year "), f(d, "yyyy"), F.lit("-"), f(F.add_months(d, 12), "yy")),
    ]
    return table(spark, sf, "orders").select("o_orderkey", d.alias("d"), F.element_at(F.array(*forms), (F.col("o_orderkey") % 12 + 1).cast("int")).alias("scope"))


def parse_period(spark, sf):
    p = F.col("period")
    parsed = dictionary.normalised(_worded(spark, sf), ["scope"], lambda t: t.withColumn("period", periods.period_of("scope")))
    return parsed.select("o_orderkey", p["start"].alias("start_date"), p["end"].alias("end_date"), p["granularity"].alias("granularity"), p["parsed"].alias("parsed"))


def full_date_value(spark, sf):
    d = F.to_date("o_orderdate")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(d, "MMM d, yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format(d, "yyyy-M-d")).otherwise(F.concat(F.date_format(d, "d MMMM yyyy"), F.lit(" x")))
    return table(spark, sf, "orders").select("o_orderkey", periods.full_date(text).alias("day"))


def dates_in_text(spark, sf):
    d = F.to_date("o_orderdate")
    text = F.concat(F.lit("from "), F.date_format(d, "d MMMM yyyy"), F.lit(" until "), F.date_format(F.date_add(d, 9), "yyyy-MM-dd"), F.lit(", not February 30, 2024"))
    days = periods.dates_in_text(text)
    return table(spark, sf, "orders").select("o_orderkey", F.size(days).cast("long").alias("n"), F.element_at(days, 1)["day"].alias("first_day"), F.element_at(days, 2)["day"].alias("second_day"))


def month_math(spark, sf):
    d = F.to_date("o_orderdate")
    k = (F.col("o_orderkey") % 14).cast("int")
    a, b = periods.fiscal_bounds(F.year(d), F.lit(None).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", F.last_day(d).alias("month_end"), periods.shift_months(d, k).alias("shifted"), periods.period_start(d, k + 1).alias("period_start"), a.alias("fiscal_start"), b.alias("fiscal_end"), periods.long_year((F.col("o_orderkey") % 100).cast("int")).cast("long").alias("long_year"))


def _start(end, n):
    return f"CASE WHEN {end} = last_day({end}) THEN (date_trunc('month', {end}) - ({n} - 1) * INTERVAL 1 MONTH)::DATE ELSE ({end} - {n} * INTERVAL 1 MONTH)::DATE + 1 END"


_QUOTED_SQL = """q AS (SELECT doc_id AS fact_id, d.text AS text, CASE doc_id % 6 WHEN 0 THEN b.text WHEN 1 THEN substr(d.text, 10, 40) WHEN 2 THEN regexp_replace(substr(d.text, 10, 40), '\\s+', '  ', 'g') WHEN 3 THEN 'zq zq' WHEN 4 THEN '  ' ELSE 'unseen ' || substr(b.text, 1, 30) || ' qqq' END AS quote
    FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT max(item_id) + 1 FROM benchmark) WHERE d.doc_id % 11 <> 0)"""
_TOLD_SQL = """WITH q AS (SELECT doc_id, doc_id % 6 AS k, CASE WHEN doc_id % 11 <> 0 THEN text END AS text, substr(text, 10, 40) AS own FROM documents),
    s AS (SELECT *, CASE k WHEN 1 THEN own WHEN 2 THEN regexp_replace(own, '\\s+', '  ', 'g') WHEN 3 THEN 'zq zq' ELSE '  ' END AS quote, trim(regexp_replace(own, '\\s+', ' ', 'g')) AS tidy FROM q WHERE k NOT IN (0, 5)),
    m AS (SELECT *, CASE WHEN text IS NULL THEN 'outside' WHEN contains(text, quote) THEN 'exact' WHEN k = 4 THEN 'blank' WHEN k = 2 AND tidy = '' THEN 'blank' WHEN k = 2 THEN 'normalized' ELSE 'short' END AS r FROM s)
    SELECT doc_id AS fact_id, CASE WHEN r IN ('exact', 'normalized') THEN 'verified' ELSE 'failed' END AS status, CASE WHEN r IN ('exact', 'normalized') THEN r ELSE 'none' END AS method,
        CASE r WHEN 'outside' THEN 'the cited page is outside its supplied page batch' WHEN 'blank' THEN 'the evidence quote contains no text' WHEN 'short' THEN 'the quote was not found and is too short for safe fuzzy matching' END AS failure_reason FROM m"""
_PAGES_SQL = "p AS (SELECT document_id, generate_subscripts(parts, 1) AS page, unnest(parts) AS text FROM (SELECT doc_id AS document_id, string_split(text, chr(10)) AS parts FROM documents))"

SQL = {
    "doc_sha256": "SELECT doc_id AS document_id, sha256(text) AS sha256 FROM documents",
    "dedup_by_hash": "SELECT doc_id AS document_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_id, doc_id <> min(doc_id) OVER (PARTITION BY sha256(text)) AS duplicate_reused FROM documents",
    "dedup_stream": "SELECT DISTINCT sha256(text) AS sha256 FROM documents",
    "lifecycle_walk": _LIFECYCLE_SQL,
    "lifecycle_stream": _LIFECYCLE_SQL,
    "pages_explode": f"WITH {_PAGES_SQL} SELECT document_id, page, text FROM p",
    "page_offsets": f"WITH {_PAGES_SQL}, o AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY document_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM p) SELECT document_id, page, s::BIGINT AS start_offset, (s + length(text))::BIGINT AS end_offset FROM o",
    "document_text": "SELECT doc_id AS document_id, sha256(replace(text, chr(10), chr(12))) AS sha256 FROM documents",
    "page_slice": f"WITH {_PAGES_SQL} SELECT document_id, page, CASE WHEN length(text) >= 12 THEN substr(text, 4, 9) END AS piece FROM p",
    "layout_audit": f"WITH {_PAGES_SQL} SELECT document_id, 3 AS page, 'page numbers are not consecutive' AS problem FROM p WHERE document_id % 5 = 0 AND page = 2 UNION ALL SELECT document_id, 1, 'the source differs' FROM p WHERE document_id % 5 = 1 AND page = 1 AND length(text) > 0 AND left(text, 1) <> '#'",
    "page_batches": f"WITH RECURSIVE {_FOLD.format(where='')} SELECT document_id, batch::BIGINT AS batch, page FROM f",
    "batch_resume": f"WITH RECURSIVE {_FOLD.format(where='WHERE turn + 1 > 2')} SELECT document_id, batch::BIGINT AS batch, page FROM f",
    "extract_run": f"WITH RECURSIVE {_FOLD.format(where='')}, b AS (SELECT document_id, batch, count(*) AS pages, count(*) FILTER (page % 2 = 0) AS facts FROM f GROUP BY 1, 2) SELECT document_id, batch::BIGINT AS batch, sum(pages) OVER w::BIGINT AS completed_pages, sum(facts) OVER w::BIGINT AS facts_seen FROM b WINDOW w AS (PARTITION BY document_id ORDER BY batch)".replace("sum(pages) OVER w::BIGINT", "CAST(sum(pages) OVER w AS BIGINT)").replace("sum(facts) OVER w::BIGINT", "CAST(sum(facts) OVER w AS BIGINT)"),
    "label_parse": f"WITH {_LABEL_SQL} SELECT o_orderkey, label FROM parsed",
    "label_is_year": f"WITH {_LABEL_SQL} SELECT o_orderkey, coalesce(TRY_CAST(label AS INTEGER) BETWEEN 1900 AND 2099, false) AS is_year FROM parsed",
    "label_coalesce": f"WITH {_LABEL_SQL} SELECT o_orderkey, coalesce(label, CASE WHEN o_orderkey % 2 = 0 THEN 'A-' || o_orderkey END) AS label, CASE WHEN label IS NOT NULL THEN 'visible_text' WHEN o_orderkey % 2 = 0 THEN 'pdf_metadata' END AS source FROM parsed",
    "ev_exact": f"WITH {_QUOTED_SQL} SELECT fact_id, (strpos(text, quote) - 1)::BIGINT AS start_offset, (strpos(text, quote) - 1 + length(quote))::BIGINT AS end_offset, sha256(quote) AS quote_sha FROM q WHERE contains(text, quote)",
    "ev_told": _TOLD_SQL,
    "ev_source_quote": f"WITH {_QUOTED_SQL} SELECT fact_id FROM q WHERE contains(text, quote) AND quote <> '' AND fact_id % 5 = 0",
    "ev_hyphen": "SELECT p_partkey, p_brand || CASE WHEN p_size % 2 = 0 THEN 'international' ELSE 'inter- national' END AS joined FROM part",
    "page_lookup": "SELECT c.conv_id AS document_id, c.turn + 1 + c.conv_id % 3 AS page, t.conv_id IS NULL AS outside FROM conversations c LEFT JOIN conversations t ON t.conv_id = c.conv_id AND t.turn = c.turn + c.conv_id % 3",
    "ev_support_guard": "SELECT p_partkey, p_size % 2 = 0 AND p_size % 3 <> 0 AS excluded, p_partkey % 4 <> 0 AND NOT (p_size % 2 = 0 AND p_size % 3 <> 0) AS eligible FROM part",
    "conf_scores": """WITH c AS (SELECT doc_id, n_chars, doc_id % 2 <> 0 AS a, doc_id % 3 <> 0 AS b, trim(text) <> '' AS q, doc_id % 5 <> 0 AS p FROM documents), n AS (SELECT *, 1 + a::INT + b::INT + q::INT + p::INT AS ok FROM c)
        SELECT doc_id, CAST(ok / 5 AS DECIMAL(18,6)) AS extraction, CAST(CASE WHEN doc_id % 2 = 0 THEN (n_chars % 100) / 100 ELSE 0 END AS DECIMAL(18,6)) AS evidence,
        ok || '/5 structured extraction checks passed' || CASE WHEN ok < 5 THEN ';failed checks: ' || concat_ws(', ', CASE WHEN NOT a THEN 'subject_present' END, CASE WHEN NOT b THEN 'value_present' END, CASE WHEN NOT q THEN 'evidence_quote_present' END, CASE WHEN NOT p THEN 'cited_page_was_supplied' END) ELSE '' END || ';this measures schema adherence, not whether the claim is true' AS reasons FROM n""",
    "key_comparison": f"WITH {_NAMES_SQL} SELECT c_custkey, key FROM keyed",
    "norm_entity": f"""WITH {_NAMES_SQL} SELECT c_custkey, CASE k WHEN 0 THEN ck || ' and sons' WHEN 1 THEN ck || ' corp' WHEN 2 THEN 'limited' WHEN 3 THEN ck ELSE CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'automobile' ELSE lower(c_mktsegment) END END AS entity_key,
        false AS alias_applied, CASE k WHEN 0 THEN 'pvt,ltd' WHEN 1 THEN 'limited' WHEN 2 THEN 'limited' WHEN 3 THEN '' ELSE 'company' END AS removed FROM keyed""",
    "norm_predicate": r"SELECT p_partkey, CASE WHEN key = 'promo plated' THEN 'plating' ELSE key END AS predicate_key FROM (SELECT p_partkey, array_to_string(regexp_extract_all(lower(p_type), '[\p{L}\p{N}]+'), ' ') AS key FROM part)",
    "norm_scope": r"SELECT p_partkey, CASE WHEN p_partkey % 7 > 1 THEN c END AS scope, CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 7 > 1 THEN c END AS cleaned FROM (SELECT p_partkey, array_to_string(regexp_extract_all(lower(p_type || ' ' || p_brand), '[\p{L}\p{N}]+'), ' ') AS c FROM part)",
    "ui_texts": "SELECT doc_id, 'Judgment ' || lang AS sentence, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f', round(b / 1024, 1)) || ' KB' ELSE printf('%.1f', round(b / 1048576, 1)) || ' MB' END AS size FROM (SELECT doc_id, lang, n_chars * 700 AS b FROM documents)",
    "scan_upload": "SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN 415 WHEN page_id % 2 <> 0 OR html = '' THEN 400 END AS reject FROM pages",
    "norm_value": "WITH e(k, value, number_text, kind, number, text_value, canonical_unit, dimension, canonical_currency, step) AS (VALUES " + ", ".join("(" + ", ".join([str(k), f"'{c[0]}'", *("NULL" if x is None else f"'{x}'" for x in (d, *e))]) + ")" for k, (c, d, e) in enumerate(zip(CASES, DIGITS, EXPECTED))) + f") SELECT value, kind, CAST(number AS DECIMAL(30,6)) AS number, number_text, text_value, canonical_unit, dimension, canonical_currency, CAST(step AS DECIMAL(30,6)) AS step, count(*) AS n FROM lineitem JOIN e ON k = l_partkey % {len(CASES)} GROUP BY ALL",
    "num_parse": "SELECT l_orderkey, l_partkey, l_linenumber, CAST(CASE WHEN l_linenumber % 3 = 2 THEN 1 ELSE -1 END * CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS number, CAST(0.01 AS DECIMAL(18,6)) AS quantum FROM lineitem",
    "fx_convert": """SELECT o_orderkey, CAST(round(CASE o_orderkey % 10 WHEN 7 THEN CAST(100000000000000 AS DECIMAL(22,2)) WHEN 5 THEN CAST(123456789012062500 AS DECIMAL(22,2)) ELSE CAST(o_totalprice AS DECIMAL(22,2)) END * CASE o_orderkey % 4 WHEN 0 THEN 0.0120 WHEN 2 THEN 1.2500 ELSE 1.0000 END, 4) AS DECIMAL(34,4)) AS number, CASE WHEN o_orderkey % 4 = 3 THEN 'XYZ' ELSE 'USD' END AS canonical_currency, o_orderkey % 4 = 3 AS failed FROM orders""",
    "parse_period": f"""WITH w AS (SELECT o_orderkey, o_orderkey % 12 AS k, o_orderdate::DATE AS d, last_day(o_orderdate::DATE) AS l, year(o_orderdate) AS y FROM orders)
        SELECT o_orderkey, CASE k WHEN 1 THEN d WHEN 2 THEN {_start('d', 3)} WHEN 3 THEN {_start('d', 12)} WHEN 4 THEN date_trunc('month', d)::DATE WHEN 5 THEN make_date(y, 1, 1) WHEN 6 THEN make_date(y - 1, 4, 1) WHEN 7 THEN make_date(y - 1, 7, 1) WHEN 8 THEN d WHEN 9 THEN {_start('l', 9)} WHEN 11 THEN make_date(y, 4, 1) END AS start_date,
        CASE k WHEN 1 THEN d WHEN 2 THEN d WHEN 3 THEN d WHEN 4 THEN l WHEN 5 THEN make_date(y, 12, 31) WHEN 6 THEN make_date(y, 3, 31) WHEN 7 THEN make_date(y - 1, 9, 30) WHEN 8 THEN d + 40 WHEN 9 THEN l WHEN 11 THEN make_date(y + 1, 3, 31) END AS end_date,
        ['unknown','point_in_time','quarter','year','month','year','fiscal_year','quarter','date_range','multi_month','unknown','fiscal_year'][k + 1] AS granularity, k NOT IN (0, 10) AS parsed FROM w""",
    "full_date_value": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 2 THEN o_orderdate::DATE END AS day FROM orders",
    "dates_in_text": "SELECT o_orderkey, 2::BIGINT AS n, o_orderdate::DATE AS first_day, o_orderdate::DATE + 9 AS second_day FROM orders",
    "month_math": f"""SELECT o_orderkey, last_day(d) AS month_end, (d + k * INTERVAL 1 MONTH)::DATE AS shifted, {_start('d', '(k + 1)')} AS period_start, make_date(y - 1, 4, 1) AS fiscal_start, make_date(y, 3, 31) AS fiscal_end,
        CASE WHEN o_orderkey % 100 < 70 THEN 2000 ELSE 1900 END + o_orderkey % 100 AS long_year FROM (SELECT o_orderkey, o_orderdate::DATE AS d, o_orderkey % 14 AS k, year(o_orderdate) AS y FROM orders)""",
}

QUERIES = {f.__name__: f for f in (
    doc_sha256, dedup_by_hash, dedup_stream, lifecycle_walk, lifecycle_stream, pages_explode, page_offsets, document_text, page_slice, layout_audit, page_batches, batch_resume, extract_run, label_parse, label_is_year, label_coalesce, label_detect,
    ev_exact, ev_status, ev_told, ev_fuzzy, ev_source_quote, ev_norm_text, ev_hyphen, page_lookup, ev_support_guard, conf_scores, key_comparison, norm_entity, norm_predicate, norm_scope, ui_texts, scan_upload,
    norm_value, num_parse, fx_convert, parse_period, full_date_value, dates_in_text, month_math,
)}
