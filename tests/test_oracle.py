"""Every query that SQL can express, against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from claimweave.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: The pair queries share one plan; these stand for all of them here.
LIGHT = set(catalogue.oracle_sql()) - {"delta_pairs", "trace_outcomes", "rel_by_document", "rel_with_facts", "filter_rel_class", "sort_rel_page", "related_decisions", "export_json_eval", "incremental_pairs", "cascade_delete", "ui_counts", "conf_classification", "agg_precision_recall", "signature"} - {k for k in catalogue.oracle_sql() if k.startswith("chk")}


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return ""
    if isinstance(value, bool) or not hasattr(value, "__float__"):
        return str(value)
    return repr(round(float(value), 6))


@pytest.mark.parametrize("name", sorted(LIGHT))
def test_query(spark, sf, sql, name):
    got = catalogue.queries()[name](spark, sf).toArrow()
    want = sql.execute(catalogue.oracle_sql()[name]).to_arrow_table()
    columns = sorted(want.column_names)
    assert sorted(got.column_names) == columns
    rows = [sorted(tuple(map(plain, r)) for r in zip(*(t.column(c).to_pylist() for c in columns))) for t in (got, want)]
    assert rows[0] == rows[1]


def test_export_json_sample(spark, sf):
    import json

    turns = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        turns.setdefault(r.conv_id, []).append({k: v for k, v in (("turn", r.turn), ("role", r.role)) if v is not None})
    got = {r.document_id: json.loads(r.facts) for r in catalogue.queries()["export_json_sample"](spark, sf).collect() if r.document_id is not None}
    assert got == {k: sorted(v, key=lambda x: (x["turn"], x.get("role", ""))) for k, v in turns.items() if k is not None}


def test_ev_norm_text(spark, sf):
    import hashlib
    import re

    got = {r.doc_id: r.sha256 for r in catalogue.queries()["ev_norm_text"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        if r.text is not None:
            out, text, k = "", f"\n a {r.text} over-\n  lap ", 0
            while k < len(text):
                ahead = re.compile(r"[-\xad][ \t]*[\r\n]\s*(?=[^\W_])|\xad(?=[^\W_])").match(text, k)
                if ahead and out[-1:].isalnum():
                    k = ahead.end()
                    continue
                out, k = out + text[k], k + 1
            assert got[r.doc_id] == hashlib.sha256(" ".join(out.split()).encode()).hexdigest()
