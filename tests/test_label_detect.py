"""Each order is a document of its own."""

from claimweave.plans import queries_text


def test_orders_are_not_folded_together(spark, tmp_path):
    rows = [(k, line, 7, 40 + k % 3) for k in (1, 501, 1001) for line in (1, 2)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r.document_id, r.page): r.label for r in queries_text.label_detect(spark, str(tmp_path)).collect()}
    assert sorted(got) == sorted((k, line) for k, line, _, _ in rows)
    assert {k: got[k, 2] for k in (1, 501, 1001)} == {1: "41", 501: "40", 1001: "42"}
