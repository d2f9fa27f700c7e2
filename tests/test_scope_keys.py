"""Document keys of scopes and signatures beyond ASCII."""

from claimweave.operators import evaluation


def test_scopes_and_signatures_tell_documents_alike(spark):
    scope = spark.createDataFrame([(0, "Stra\u00dfe 2024", [1, 2]), (1, "\uff21nnual", None), (2, None, None)], "ordinal int, document_key string, pages array<int>")
    keys = ["STRASSE 2024", "Stra\u00dfe 2024", "Annual", "\uff41NNUAL", None]
    rows = [(k, key, 1, "Acme", "revenue", "10", None, None, "FY 2024") for k, key in enumerate(keys)]
    facts = spark.createDataFrame(rows, "id int, document_key string, page int, subject string, predicate string, value string, unit string, currency string, temporal_scope string")
    signed = evaluation.with_signature(facts)
    assert sorted(r.id for r in evaluation.in_scope(signed, scope).collect()) == [0, 1, 3]
    documents = {r.id: r.sig_document for r in signed.collect()}
    assert documents[0] == documents[1] and documents[2] != documents[3]
