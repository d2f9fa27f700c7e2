"""What takes longest for each claim and pair: forms of plain numbers, columns that pairs don't need, keys of scopes."""

import itertools

from pyspark.sql import functions as F

from claimweave.functions import binding, numbers
from claimweave.operators import classify, pairs
from claimweave.plans import claims, queries_claims


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_plain_numbers_have_the_form_of_all_others(spark):
    values = ["0", "007", "12.50", "1234567890123", "12345678901234", "0.123456", "0.1234567", "1,234.5", "-3", "(4.5)", "5 kg", "3 million", "$7", "12 usd", ".5", "5.", "2024-01-02", "٣", "", None]
    units = [*(n for _, _, _, names in numbers.UNITS for n in names), "Kg", "", " ", "kg million", "USD m", "barrels", None]
    currencies = ["USD", " usd ", "rs.", "xyz", "dollars", "", None]
    rows = spark.createDataFrame(list(itertools.product(values, units, currencies)), "value string, unit string, currency string")
    general = binding.let({c: F.col(c) for c in rows.columns}, numbers._form)
    got = numbers.normalize_values(rows.withColumn("want", general))
    names = ["kind", "text_value", "canonical_unit", "dimension", "canonical_currency", "scale_by", "unit_by", "number", "step"]
    assert got.where(F.to_json(F.struct(*names)) != F.to_json("want")).isEmpty()
    plain = rows.where(F.col("value").rlike(numbers._PLAIN) & (F.col("unit").isNull() | F.col("unit").isin(list(numbers._SPELLED))))
    assert plain.count() > 500


def test_pairs_of_ids_need_keys_alone(spark, sf):
    keys = claims.settled_keys(spark, sf)
    assert keys.columns == ["fact_id", "document_id", "entity_key", "predicate_key"]
    whole = claims.settled_claims(spark, sf)
    assert keys.exceptAll(whole.select(keys.columns)).isEmpty() and keys.count() == whole.count()
    for query in (queries_claims.block_pairs, queries_claims.delta_pairs):
        read = [f for f in query(spark, sf).inputFiles() if "/facts-" in f]
        assert not read


def test_scopes_get_their_keys_once_a_fact(spark, sf):
    facts = claims.settled_claims(spark, sf)
    by_fact = classify.classify(pairs.block_pairs(facts))
    assert "regexp_extract_all" not in _plan(by_fact.select("out_scope"))
    by_pair = classify.classify(pairs.block_pairs(facts.drop("scope_key")))
    cut = lambda d: d.select("a_fact_id", "b_fact_id", "classification", "out_scope", F.to_json("trace"))
    assert cut(by_fact).exceptAll(cut(by_pair)).isEmpty() and cut(by_pair).exceptAll(cut(by_fact)).isEmpty()


def test_dictionary_reads_the_texts_where_they_are_had(spark):
    from claimweave.operators import dictionary

    rows = spark.range(20).select("id", F.concat(F.lit("t"), (F.col("id") % 3).cast("string")).alias("text"))
    form = lambda t: t.withColumn("long", F.upper("text"))
    late = rows.withColumn("slow", F.raise_error(F.lit("read")))
    out = dictionary.normalised(late, ["text"], form, seen=rows)
    assert {(r.text, r.long) for r in out.select("text", "long").distinct().collect()} == {(f"t{k}", f"T{k}") for k in range(3)}


def test_facts_move_once_where_no_block_is_frequent(spark, sf):
    facts = claims.settled_claims(spark, sf)
    pairs_of = lambda rows: pairs.block_pairs(facts, part_rows=rows).select("a_fact_id", "b_fact_id", "a_number", "b_number")
    found = pairs_of(4096)
    got = found.exceptAll(pairs_of(1)).union(pairs_of(1).exceptAll(found))
    assert got.isEmpty() and found.count() > 1000
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") == 1, plan
