"""Values beyond the native number's digits or factors are compared by their exact digits."""

from claimweave import engine
from claimweave.functions import numbers
from claimweave.operators import classify, pairs

LONG = "1234567890123456789012345678901234567890"
VALUES = [
    (("US$ 1.2 trillion", None), ("US$ 1.2 trillion", None), "corroborates"),
    (("US$ 1.2 trillion", None), ("US$ 1,200 billion", None), "corroborates"),
    (("US$ 1.2 trillion", None), ("US$ 1.21 trillion", None), "reconciled"),
    (("US$ 1.2 trillion", None), ("US$ 1.4 trillion", None), "contradicts"),
    (("1.2 trillion", "km"), ("1200 billion", "km"), "corroborates"),
    (("1.2 trillion", "km"), ("1.4 trillion", "km"), "contradicts"),
    (("0.12345678", None), ("0.123456780", None), "corroborates"),
    (("0.12345678", None), ("0.1234568", None), "reconciled"),
    ((LONG, None), (LONG, None), "corroborates"),
    ((LONG, None), (LONG[:-1] + "1", None), "contradicts"),
    ((LONG, None), ("5", None), "contradicts"),
    ((LONG, None), ("Not disclosed", None), "uncertain"),
]


def test_values_beyond_the_native_number(spark):
    rows = []
    for k, (a, b, _) in enumerate(VALUES):
        rows += [(2 * k + i, d, "Acme", f"p{k}", *v, None, "FY2024", None, None) for i, (d, v) in enumerate((("a", a), ("b", b)))]
    names = "fact_id long, document_id string, subject string, predicate string, value string, unit string, currency string, temporal_scope string, scope string, data_vintage string"
    facts = engine.normalize_facts(spark.createDataFrame(rows, names))
    got = {r.a_fact_id // 2: r for r in classify.classify(pairs.block_pairs(facts)).collect()}
    assert [got[k].classification for k in range(len(VALUES))] == [v[2] for v in VALUES]
    assert got[9].trace[2].details == {"value_a": LONG, "value_b": LONG[:-1] + "1"}
    assert got[7].trace[3].details == {"quantum_a": "0.00000001", "quantum_b": "0.0000001"}


def test_trillions_are_native(spark):
    rows = spark.createDataFrame([("US$ 1.2 trillion", None, None)], "value string, unit string, currency string")
    got = numbers.normalize_values(rows).first()
    assert got.number == 1_200_000_000_000 and got.step == 100_000_000_000


def test_intervals_of_any_length(spark):
    import random
    from decimal import Decimal, getcontext

    from pyspark.sql import functions as F

    getcontext().prec = 300
    rng = random.Random(7)
    text = lambda x: format(x.normalize() + 0, "f")
    rows = []
    for k in range(300):
        step, other = Decimal(1).scaleb(rng.randint(-40, 40)), Decimal(rng.choice([1, 60, 3600])).scaleb(rng.randint(-40, 40))
        x = Decimal(rng.randint(-(10**60), 10**60)).scaleb(rng.randint(-30, 5))
        y = x + rng.choice([0, 1, -1, 2]) * (step + other) / 2 + rng.choice([0, 0, Decimal(1).scaleb(-45), Decimal(-1).scaleb(-45)])
        rows.append((*map(text, (x, step, y, other)), bool(2 * abs(x - y) < step + other)))
    rows.append(("0", "1", "-0.5", "0.5", True))
    df = spark.createDataFrame(rows, "x string, s string, y string, t string, want boolean")
    assert df.where(~numbers.intervals_meet(*map(F.col, "xsyt")).eqNullSafe(F.col("want"))).count() == 0
    assert 0 < sum(r[4] for r in rows) < len(rows)


def test_no_python_between_stored_facts_and_decisions(spark, sf):
    from claimweave.plans import catalogue

    plan = catalogue.queries()["decision_counts"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_conversion_of_large_amounts(spark):
    from decimal import Decimal

    values = [("INR 100 trillion", "1200000000000"), ("INR 5", "0.06"), ("INR 123456.123456", "1481.473481472"), ("USD 7", "7"), ("INR " + "9" * 70, None), ("INR 99,999,999,999 trillion", "1199999999988000000000")]
    rows = spark.createDataFrame([(v, None, None) for v, _ in values], "value string, unit string, currency string")
    rates = spark.sql("SELECT DATE '2026-01-01' AS as_of, * FROM VALUES ('USD', CAST(1 AS DECIMAL(18,8))), ('INR', CAST(0.012 AS DECIMAL(18,8))) AS r(currency, rate)")
    got = {r.value: r.number for r in numbers.convert_currency(numbers.normalize_values(rows), rates, "USD").collect()}
    assert got == {v: None if n is None else Decimal(n) for v, n in values}
    digits = {r.value: r.number_text for r in numbers.exact_numbers(numbers.normalize_values(rows)).collect()}
    assert digits["INR " + "9" * 70] == "9" * 70
