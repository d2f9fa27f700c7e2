"""The ordered checks on a pair of facts, as one projection: class, reasons, outcomes and trace.

Columns by side (prefix a_ or b_): entity_key, predicate_key, kind, value, scale_by, unit_by (rate, if converted),
number, text_value, canonical_unit, dimension, canonical_currency, step, unit, currency, period and vintage (structs of start, end, parsed,
with their texts period_text and vintage_text), scope; number_text and step_text, if facts went through ``exact_numbers``; scope_key, if
facts carry it, so that it is made once a fact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions.binding import built_once
from claimweave.functions.fixed_values import CHECKS
from claimweave.functions.keys import scope_key
from claimweave.functions.numbers import compare_exactly, factors_text, intervals_meet


def _a(name: str) -> Column:
    return F.col(f"a_{name}")


def _b(name: str) -> Column:
    return F.col(f"b_{name}")


def _same(name: str) -> Column:
    return _a(name).eqNullSafe(_b(name))


def compare_periods(name: str) -> Column:
    """same, different or unknown. Two absent periods are the same."""
    a, b = _a(name), _b(name)
    text = lambda c: F.trim(F.lower(c))
    unparsed = ~F.coalesce(a["parsed"], F.lit(False)) | ~F.coalesce(b["parsed"], F.lit(False))
    return (
        F.when(_a(f"{name}_text").isNull() & _b(f"{name}_text").isNull(), "same")
        .when(_a(f"{name}_text").isNull() | _b(f"{name}_text").isNull(), "unknown")
        .when(unparsed, F.when(text(_a(f"{name}_text")) == text(_b(f"{name}_text")), "same").otherwise("unknown"))
        .when((a["start"] == b["start"]) & (a["end"] == b["end"]), "same")
        .otherwise("different")
    )


def classify(pairs: DataFrame) -> DataFrame:
    """Adds classification, reasons, out_<check> for the nine checks, trace and explanation. What isn't selected isn't computed:
    ``steps`` has the trace without its details, which take the longest."""
    texts = {f"{x}_{c}" for x in "ab" for c in ("number_text", "step_text")}
    rates = tuple(f"{x}_rate" in pairs.columns for x in "ab")
    if texts <= set(pairs.columns) and not any(rates):
        return _decided(pairs.withColumn("_exact", _exact_texts()))
    return _decided(pairs.withColumn("_exact", _exact_by_hand(*rates)))


def _hard() -> Column:
    """Pairs with a number that the native type can't hold, which are compared by exact digits."""
    return F.coalesce((_a("kind") == "numeric") & _a("number").isNull(), F.lit(False)) | F.coalesce((_b("kind") == "numeric") & _b("number").isNull(), F.lit(False))


@built_once
def _exact_texts() -> Column:
    """Natively, where facts carry their exact digits."""
    xa, sa, xb, sb = (F.when(_hard(), F.col(c)) for c in ("a_number_text", "a_step_text", "b_number_text", "b_step_text"))
    both = _hard() & (_a("kind") == "numeric") & (_b("kind") == "numeric")
    return F.struct(
        F.when(both, xa == xb).alias("equal"), F.when(both, (sa != sb) & intervals_meet(xa, sa, xb, sb)).alias("rounded"),
        xa.alias("number_a"), sa.alias("step_a"), xb.alias("number_b"), sb.alias("step_b"),
    )


@built_once
def _exact_by_hand(*rates: bool) -> Column:
    written = [F.when(_hard() & (x("kind") == "numeric"), factors_text(x("value"), *(x(f) for f in ("scale_by", "unit_by", *["rate"] * rate)))) for x, rate in zip((_a, _b), rates)]
    return compare_exactly(*written)


def _decided(pairs: DataFrame) -> DataFrame:
    scopes = (next(c for c in (f"{p}_scope_key", f"{p}_scope_text", f"{p}_scope") if c in (*pairs.columns, f"{p}_scope")) for p in "ab")
    for columns in _steps(*scopes):
        pairs = pairs.withColumns(columns)
    return pairs.drop("_exact", "_entity", "_predicate", "_equal", "_unit", "_currency", "_rounded", "_time", "_vintage", "_scopes", "_gap", "_stage")


@built_once
def _steps(scope_a: str, scope_b: str) -> list[dict[str, Column]]:
    """Columns in the order in which they build on each other."""
    comparable = _same("canonical_unit") & _same("dimension") & _same("canonical_currency")
    numeric = _a("kind") == "numeric"
    equal = (
        F.when(_a("kind") != _b("kind"), None)
        .when(~numeric, _a("text_value") == _b("text_value"))
        .when(comparable, F.coalesce("_exact.equal", _a("number") == _b("number")))
    )
    d = [{"_entity": (_a("entity_key") == _b("entity_key")) | F.col("resolved"), "_predicate": _a("predicate_key") == _b("predicate_key"), "_equal": equal}]
    spelled = (~_same("unit")) & (_a("dimension") == _b("dimension"))
    money = [F.upper(F.coalesce(F.nullif(c("currency"), F.lit("")), c("canonical_currency"), F.lit(""))) for c in (_a, _b)]
    minted = (money[0] != "") & (money[1] != "") & (money[0] != money[1]) & _same("canonical_currency")
    d.append({"_unit": F.coalesce(spelled, F.lit(False)), "_currency": F.coalesce(minted, F.lit(False))})
    rounded = numeric & (_b("kind") == "numeric") & comparable & F.coalesce("_exact.rounded", (_a("step") != _b("step")) & (2 * F.abs(_a("number") - _b("number")) < _a("step") + _b("step")))
    d.append({"_rounded": F.coalesce(rounded, F.lit(False)), "_time": compare_periods("period"), "_vintage": compare_periods("vintage")})
    sa, sb = (F.col(c) if c.endswith("_scope_key") else scope_key(F.col(c)) for c in (scope_a, scope_b))
    d.append({"_scopes": F.when(sa.isNull() & sb.isNull(), "same").when(sa.isNull() | sb.isNull(), "unknown").when(sa == sb, "same").otherwise("different")})
    gap = (
        F.when(_a("kind") != _b("kind"), "value kinds differ")
        .when(numeric & ~_same("canonical_unit"), "units are missing or cannot be converted to a common basis")
        .when(numeric & ~_same("dimension"), "unit dimensions are missing or incompatible")
        .when(numeric & ~_same("canonical_currency"), "currencies were not converted to a common dated basis")
    )
    d.append({"_gap": gap})

    # How far the tree is walked: the first of these that holds decides.
    stage = (
        F.when(~F.col("_entity"), "entity").when(~F.col("_predicate"), "predicate")
        .when(F.col("_equal") & (F.col("_unit") | F.col("_currency")), "representation").when(F.col("_equal"), "equal")
        .when(F.col("_rounded"), "rounding").when(F.col("_time") == "different", "time").when(F.col("_vintage") == "different", "vintage")
        .when(F.col("_scopes") == "different", "scope")
        .when((F.col("_time") == "unknown") | (F.col("_vintage") == "unknown") | (F.col("_scopes") == "unknown") | F.col("_gap").isNotNull(), "open")
        .otherwise("contradiction")
    )
    d.append({"_stage": stage})
    at = F.col("_stage")
    classification = F.when(at.isin("entity", "predicate", "open"), "uncertain").when(at == "equal", "corroborates").when(at == "contradiction", "contradicts").otherwise("reconciled")
    single = F.when(at == "rounding", "rounding").when(at == "time", "time_period").when(at == "vintage", "data_vintage").when(at == "scope", "scope")
    reasons = F.when(at == "representation", F.array_compact(F.array(F.when(F.col("_unit"), "unit"), F.when(F.col("_currency"), "currency")))).otherwise(F.array_compact(F.array(single)))
    explanation = (
        F.when(at == "entity", "entities do not share a deterministic canonical key")
        .when(at == "predicate", "predicates do not share a deterministic canonical key")
        .when(at == "representation", "equivalent values were reconciled by normalization")
        .when(at == "equal", "normalized values are equal")
        .when(at == "rounding", "the written precision intervals overlap deterministically")
        .when(at == "time", "different reporting periods explain the different values")
        .when(at == "vintage", "different source-data vintages explain the different values")
        .when(at == "scope", "different scopes explain the different values")
        .when(at == "open", F.coalesce("_gap", F.lit("context is incomplete or ambiguous")))
        .otherwise("same entity, predicate, time, unit, currency, and scope have unequal values")
    )
    order = {"entity": 1, "predicate": 2, "representation": 3, "equal": 3, "rounding": 4, "time": 5, "vintage": 6, "scope": 9, "open": 9, "contradiction": 9}
    reached = F.element_at(F.create_map(*[x for k, v in order.items() for x in (F.lit(k), F.lit(v))]), at)
    three = lambda c: F.when(c == "different", "passed").when(c == "unknown", "judgment_required").otherwise("failed")
    yes = lambda c: F.when(c, "passed").otherwise("failed")
    represented = lambda c: F.when((at == "representation") & F.col(c), "passed").when(reached >= 9, "failed")
    outcomes = [
        yes(F.col("_entity")), F.when(reached >= 2, yes(F.col("_predicate"))),
        F.when(reached >= 3, F.when(F.col("_equal").isNull(), "judgment_required").otherwise(yes(F.col("_equal")))),
        F.when(reached >= 4, yes(F.col("_rounded"))), F.when(reached >= 5, three(F.col("_time"))), F.when(reached >= 6, three(F.col("_vintage"))),
        represented("_unit"), represented("_currency"), F.when(reached >= 9, three(F.col("_scopes"))),
    ]
    display = lambda c, p: F.coalesce(c("number").cast("string"), f"_exact.number_{p}", c("text_value"))
    quantum = lambda c, p: F.coalesce(c("step").cast("string"), f"_exact.step_{p}")
    pair = lambda name, x=_a, y=_b: {f"{name}_a": x(name).cast("string"), f"{name}_b": y(name).cast("string")}
    details = [
        {"entity_a": _a("entity_key"), "entity_b": _b("entity_key"), "match_method": F.when(_a("entity_key") == _b("entity_key"), "canonical_key").otherwise("bounded_llm_tiebreak")},
        {"predicate_a": _a("predicate_key"), "predicate_b": _b("predicate_key")},
        {"value_a": display(_a, "a"), "value_b": display(_b, "b")},
        {"quantum_a": quantum(_a, "a"), "quantum_b": quantum(_b, "b")},
        {"comparison": F.col("_time")}, {"comparison": F.col("_vintage")},
        {"unit_a": _a("canonical_unit"), "unit_b": _b("canonical_unit"), "dimension_a": _a("dimension"), "dimension_b": _b("dimension")},
        {"currency_a": _a("canonical_currency"), "currency_b": _b("canonical_currency")},
        {"scope_a": sa, "scope_b": sb},
    ]
    as_map = lambda x: F.create_map(*[y for k, v in x.items() for y in (F.lit(k), v)])
    step = lambda k: F.struct(F.lit(k + 1).alias("ord"), F.lit(CHECKS[k]).alias("check"), F.coalesce(outcomes[k], F.lit("skipped")).alias("outcome"), F.when(outcomes[k].isNull(), as_map({"reason": F.col("explanation")})).otherwise(as_map(details[k])).alias("details"))
    d.append({"classification": classification, "reasons": reasons, "explanation": explanation})
    d.append({f"out_{c}": F.coalesce(o, F.lit("skipped")) for c, o in zip(CHECKS, outcomes)})
    d.append({"trace": F.array(*map(step, range(len(CHECKS))))})
    return d


def steps() -> Column:
    """The trace of a decided pair without details: order, check and outcome."""
    return F.array(*(F.struct(F.lit(k).alias("ord"), F.lit(c).alias("check"), F.col(f"out_{c}").alias("outcome")) for k, c in enumerate(CHECKS, 1)))


def classification_confidence(trace: Column) -> Column:
    """Share of the checks made that needed no judgment; 0 if none was made."""
    made = F.size(F.filter(trace, lambda s: s["outcome"] != "skipped"))
    settled = F.size(F.filter(trace, lambda s: s["outcome"].isin("passed", "failed")))
    return F.when(made > 0, settled / made).otherwise(0.0)


def extraction_confidence(subject: Column, predicate: Column, value: Column, quote: Column, failure: Column) -> Column:
    """Passed contract checks of five, with the names of those that failed."""
    inside = ~F.coalesce(failure.contains("outside its supplied page batch"), F.lit(False))
    checks = {"subject_present": F.trim(subject) != "", "predicate_present": F.trim(predicate) != "", "value_present": F.trim(value) != "", "evidence_quote_present": F.trim(quote) != "", "cited_page_was_supplied": inside}
    sure = {k: F.coalesce(v, F.lit(False)) for k, v in checks.items()}
    passed = sum((v.cast("int") for v in sure.values()), F.lit(0))
    failed = F.array_compact(F.array(*(F.when(~v, k) for k, v in sure.items())))
    reasons = F.array_compact(F.array(F.concat(passed.cast("string"), F.lit("/5 structured extraction checks passed")), F.when(F.size(failed) > 0, F.concat(F.lit("failed checks: "), F.array_join(failed, ", "))), F.lit("this measures schema adherence, not whether the claim is true")))
    return F.struct((passed / 5).alias("value"), F.lit("structured_contract_checks_v1").alias("method"), reasons.alias("reasons"))


def evidence_confidence(status: Column, similarity: Column, method: Column, failure: Column) -> Column:
    """The measured similarity of verified evidence, else 0."""
    fine = status == "verified"
    reasons = F.when(fine, F.array(F.concat(F.lit("verified by "), method, F.lit(" alignment")), F.concat(F.lit("source alignment similarity was "), F.format_string("%.2f", similarity), F.lit("/100")))).otherwise(F.array(F.coalesce(failure, F.lit("evidence did not verify"))))
    return F.struct(F.when(fine, similarity / 100).otherwise(0.0).alias("value"), F.lit("source_alignment_similarity_v1").alias("method"), reasons.alias("reasons"))
