"""Scoped bag matching of predicted against expected facts, ratios, and a confusion matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.functions.fixed_values import CLASSES
from claimweave.functions.keys import canonical_predicates, case_folded, clean, folded, normalize_entities
from claimweave.functions.numbers import exact_numbers, normalize_values
from claimweave.functions.periods import period_of
from claimweave.sources.scratch import spread, stored

from . import dictionary

SIGNATURE = ["sig_document", "sig_page", "sig_entity", "sig_predicate", "sig_value", "sig_period"]


def with_signature(facts: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Adds the six parts that two facts must share: document, page, entity, predicate, value and period. ``seen`` is a table
    that holds all texts of ``facts`` and is had more easily, if there is one."""
    said = lambda t: t.withColumns({"_value": folded(F.col("value")), "_scope": folded(F.col("temporal_scope"))})
    f = said(canonical_predicates(normalize_entities(facts, "subject"), "predicate")).withColumn("_document", case_folded(F.col("document_key")))
    texts = said(facts if seen is None else seen)
    f = dictionary.normalised(f, ["_value", "unit", "currency"], lambda t: exact_numbers(normalize_values(t, "_value"), "_value"), seen=texts)
    f = dictionary.normalised(f, ["_scope"], lambda t: t.withColumn("_period", period_of("_scope")), seen=texts)
    period = F.col("_period")
    value = F.when(F.col("kind") == "numeric", F.concat_ws("|", F.lit("numeric"), "number_text", F.coalesce("canonical_unit", F.lit("-")), F.coalesce("canonical_currency", F.lit("-")))).otherwise(F.concat(F.lit("text|"), F.col("text_value")))
    span = F.when(period["parsed"], F.concat_ws("..", period["start"].cast("string"), period["end"].cast("string"))).otherwise(clean(F.col("_scope")))
    return f.withColumns({"sig_document": clean(F.col("_document")), "sig_page": F.col("page"), "sig_entity": F.col("entity_key"), "sig_predicate": F.col("predicate_key"), "sig_value": value, "sig_period": span}).select(*facts.columns, *SIGNATURE)


def signed(facts: DataFrame) -> DataFrame:
    """``with_signature`` of facts with ids: a file of them is small, and their keys take long, so they are spread first."""
    return with_signature(spread(facts, "id"), seen=facts)


def in_scope(predictions: DataFrame, scope: DataFrame) -> DataFrame:
    """Predictions whose document's first scope row (by ordinal) lists their page, or lists none. Documents are told apart as by
    ``with_signature``."""
    by_key = lambda df: df.withColumn("_folded", case_folded(F.col("document_key"))).withColumn("_doc", clean(F.col("_folded"))).drop("_folded")
    first = by_key(scope).groupBy("_doc").agg(F.min_by(F.struct("pages"), "ordinal").alias("_s"))
    joined = by_key(predictions).join(first, "_doc")
    return joined.where(F.col("_s.pages").isNull() | F.array_contains("_s.pages", F.col("page"))).drop("_doc", "_s")


#: Rows of one key that a task numbers; a key with more is cut by ranges of the order.
NUMBERED_ROWS = 1_000_000


def numbered(rows: DataFrame, key: str, order: str, name: str, part_rows: int = NUMBERED_ROWS) -> DataFrame:
    """``rows`` with their number among those of their key, from 1, in the order of a number column.

    A frequent key is cut at quantiles of the order; a range's first number follows from the counts of those before it, so that no
    task gets a frequent key whole. Frequent keys are counted and stored first; where there are none, rows move once. Store rows first."""
    large = stored(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > part_rows).select(key), "frequent-keys")
    if large.isEmpty():
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("long"))
    bounds = rows.join(large, key, "left_semi").groupBy(key).agg(F.percentile_approx(order, [k / 64 for k in range(1, 64)], 1000).alias("_bounds"))
    cut = rows.join(bounds, key, "left")
    place = F.coalesce(F.size(F.filter("_bounds", lambda b: b < F.col(order))), F.lit(0))
    placed = cut.withColumn("_part", F.when(F.col("_bounds").isNull(), 0).otherwise(place)).drop("_bounds")
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = placed.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_m")).join(large, key, "left_semi").withColumn("_first", F.coalesce(F.sum("_m").over(before), F.lit(0))).drop("_m")
    within = F.row_number().over(Window.partitionBy(key, "_part").orderBy(order))
    return placed.withColumn("_k", within).join(firsts, [key, "_part"], "left").withColumn(name, F.col("_k") + F.coalesce("_first", F.lit(0))).drop("_k", "_part", "_first")


def bag_match(expected: DataFrame, predicted: DataFrame, keys: list[str] = SIGNATURE, part_rows: int = NUMBERED_ROWS) -> DataFrame:
    """(expected_id, predicted_id): the k-th expected of a signature takes the k-th predicted, by ordinal."""
    signed = F.sha2(F.to_json(F.struct(*keys)), 256)  # nulls are left out, so equal ones are one
    side = lambda df, x: numbered(stored(df.select(F.col("id").alias(f"{x}_id"), F.col("quote").alias(f"{x}_quote"), "ordinal", signed.alias("_signature")), f"{x}-signed"), "_signature", "ordinal", "_nth", part_rows).drop("ordinal")
    both = side(expected, "expected").join(side(predicted, "predicted"), ["_signature", "_nth"])
    return both.select("expected_id", "predicted_id", (F.col("expected_quote") == F.col("predicted_quote")).alias("same_quote"))


def ratio(n: Column, d: Column) -> Column:
    return F.when(d > 0, n / d).otherwise(0.0)


def precision_recall(expected: DataFrame, predicted: DataFrame, matches: DataFrame) -> DataFrame:
    """true_positives, false_positives, false_negatives, precision, recall and exact_quote_rate (null without a match)."""
    row = matches.agg(F.count(F.lit(1)).alias("tp"), F.coalesce(F.count_if("same_quote"), F.lit(0)).alias("quotes"))
    row = row.withColumn("e", expected.agg(F.count(F.lit(1))).scalar()).withColumn("p", predicted.agg(F.count(F.lit(1))).scalar())
    tp, fp, fn = F.col("tp"), F.col("p") - F.col("tp"), F.col("e") - F.col("tp")
    return row.select(tp.alias("true_positives"), fp.alias("false_positives"), fn.alias("false_negatives"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), F.when(tp > 0, F.col("quotes") / tp).alias("exact_quote_rate"))


def relationship_labels(expected: DataFrame, predicted: DataFrame, mapping: DataFrame) -> DataFrame:
    """Expected pairs (a, b, classification) with the predicted class of the mapped pair, in either order,
    the last by ordinal; "missing" if an end or the pair is."""
    both = predicted.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "classification", "ordinal")
    last = both.groupBy("x", "y").agg(F.max_by("classification", "ordinal").alias("found"))
    m = [mapping.select(F.col("expected_id").alias(s), F.col("predicted_id").alias(f"p{s}")) for s in "ab"]
    mapped = expected.join(m[0], "a", "left").join(m[1], "b", "left").withColumns({"x": F.least("pa", "pb"), "y": F.greatest("pa", "pb")})
    mapped = mapped.withColumn("x", F.when(F.col("pa").isNotNull() & F.col("pb").isNotNull(), F.col("x")))
    return mapped.join(last, ["x", "y"], "left").select("a", "b", F.col("classification").alias("expected"), F.coalesce("found", F.lit("missing")).alias("predicted"))


def confusion(labels: DataFrame) -> DataFrame:
    """(expected, predicted, n) for all 4 x 5 cells, zeros included."""
    pick = lambda names: F.explode(F.array(*map(F.lit, names)))
    cells = labels.sparkSession.range(1).select(pick(CLASSES).alias("expected")).select("expected", pick([*CLASSES, "missing"]).alias("predicted"))
    found = labels.groupBy("expected", "predicted").agg(F.count(F.lit(1)).alias("n"))
    return cells.join(found, ["expected", "predicted"], "left").select("expected", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def accuracy(labels: DataFrame) -> DataFrame:
    row = labels.agg(F.count(F.lit(1)).alias("pairs"), F.coalesce(F.count_if(F.col("expected") == F.col("predicted")), F.lit(0)).alias("correct"), F.coalesce(F.count_if(F.col("predicted") == "missing"), F.lit(0)).alias("missing"))
    return row.select("pairs", "missing", ratio(F.col("correct"), F.col("pairs")).alias("accuracy"))


def label_problems(facts: DataFrame, relationships: DataFrame) -> DataFrame:
    """(id, problem): repeated fact ids, and relationships that name unknown facts."""
    repeated = facts.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate fact id").alias("problem"))
    ends = relationships.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return repeated.union(ends.join(facts.select("id").distinct(), "id", "left_anti").select("id", F.lit("unknown fact id")))


def evaluate(scope: DataFrame, facts: DataFrame, relationships: DataFrame, predicted: DataFrame, predicted_relationships: DataFrame) -> dict[str, DataFrame]:
    """facts (counts and ratios), relationships (accuracy) and confusion of predictions against labels."""
    expected, scoped = facts, in_scope(predicted, scope)
    matches = bag_match(signed(expected), signed(scoped))
    labels = relationship_labels(relationships, predicted_relationships, matches.select("expected_id", "predicted_id"))
    return {"facts": precision_recall(expected, scoped, matches), "relationships": accuracy(labels), "confusion": confusion(labels)}


def results(found: dict[str, DataFrame]) -> DataFrame:
    """``evaluate``'s measures in one row."""
    as_one = lambda df: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias("x"))  # noqa: E731  a few rows each
    return found["facts"].withColumns({name: as_one(found[name]).scalar() for name in ("relationships", "confusion")})


def write_results(found: dict[str, DataFrame], path: str) -> None:
    results(found).coalesce(1).write.mode("overwrite").json(path)
