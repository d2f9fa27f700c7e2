"""Claims made of the business tables, the way the queries use them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions.keys import comparison_key, scope_key
from claimweave.functions.numbers import exact_numbers, normalize_values
from claimweave.functions.periods import period_of
from claimweave.operators import dictionary
from claimweave.sources.scratch import new_path, spread, stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim for each order, and one that restates it in document "restated": its value is equal, rounded,
    in another unit's spelling, or one more, by the order's key; scope and vintage differ by the key too."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    day = F.to_date("o_orderdate")
    year = F.year(day) + F.when(F.month(day) >= 4, 1).otherwise(0)
    kind, other = F.col("o_orderkey") % 4, F.col("o_orderkey") % 5
    money = F.col("o_totalprice").cast("decimal(18,2)")
    base = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("fact_id"), F.col("o_orderpriority").alias("document_id"),
        F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"), F.lit(" Ltd.")).alias("subject"), F.concat(F.lit("Order-"), F.col("o_orderstatus")).alias("predicate"),
        money.alias("money"), F.when(kind == 2, "kg").alias("unit"), F.when(kind != 2, "USD").alias("currency"),
        F.concat(F.lit("FY"), year.cast("string")).alias("temporal_scope"), F.col("c_mktsegment").alias("scope"), F.when(other == 2, "April 2024").alias("data_vintage"),
        kind.alias("kind_key"), other.alias("other_key"),
    )
    again = base.select(
        (F.col("fact_id") + 1_000_000_000).alias("fact_id"), F.lit("restated").alias("document_id"), "subject", "predicate",
        F.when(F.col("kind_key") == 1, F.round("money", 0)).when(F.col("kind_key") == 3, F.col("money") + 1).otherwise(F.col("money")).cast("decimal(18,2)").alias("money"),
        F.when(F.col("unit").isNotNull(), "kilograms").alias("unit"), "currency", "temporal_scope",
        F.when(F.col("other_key") == 0, "Global").when(F.col("other_key") != 1, F.col("scope")).alias("scope"), F.when(F.col("other_key") == 2, "May 2024").alias("data_vintage"),
        "kind_key", "other_key",
    ).withColumn("whole", F.col("kind_key") == 1)
    both = base.withColumn("whole", F.lit(False)).unionByName(again)
    value = F.when(F.col("whole"), F.col("money").cast("decimal(18,0)").cast("string")).otherwise(F.col("money").cast("string"))
    return both.withColumn("value", value).drop("money", "whole", "kind_key", "other_key")


#: The same claims in normal form, written down directly.
CLAIMS_SQL = """
base AS (
    SELECT o_orderkey AS fact_id, o_orderpriority AS document_id, 'customer ' || o_custkey AS entity_key, 'order ' || lower(o_orderstatus) AS predicate_key,
        CAST(o_totalprice AS DECIMAL(18,2)) AS money, o_orderkey % 4 AS kk, o_orderkey % 5 AS ok,
        year(o_orderdate) + CASE WHEN month(o_orderdate) >= 4 THEN 1 ELSE 0 END AS fy, lower(c_mktsegment) AS scope
    FROM orders JOIN customer ON o_custkey = c_custkey
), claims AS (
    SELECT fact_id, document_id, entity_key, predicate_key, money AS number, CAST(0.01 AS DECIMAL(18,2)) AS step, CASE WHEN kk = 2 THEN 'kg' END AS unit,
        CASE WHEN kk = 2 THEN 'kg' END AS canonical_unit, CASE WHEN kk <> 2 THEN 'USD' END AS currency, fy, scope, CASE WHEN ok = 2 THEN DATE '2024-04-01' END AS vintage
    FROM base
    UNION ALL
    SELECT fact_id + 1000000000, 'restated', entity_key, predicate_key, CASE WHEN kk = 1 THEN round(money, 0) WHEN kk = 3 THEN money + 1 ELSE money END,
        CASE WHEN kk = 1 THEN 1 ELSE 0.01 END, CASE WHEN kk = 2 THEN 'kilograms' END, CASE WHEN kk = 2 THEN 'kg' END, CASE WHEN kk <> 2 THEN 'USD' END, fy,
        CASE WHEN ok = 0 THEN 'global' WHEN ok <> 1 THEN scope END, CASE WHEN ok = 2 THEN DATE '2024-05-01' END
    FROM base
), pairs AS (
    SELECT a.fact_id AS a_id, b.fact_id AS b_id, a.document_id AS a_doc, b.document_id AS b_doc, a.entity_key, a.predicate_key, a.number AS an, b.number AS bn, a.step AS asp, b.step AS bsp,
        a.unit AS au, b.unit AS bu, a.canonical_unit AS acu, b.canonical_unit AS bcu, a.currency AS ac, b.currency AS bc, a.fy AS afy, b.fy AS bfy, a.scope AS asc_, b.scope AS bsc, a.vintage AS av, b.vintage AS bv
    FROM claims a JOIN claims b ON a.entity_key = b.entity_key AND a.predicate_key = b.predicate_key AND a.document_id <> b.document_id
        AND (a.document_id < b.document_id OR (a.document_id = b.document_id AND a.fact_id < b.fact_id))
), judged AS (
    SELECT *,
        acu IS NOT DISTINCT FROM bcu AND ac IS NOT DISTINCT FROM bc AS comparable,
        CASE WHEN acu IS NOT DISTINCT FROM bcu AND ac IS NOT DISTINCT FROM bc THEN an = bn END AS equal,
        au IS DISTINCT FROM bu AND acu IS NOT NULL AND bcu IS NOT NULL AS respelled,
        acu IS NOT DISTINCT FROM bcu AND ac IS NOT DISTINCT FROM bc AND asp <> bsp AND 2 * abs(an - bn) < asp + bsp AS rounded,
        CASE WHEN av IS NULL AND bv IS NULL THEN 'same' WHEN av IS NULL OR bv IS NULL THEN 'unknown' WHEN av = bv THEN 'same' ELSE 'different' END AS vint,
        CASE WHEN asc_ IS NULL AND bsc IS NULL THEN 'same' WHEN asc_ IS NULL OR bsc IS NULL THEN 'unknown' WHEN asc_ = bsc THEN 'same' ELSE 'different' END AS scop
    FROM pairs
), staged AS (
    SELECT *, CASE WHEN equal AND respelled THEN 'unit' WHEN equal THEN 'equal' WHEN rounded THEN 'rounding' WHEN afy <> bfy THEN 'time_period' WHEN vint = 'different' THEN 'data_vintage'
        WHEN scop = 'different' THEN 'scope' WHEN vint = 'unknown' OR scop = 'unknown' OR NOT comparable THEN 'open' ELSE 'contradiction' END AS stage
    FROM judged
), decided AS (
    SELECT *, CASE stage WHEN 'equal' THEN 'corroborates' WHEN 'open' THEN 'uncertain' WHEN 'contradiction' THEN 'contradicts' ELSE 'reconciled' END AS classification,
        CASE WHEN stage IN ('equal', 'open', 'contradiction') THEN '' ELSE stage END AS reason,
        CASE stage WHEN 'unit' THEN 3 WHEN 'equal' THEN 3 WHEN 'rounding' THEN 4 WHEN 'time_period' THEN 5 WHEN 'data_vintage' THEN 6 ELSE 9 END AS reached
    FROM staged
), outcomes AS (
    SELECT a_id, b_id, a_doc, b_doc, entity_key, predicate_key, classification, reason,
        'passed' AS out_same_entity, 'passed' AS out_same_predicate,
        CASE WHEN equal IS NULL THEN 'judgment_required' WHEN equal THEN 'passed' ELSE 'failed' END AS out_normalized_value_equality,
        CASE WHEN reached < 4 THEN 'skipped' WHEN rounded THEN 'passed' ELSE 'failed' END AS out_rounding,
        CASE WHEN reached < 5 THEN 'skipped' WHEN afy <> bfy THEN 'passed' ELSE 'failed' END AS out_time_period,
        CASE WHEN reached < 6 THEN 'skipped' WHEN vint = 'different' THEN 'passed' WHEN vint = 'unknown' THEN 'judgment_required' ELSE 'failed' END AS out_data_vintage,
        CASE WHEN stage = 'unit' THEN 'passed' WHEN reached = 9 THEN 'failed' ELSE 'skipped' END AS out_unit,
        CASE WHEN reached = 9 THEN 'failed' ELSE 'skipped' END AS out_currency,
        CASE WHEN reached < 9 THEN 'skipped' WHEN scop = 'different' THEN 'passed' WHEN scop = 'unknown' THEN 'judgment_required' ELSE 'failed' END AS out_scope
    FROM decided
)
"""


def normal_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``order_claims`` with keys, numbers and periods. A file of orders is small, and its claims take long, so they are spread first."""
    claims = order_claims(spark, sf_dir)
    out = keyed(exact_numbers(normalize_values(spread(claims, "fact_id"))))
    for column, source in (("period", "temporal_scope"), ("vintage", "data_vintage")):
        out = dictionary.normalised(out, [source], lambda t: t.withColumn(column, period_of(source)), seen=claims).withColumn(f"{column}_text", F.col(source))
    return out.withColumn("scope_key", scope_key(F.col("scope")))


def keyed(claims: DataFrame) -> DataFrame:
    """Claims with the keys that pair them."""
    name = comparison_key(F.col("subject"))
    return claims.withColumn("entity_key", F.regexp_replace(name, " ltd$", "")).withColumn("predicate_key", comparison_key(F.col("predicate")))


def settled_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``normal_claims`` stored, as a ledger's facts are before they are paired: each is put in normal form once."""
    return stored(normal_claims(spark, sf_dir), "facts")


def settled_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pairs are made of, stored, where nothing else of the claims is asked for."""
    claims = spread(order_claims(spark, sf_dir).select("fact_id", "document_id", "subject", "predicate"), "fact_id")
    return stored(keyed(claims).select("fact_id", "document_id", "entity_key", "predicate_key"), "keys")


def in_turn(df: DataFrame, order: str, work: Callable[[DataFrame], None], parts: int = 3) -> None:
    """``work`` on a stream of a table's rows that come in ``parts``, in ascending order of a column from one to the next.

    It is called anew once a part has come, and takes up the stream where it stopped, by its checkpoint: what a micro-batch holds is
    then a whole part, however many files it is in. Files of one part have no order."""
    spark, path = df.sparkSession, new_path(df.sparkSession, "stream")
    bounds = df.select(F.percentile_approx(F.col(order).cast("double"), [k / parts for k in range(1, parts)]).alias("b")).first().b or []
    part = F.lit(0)
    for b in bounds:
        part = part + (F.coalesce(F.col(order).cast("double"), F.lit(float("-inf"))) > b).cast("int")
    cut = stored(df.withColumn("_part", part), "stream-cut")
    for k in range(parts):
        cut.where(F.col("_part") == k).drop("_part").write.parquet(f"{path}/{k}")
        work(spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(path))
