"""What grows with the larger tables: few tasks, files of a stream, documents with most of the facts."""

import difflib
import random

import pandas as pd
from pyspark.sql import functions as F

from claimweave.operators import classify, pairs
from claimweave.plans import claims
from claimweave.sources.scratch import new_path
from claimweave.streaming import incremental


def test_similarities_are_those_of_difflib():
    r = random.Random(5)
    word = lambda n, letters: "".join(r.choice(letters) for _ in range(n))
    left, right = [], []
    for _ in range(2000):
        letters = r.choice(["ab", "0123456789", "abcdefgh é漢😀"])
        left.append(word(r.randrange(1, 70), letters))
        right.append(word(r.randrange(0, 40), letters) if r.random() < 0.5 else left[-1][: r.randrange(0, 60)] + word(r.randrange(0, 9), letters))
    left.append(word(250, "abc"))
    right.append(left[-1][5:])
    got = pairs.similarities(pd.Series(left), pd.Series(right), 0.0)
    assert got.tolist() == [difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)]


def test_few_names_with_many_pairs_are_spread(spark):
    facts = spark.range(400).select(F.col("id").alias("fact_id"), (F.col("id") % 3).alias("document_id"), F.format_string("supplier#%09d", "id").alias("entity_key"), F.lit("p").alias("predicate_key"))
    found = pairs.ambiguous_pairs(facts, top=None)
    by_task = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(by_task) > 4 and max(by_task) < sum(by_task) / 3
    rows = facts.collect()
    want = set()
    for a in rows:
        for b in rows:
            if a.document_id < b.document_id and 0.82 <= difflib.SequenceMatcher(None, a.entity_key, b.entity_key).ratio() < 0.97:
                want.add((a.fact_id, b.fact_id))
    assert {(r.a_fact_id, r.b_fact_id) for r in found.collect()} == want


def test_parts_of_many_files_come_one_after_the_other(spark):
    seen = {}

    def batch(df, number):
        seen[number] = sorted(r.id for r in df.select("id").collect())

    checkpoint = new_path(spark, "checkpoint")
    rows = spark.range(300).withColumn("id", F.pmod(F.col("id") * 7, F.lit(300))).repartition(4)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 10)
    try:
        claims.in_turn(rows, "id", lambda stream: incremental.start(stream, batch, checkpoint, once=True).awaitTermination())
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    batches = [seen[k] for k in sorted(seen)]
    assert len(batches) == 3 and [i for b in batches for i in b] == list(range(300))


def test_delta_does_not_move_facts_by_document(spark):
    facts = spark.range(3000).select(F.col("id").alias("fact_id"), F.when(F.col("id") % 2 == 0, "big").otherwise(F.concat(F.lit("d"), (F.col("id") % 5).cast("string"))).alias("document_id"), F.floor(F.col("id") / 10).cast("string").alias("entity_key"), F.lit("p").alias("predicate_key"))
    new = facts.where("document_id IN ('big', 'd1')")
    found = pairs.delta_pairs(facts, new)
    assert "hashpartitioning(document_id" not in found._jdf.queryExecution().executedPlan().toString()
    want = {(r.a_fact_id, r.b_fact_id) for r in pairs.block_pairs(facts).where("a_document_id IN ('big', 'd1') OR b_document_id IN ('big', 'd1')").collect()}
    got = [(r.a_fact_id, r.b_fact_id) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)


def test_claims_of_a_small_file_are_normalised_in_many_tasks(spark, sf):
    assert claims.normal_claims(spark, sf).select("fact_id", "number").rdd.getNumPartitions() >= 16


def test_steps_are_the_trace_without_details(spark, sf):
    d = classify.classify(pairs.block_pairs(claims.settled_claims(spark, sf)))
    short = F.transform("trace", lambda s: F.struct(s["ord"].alias("ord"), s["check"].alias("check"), s["outcome"].alias("outcome")))
    assert d.where(F.to_json(short) != F.to_json(classify.steps())).isEmpty()
    assert "details" not in d.select(classify.steps())._jdf.queryExecution().optimizedPlan().toString()
