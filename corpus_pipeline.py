"""Documents through quality rules, toxicity, near-duplicate removal and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame: all but the last the columns of
``documents``, the last the pieces of packed sequences, each with its ids. Empty tables give empty results, and
columns besides doc_id and text pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm import jaccard_join, packing, quality, toxicity
from claimweave.llm.queries import TOKENIZER, table, tokenizer_path
from claimweave.llm.storage import dropped, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the trees keep. Null and short texts fail the rules; repeated rows are judged each."""
    return quality.kept_rows(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic. Null and empty texts score by the intercept; repeated rows are judged each."""
    return toxicity.clean_rows(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that near copies link: the one with the smallest id.

    Rows are documents of their own: of rows that repeat an id, or have none, each is kept unless it lies in
    a group with another that goes first (by id, those without one last). Null and empty texts link with nothing and stay.
    """
    if docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").isEmpty():
        return docs.join(jaccard_join.classes(docs).where("doc_id != component_id").select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    key = "_row_" + "_".join(docs.columns)
    keyed = stored(docs.withColumn(key, F.monotonically_increasing_id()), "pipeline-keyed")
    found = jaccard_join.classes(keyed.select(F.col(key).alias("k"), "text"), "k").select(F.col("doc_id").alias(key), "component_id")
    first = keyed.select(key, "doc_id").join(found, key).groupBy("component_id").agg(F.min_by(key, F.struct(F.isnull("doc_id"), "doc_id", key)).alias(key))
    return keyed.join(first, key, "left_semi").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, with ids (little-endian unsigned 32 bits) and their crc. A null text is its end id alone."""
    pieces = packing.pack(docs, tokenizer_path(TOKENIZER), end_id=1, window=2048)
    return pieces.select("doc_id", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality_rules", quality_rules), ("toxicity", toxicity_filter), ("near_duplicates", near_duplicates), ("packing", pack)]

#: Trained classifiers and the tokenizer can't be had in SQL: tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
