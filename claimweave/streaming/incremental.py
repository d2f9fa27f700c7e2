"""Incremental arrival: one unit of work per content, states by events, new facts against stored ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from claimweave.operators.classify import classify
from claimweave.operators.pages import first_by_hash
from claimweave.operators.pairs import delta_pairs
from claimweave.sources.scratch import dropped, stored
from claimweave.sources.versioned import Table, VersionedTables

SEEN = {"seen": Table(("sha256",), ("sha256",)), "arrivals": Table(("document_id",), ("document_id",))}
STATES = {"states": Table(("document_id",), ("document_id",))}


def start(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, mode: str = "append") -> StreamingQuery:
    """Runs ``work`` on each micro-batch; arrivals are exactly the source's new rows, after a restart too."""
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).outputMode(mode)
    return (writer.trigger(availableNow=True) if once else writer).start()


def arrival_writer(tables: VersionedTables, order: str = "document_id", content: str = "text") -> Callable[[DataFrame, int], None]:
    """Work that tells new contents from those seen before, over ``SEEN``: the stream itself keeps no state.

    Hashes seen lie in buckets, of which a batch reads those its own hashes fall in, and a join that may filter them by a Bloom
    filter of the batch first. ``arrivals`` gets (document_id, sha256, first_id, duplicate_reused), as ``first_by_hash`` gives them;
    documents without content are each their own first. A batch is one change, and known by its number if it comes again."""

    def work(batch: DataFrame, number: int) -> None:
        change = tables.begin()
        if change.state.get("batch", -1) >= number:
            return
        found = stored(first_by_hash(batch, order, content).select(F.col(order).alias("document_id"), "sha256", "first_id"), "arrived")
        hashes = found.where("sha256 IS NOT NULL").select("sha256", "first_id").distinct()
        known = change.matching("seen", hashes)
        arrived = found
        if known is not None:
            # As many as the batch has contents: they are merged, not sent to the driver and back.
            known = stored(known, "known")
            arrived = found.join(known.select("sha256", F.col("first_id").alias("_known")).hint("merge"), "sha256", "left").withColumn("first_id", F.coalesce("_known", "first_id"))
            hashes = hashes.join(known.select("sha256").hint("merge"), "sha256", "left_anti")
        change.upsert("arrivals", arrived.select("document_id", "sha256", "first_id", (F.col("document_id") != F.col("first_id")).alias("duplicate_reused")))
        change.append("seen", hashes)
        change.state["batch"] = number
        change.commit()
        dropped(found, *([] if known is None else [known]))

    return work


def state_writer(tables: VersionedTables) -> Callable[[DataFrame, int], None]:
    """Work that keeps each document's last state of a stream of ``live_states`` in ``STATES``."""

    def work(batch: DataFrame, number: int) -> None:
        change = tables.begin()
        if change.state.get("batch", -1) >= number:
            return
        change.upsert("states", batch, order=["accepted", "refused", "stalled"])  # each only grows, so a document's last row has the most
        change.state["batch"] = number
        change.commit()

    return work


def fact_writer(facts_path: str, relationships_path: str, shards: int = 64) -> Callable[[DataFrame, int], None]:
    """Work that appends a batch's facts and the relationships these make with all stored facts.

    Facts lie in folders by a hash of entity and predicate, of which a batch reads only those it has facts in. Each
    batch is a folder of its own within, written over if the batch is repeated, so a restart adds nothing twice."""

    def work(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        shard = F.pmod(F.xxhash64("entity_key", "predicate_key"), F.lit(shards)).cast("int")
        mine = batch.withColumns({"shard": shard, "batch": F.lit(number)})
        mine.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard", "batch").parquet(facts_path)
        touched = [r.shard for r in mine.select("shard").distinct().collect()]  # at most ``shards`` numbers
        if not touched:
            return
        stored = spark.read.parquet(facts_path).where(F.col("shard").isin(touched) & (F.col("batch") <= number)).drop("batch", "shard")
        pairs = delta_pairs(stored, batch.select("document_id"))
        decided = classify(pairs).select("a_fact_id", "b_fact_id", "classification", "reasons", "trace")
        decided.write.mode("overwrite").parquet(f"{relationships_path}/batch={number}")

    return work
