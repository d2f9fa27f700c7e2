"""A small ledger over DataFrames: states, checkpoints, upserts, retries, deletions, and read queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.functions.fixed_values import STATES

MAX_BYTES = 100 * 1024 * 1024


def validate_uploads(files: DataFrame, name: str = "file_name", content: str = "content") -> DataFrame:
    """Adds ``reject``: 415 for another extension, 400 for nothing inside, 413 beyond 100 MiB, else null."""
    size = F.length(F.col(content))
    bad_name = ~F.coalesce(F.lower(F.col(name)).endswith(".pdf"), F.lit(False))
    return files.withColumn("reject", F.when(bad_name, 415).when(F.coalesce(size, F.lit(0)) == 0, 400).when(size > MAX_BYTES, 413))


def new_documents(files: DataFrame) -> DataFrame:
    """Queued document rows with counters at 0 and ids from their content."""
    return files.select(F.sha2(F.concat_ws("", "file_name", "sha256"), 256).alias("document_id"), "file_name", "sha256", F.lit("queued").alias("status"), *(F.lit(0).alias(c) for c in ("page_count", "processed_page_count", "extraction_batch_count", "provider_attempt_count", "retry_count")))


def latest(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; a partial aggregate, so a key with very many events is no task's burden."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")).select(*keys, "_last.*")


def checkpoints(events: DataFrame) -> DataFrame:
    """Latest counters with their model and prompt version by document."""
    return latest(events, ["document_id"], ["version"])


def pages_once(new: DataFrame, stored: DataFrame) -> DataFrame:
    """New pages of documents that have none stored."""
    return new.join(stored.select("document_id").distinct(), "document_id", "left_anti")


def upsert_relationships(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Relationships by unordered pair of facts, the highest version of each."""
    both = stored.unionByName(new, allowMissingColumns=True)
    low, high = F.least(F.col("fact_a_id").cast("string"), F.col("fact_b_id").cast("string")), F.greatest(F.col("fact_a_id").cast("string"), F.col("fact_b_id").cast("string"))
    return latest(both.withColumns({"fact_a_id": low, "fact_b_id": high}), ["fact_a_id", "fact_b_id"], ["version"])


def touching(relationships: DataFrame, facts: DataFrame) -> DataFrame:
    """Relationships either side of which is one of the facts, in one pass over them: a mark from each side."""
    ids = facts.select(F.col("fact_id").alias("_id"), F.lit(True).alias("_mark")).distinct()
    sides = [ids.toDF(f"fact_{x}_id", f"_in_{x}") for x in "ab"]
    marked = relationships.join(sides[0], "fact_a_id", "left").join(sides[1], "fact_b_id", "left")
    return marked.where("_in_a OR _in_b").select(relationships.columns)


def without_facts(relationships: DataFrame, facts: DataFrame) -> DataFrame:
    ids = facts.select("fact_id").distinct()
    out = relationships.join(ids.withColumnRenamed("fact_id", "fact_a_id"), "fact_a_id", "left_anti")
    return out.join(ids.withColumnRenamed("fact_id", "fact_b_id"), "fact_b_id", "left_anti")


def delete_documents(gone: DataFrame, pages: DataFrame, facts: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages, facts and relationships without what belongs to the deleted documents."""
    ids = gone.select("document_id").distinct()
    dropped = facts.join(ids, "document_id", "left_semi")
    return pages.join(ids, "document_id", "left_anti"), facts.join(ids, "document_id", "left_anti"), without_facts(relationships, dropped)


def prepare_retries(documents: DataFrame, pages: DataFrame, model: str, prompt_version: str) -> DataFrame:
    """Failed documents queued again: a checkpoint of the same model and prompt whose pages are stored is
    kept (``resumes``), any other is zeroed."""
    have = pages.select("document_id").distinct().withColumn("_stored", F.lit(True))
    failed = documents.where("status = 'failed'").join(have, "document_id", "left")
    keeps = (F.col("processed_page_count") > 0) & (F.col("checkpoint_model") == model) & (F.col("checkpoint_prompt_version") == prompt_version) & F.col("_stored")
    out = failed.withColumn("resumes", F.coalesce(keeps, F.lit(False)))
    zeroed = {c: F.when(F.col("resumes"), F.col(c)).otherwise(0) for c in ("processed_page_count", "extraction_batch_count", "provider_attempt_count")}
    return out.withColumns(zeroed).withColumns({"status": F.lit("queued"), "failure_reason": F.lit(None).cast("string"), "retry_count": F.col("retry_count") + 1}).drop("_stored")


def eligible_facts(facts: DataFrame) -> DataFrame:
    return facts.where("eligible AND normalized IS NOT NULL")


def facts_of(facts: DataFrame, document_id) -> DataFrame:
    return facts.where(F.col("document_id") == document_id).orderBy("page", "fact_id")


def relationship_page(relationships: DataFrame, classification: str | None = None, of_facts: DataFrame | None = None, offset: int = 0, limit: int = 100, after: str | None = None) -> DataFrame:
    """One page of relationships by id, filtered before it is cut. ``after``, the last id of the page before, finds the next without
    counting through all that come earlier: each task keeps its ``limit`` smallest beyond it."""
    if offset < 0 or not 1 <= limit <= 500:
        raise ValueError("offset is 0 or more, limit 1 to 500")
    out = relationships if classification is None else relationships.where(F.col("classification") == classification)
    if of_facts is not None:
        out = touching(out, of_facts)
    if after is not None:
        out = out.where(F.col("relationship_id") > after)
    page = out.orderBy("relationship_id")
    return (page.offset(offset) if offset else page).limit(limit)


def with_facts(relationships: DataFrame, facts: DataFrame) -> DataFrame:
    """Relationships with both facts as structs; cut to a page first."""
    sides = [facts.select(F.col("fact_id").alias(f"fact_{x}_id"), F.struct(*facts.columns).alias(f"fact_{x}")) for x in "ab"]
    return relationships.join(sides[0], "fact_a_id").join(sides[1], "fact_b_id")


def search(facts: DataFrame, text: str, columns: tuple[str, ...] = ("subject", "predicate", "value", "fact_id")) -> DataFrame:
    """Facts any of whose columns contains the trimmed text, whatever its case; blank finds all."""
    wanted = text.strip().lower()
    if not wanted:
        return facts
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).contains(wanted), F.lit(False))
    return facts.where(hit)


def counts(facts: DataFrame, relationships: DataFrame) -> DataFrame:
    """extracted, verified, rejected and decisions, in a row."""
    of_facts = facts.agg(F.count(F.lit(1)).alias("extracted"), F.count_if("eligible").alias("verified"), F.count_if(~F.col("eligible")).alias("rejected"))
    return of_facts.withColumn("decisions", relationships.agg(F.count(F.lit(1))).scalar())


def step_index(status: Column) -> Column:
    steps = dict(zip(STATES, (-1, 0, 1, 2, 2, 3, 4, -1)))
    out = F.lit(-1)
    for name, k in steps.items():
        out = F.when(status == name, k).otherwise(out)
    return out


def file_size(size: Column) -> Column:
    """B, KB or MB, the latter two with one decimal."""
    one = lambda x: F.format_string("%.1f", x)
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1024 * 1024, F.concat(one(size / 1024), F.lit(" KB"))).otherwise(F.concat(one(size / (1024 * 1024)), F.lit(" MB")))


def sentence_case(text: Column) -> Column:
    """Underscores as spaces, the first letter upper-cased."""
    spaced = F.replace(text, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, F.lit(2), F.length(spaced)))


def violations(facts: DataFrame, relationships: DataFrame) -> DataFrame:
    """(record_id, problem) of records that break a rule of the model; empty if all hold."""
    f = facts.select(F.col("fact_id").cast("string").alias("record_id"), F.explode(F.array_compact(F.array(
        F.when((F.col("status") == "verified") & (F.col("start_offset").isNull() | F.col("end_offset").isNull()), "verified evidence needs offsets"),
        F.when((F.col("status") == "failed") & F.col("failure_reason").isNull(), "failed evidence needs a reason"),
        F.when(F.col("end_offset") <= F.col("start_offset"), "offsets are not in order"),
        F.when(~F.col("confidence").between(0, 1), "confidence lies outside 0 to 1"),
        F.when(F.col("period_end") < F.col("period_start"), "the period ends before it starts"),
    ))).alias("problem"))
    r = relationships.where("fact_a_id = fact_b_id").select(F.col("relationship_id").cast("string"), F.lit("a relationship needs two facts"))
    return f.union(r)


def export_evaluation(facts: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verified facts, and the relationships both ends of which are among them."""
    kept = facts.where("status = 'verified'")
    ids = kept.select("fact_id")
    rel = relationships.join(ids.withColumnRenamed("fact_id", "fact_a_id"), "fact_a_id", "left_semi").join(ids.withColumnRenamed("fact_id", "fact_b_id"), "fact_b_id", "left_semi")
    return kept, rel


def export_sample(documents: DataFrame, facts: DataFrame) -> DataFrame:
    """Documents with their facts as JSON; the facts of one document form one value, as its export does."""
    by = facts.groupBy("document_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct(*[c for c in facts.columns if c != "document_id"])))).alias("facts"))
    return documents.join(by, "document_id", "left")
