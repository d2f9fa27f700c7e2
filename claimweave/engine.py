"""The ledger's write and read paths as one object over DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.keys import canonical_predicates, folded, normalize_entities
from .functions.numbers import exact_numbers, normalize_values
from .functions.periods import period_of
from .operators import classify as decide
from .operators import evidence, pages, pairs, store
from .sources.seams import Provider, split_candidates, tie_break
from .sources.versioned import Table, VersionedTables

TABLES = {
    "documents": Table(("document_id",), ("document_id",)),
    "pages": Table(("document_id", "page"), ("document_id",)),
    "facts": Table(("document_id", "fact_id"), ("document_id",)),
    "relationships": Table(("fact_a_id", "fact_b_id"), ("fact_a_id", "fact_b_id")),
    "quarantine": Table(("document_id", "candidate_id"), ("document_id",)),
}
COUNTERS = ("processed_page_count", "extraction_batch_count", "provider_attempt_count", "retry_count")


@dataclass(frozen=True)
class Settings:
    batch_chars: int = 50_000
    batch_pages: int = 8
    fuzzy_threshold: float = 92.0
    least_fuzzy_chars: int = 20
    fiscal_start_month: int = 4
    ambiguous_pairs: int = 20
    ambiguous_low: float = 0.82
    ambiguous_high: float = 0.97
    attempts: int = 4
    backoff: float = 2.0
    upload_bytes: int = 100 * 1024 * 1024


def normalize_facts(facts: DataFrame, settings: Settings = Settings(), entity_aliases: DataFrame | None = None, predicate_aliases: DataFrame | None = None) -> DataFrame:
    """Facts (subject, predicate, value, unit, currency, temporal_scope, scope, data_vintage) in normal form."""
    named = canonical_predicates(normalize_entities(facts, "subject", entity_aliases), "predicate", predicate_aliases)
    texts = {"_value": "value", "_unit": "unit", "_currency": "currency", "period_text": "temporal_scope", "vintage_text": "data_vintage", "scope_text": "scope"}
    out = exact_numbers(normalize_values(named.withColumns({k: folded(F.col(c)) for k, c in texts.items()}), "_value", "_unit", "_currency"), "_value")
    for name in ("period", "vintage"):
        out = out.withColumn(name, period_of(f"{name}_text", settings.fiscal_start_month))
    return out.drop("_value", "_unit", "_currency")


def queued(files: DataFrame) -> DataFrame:
    """Document rows of (document_id, sha256), with counters at 0."""
    return files.select("document_id", "sha256", F.lit("queued").alias("status"), *(F.lit(0).alias(c) for c in COUNTERS), *(F.lit(None).cast("string").alias(c) for c in ("failure_reason", "checkpoint_model", "checkpoint_prompt_version")))


def quarantined(bad: DataFrame) -> DataFrame:
    """Candidates that broke their contract, with an id of their content."""
    return bad.withColumn("candidate_id", F.sha2(F.to_json(F.struct(*bad.columns)), 256))


def ground(candidates: DataFrame, settings: Settings = Settings(), **aliases: DataFrame) -> DataFrame:
    """Facts from candidates with the ``text`` of the page they cite (null if it wasn't supplied): aligned, scored, in normal form.

    Where batch and ordinal are given, they tell equal candidates apart."""
    aligned = evidence.align(candidates, settings.fuzzy_threshold, settings.least_fuzzy_chars).drop("text")
    reason = evidence.exclusion_reason(F.col("predicate"), F.col("quote"))
    facts = aligned.withColumn("exclusion_reason", reason).withColumn("eligible", evidence.eligible(F.col("status"), F.col("exclusion_reason")))
    facts = facts.withColumn("extraction_confidence", decide.extraction_confidence(*map(F.col, ("subject", "predicate", "value", "quote", "failure_reason"))))
    facts = facts.withColumn("evidence_confidence", decide.evidence_confidence(*map(F.col, ("status", "similarity", "method", "failure_reason"))))
    place = [F.col(c).cast("string") for c in ("batch", "ordinal") if c in candidates.columns]
    facts = facts.withColumn("fact_id", F.sha2(F.concat_ws("\x01" if place else "", "document_id", F.col("page").cast("string"), "subject", "predicate", "value", "quote", *place), 256))
    return normalize_facts(facts, settings, **aliases)


def relate(found: DataFrame) -> DataFrame:
    """Relationships of pairs of facts: decided, scored, by ordered ids."""
    decided = decide.classify(found).withColumn("confidence", decide.classification_confidence(F.col("trace")))
    ids = {"fact_a_id": F.least("a_fact_id", "b_fact_id"), "fact_b_id": F.greatest("a_fact_id", "b_fact_id"), "trace_a_id": F.col("a_fact_id")}
    rel = decided.withColumns(ids).withColumn("relationship_id", F.sha2(F.concat_ws("::", "fact_a_id", "fact_b_id"), 256))
    return rel.select("relationship_id", *ids, "classification", "reasons", "explanation", "confidence", "trace")


@dataclass(frozen=True)
class Ledger:
    """Documents, pages, facts and relationships. Each step returns DataFrames; ``write`` stores and ``read`` opens them.

    ``quarantine`` holds the candidates that broke their contract, each with its ``problem``."""

    documents: DataFrame
    pages: DataFrame
    facts: DataFrame | None = None
    relationships: DataFrame | None = None
    settings: Settings = Settings()
    quarantine: DataFrame | None = None

    @staticmethod
    def ingest(files: DataFrame, separator: str = "\f", settings: Settings = Settings()) -> Ledger:
        """From (document_id, text): the first document of each content, queued with its counters at 0, and its pages."""
        first = pages.first_by_hash(files, "document_id").where("NOT duplicate_reused")
        return Ledger(queued(first), pages.to_pages(first, separator), settings=settings)

    @staticmethod
    def read(spark: SparkSession, folder: str, settings: Settings = Settings()) -> Ledger:
        """The folder's last snapshot, whatever is written to it later."""
        tables = VersionedTables(spark, folder, TABLES)
        snapshot = tables.snapshot()
        if not snapshot["version"]:
            raise FileNotFoundError(f"no ledger was written to {folder}")
        return Ledger(**{name: tables.read(name, snapshot) for name in TABLES}, settings=settings)

    def write(self, folder: str, mode: str = "append") -> int:
        """Stores the tables as one change and returns its number. ``append`` adds rows and replaces those with the same
        keys; ``overwrite`` leaves these rows and no others, also where they were read from this folder."""
        if mode not in ("append", "overwrite"):
            raise ValueError("the mode is append or overwrite")
        change = VersionedTables(self.documents.sparkSession, folder, TABLES).begin()
        for name in TABLES:
            if (rows := getattr(self, name)) is not None:
                (change.upsert if mode == "append" else change.replace)(name, rows)
            elif mode == "overwrite":
                change.state["tables"].pop(name, None)
        return change.commit()

    def batches(self) -> DataFrame:
        return pages.page_batches(self.pages, self.settings.batch_chars, self.settings.batch_pages)

    def extract(self, provider: Provider, **aliases: DataFrame) -> Ledger:
        """Candidates by the provider, aligned with their pages, scored and normalised."""
        found, bad = split_candidates(provider(self.batches()))
        return Ledger(self.documents, self.pages, ground(evidence.look_up_pages(found, self.pages), self.settings, **aliases), settings=self.settings, quarantine=quarantined(bad))

    def ambiguous(self) -> DataFrame:
        """The pairs whose names are alike but not the same, that a tie-break may be asked about."""
        s = self.settings
        return pairs.ambiguous_pairs(self.facts.where("eligible"), s.ambiguous_low, s.ambiguous_high, s.ambiguous_pairs)

    def compare(self, cross_document_only: bool = True, tie_breaks: DataFrame | None = None, resolver: Provider | None = None) -> Ledger:
        """Relationships of all pairs of a block, and of the ambiguous pairs that decisions, or a resolver asked here, call one entity."""
        known = self.facts.where("eligible")
        found = pairs.block_pairs(known, cross_document_only)
        if resolver is not None:
            tie_breaks = tie_break(self.ambiguous(), resolver)
        if tie_breaks is not None:
            found = found.unionByName(pairs.resolved_pairs(known, tie_breaks), allowMissingColumns=True)
        return Ledger(self.documents, self.pages, self.facts, relate(found), self.settings, self.quarantine)

    def facts_of(self, document_id) -> DataFrame:
        return store.facts_of(self.facts, document_id)

    def decisions(self, classification: str | None = None, document_id=None, offset: int = 0, limit: int = 100, after: str | None = None) -> DataFrame:
        mine = None if document_id is None else self.facts.where(F.col("document_id") == document_id)
        return store.with_facts(store.relationship_page(self.relationships, classification, mine, offset, limit, after), self.facts)

    def document_status(self, document_id) -> DataFrame:
        """State and counters of a document, with its number of pages and its step in the order of states."""
        mine = self.documents.where(F.col("document_id") == document_id)
        n_pages = self.pages.where(F.col("document_id") == document_id).agg(F.count(F.lit(1))).scalar()
        return mine.withColumns({"page_count": n_pages, "step": store.step_index(F.col("status"))})

    def export(self) -> tuple[DataFrame, DataFrame]:
        """Verified facts, and the relationships between them."""
        return store.export_evaluation(self.facts, self.relationships)

    def delete(self, gone: DataFrame) -> Ledger:
        """The ledger without some documents, their pages and facts, and the relationships these have."""
        ids = gone.select("document_id").distinct()
        kept = self.documents.join(ids, "document_id", "left_anti")
        rest = None if self.quarantine is None else self.quarantine.join(ids, "document_id", "left_anti")
        return Ledger(kept, *store.delete_documents(gone, self.pages, self.facts, self.relationships), self.settings, rest)

    def retry(self, model: str, prompt_version: str) -> Ledger:
        """Failed documents queued again. Relationships of their facts go; pages and facts go where no checkpoint fits."""
        again = store.prepare_retries(self.documents, self.pages, model, prompt_version)
        rest = self.documents.join(again.select("document_id"), "document_id", "left_anti")
        touched = self.facts.join(again.select("document_id"), "document_id", "left_semi")
        anew = again.where("NOT resumes").select("document_id")
        kept = [t.join(anew, "document_id", "left_anti") for t in (self.pages, self.facts)]
        return Ledger(rest.unionByName(again.drop("resumes")), *kept, store.without_facts(self.relationships, touched), self.settings, self.quarantine)
