"""Documents through extraction and comparison, in a folder that a run may leave at any point and another take up.

Progress is the ledger itself: the facts of a batch of pages and the counters of its document are one change of the
versioned tables, so a batch is either done, with its facts stored once, or not begun. A run asks the provider for the next
batches of all documents, inside tasks, and commits what came back; a new run goes on behind the last commit. A batch
whose provider fails ends its document's run as failed, with the reason, and keeps the batches before it; a retry resumes there
if model and prompt are the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import TABLES, Ledger, Settings, ground, quarantined, queued, relate
from .functions.fixed_values import STATES
from .operators import pages, pairs, store
from .sources.scratch import dropped, spread, stored
from .sources.seams import PASSING, Provider, retrying, split_candidates, tie_break
from .sources.versioned import Change, VersionedTables

#: (document id, [(page, text), ...]) of a batch to its candidates, as dictionaries.
BatchProvider = Callable[[str, list[tuple[int, str]]], Iterable[dict]]
CANDIDATE = "page int, subject string, predicate string, value string, unit string, currency string, temporal_scope string, scope string, data_vintage string, quote string"
_FIELDS = [c.split()[0] for c in CANDIDATE.split(", ")]
_ANSWER = {"batch": pa.int32(), "n_pages": pa.int32(), "calls": pa.int32(), "error": pa.string(), "candidates": pa.list_(pa.struct([(c, pa.int32() if c == "page" else pa.string()) for c in _FIELDS]))}
#: Answers that a task holds before it hands them on.
ANSWERS = 256
QUEUED, INGESTING, EXTRACTING, VERIFYING, NORMALIZING, CLASSIFYING, COMPLETED, FAILED = STATES
NO_PAGES = "the document has no pages"


@dataclass(frozen=True)
class Workspace:
    """A ledger in a folder, and the steps that change it; each step is one or more whole changes."""

    spark: SparkSession
    folder: str
    settings: Settings = Settings()
    tables: VersionedTables = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "tables", VersionedTables(self.spark, self.folder, TABLES))

    def ledger(self) -> Ledger:
        return Ledger.read(self.spark, self.folder, self.settings)

    def submit(self, files: DataFrame, separator: str = "\f", retry_failed: bool = False, model: str = "", prompt_version: str = "") -> DataFrame:
        """Takes (document_id, text) in: the first of each content that isn't stored is queued with its pages, all others reuse
        what there is; a failed one is queued again if asked. An id names one content: ids that are stored must be those of
        the same content. Returns a row for each file: document_id, the id in use, status, duplicate_reused and retry_started."""
        placed = stored(pages.first_by_hash(files, "document_id"), "submitted")
        change = self.tables.begin()
        known = change.read("documents")
        if known is None:
            known = queued(placed).limit(0)
        have = known.where("sha256 IS NOT NULL").select("sha256", F.col("document_id").alias("stored_id"), F.col("status").alias("stored_status"))
        met = stored(placed.drop("text").join(have, "sha256", "left"), "submitted-met")
        ids = met.where("stored_id IS NULL AND NOT duplicate_reused").groupBy("document_id").agg(F.count(F.lit(1)).alias("_n"))
        repeated = ids.join(known.select("document_id", F.lit(True).alias("_known")), "document_id", "left").where("_n > 1 OR _known")
        new = placed.join(ids, "document_id", "left_semi")
        # Pages are many and wide: they are only told apart by their keys where an id comes again.
        (change.append if repeated.isEmpty() else change.upsert)("pages", pages.to_pages(new, separator))
        change.upsert("documents", queued(new))
        again = met.where(F.lit(retry_failed) & (F.col("stored_status") == FAILED))
        started = again.select(F.col("stored_id").alias("document_id")).distinct()
        if retry_failed and not started.isEmpty():
            self._retry(change, started, model, prompt_version)
            texts = placed.join(again.select("document_id", "stored_id"), "document_id").select(F.col("stored_id").alias("document_id"), "text").dropDuplicates(["document_id"])
            change.upsert("pages", store.pages_once(pages.to_pages(texts, separator), change.read("pages")))
        change.commit()
        used = F.coalesce("stored_id", "first_id")
        asked = F.col("stored_status") == FAILED
        return met.select("document_id", used.alias("used_id"), F.when(asked & F.lit(retry_failed) | F.col("stored_status").isNull(), QUEUED).otherwise(F.col("stored_status")).alias("status"),
                          ((F.col("stored_id").isNotNull() & ~(asked & F.lit(retry_failed))) | F.col("duplicate_reused")).alias("duplicate_reused"), F.coalesce(asked & F.lit(retry_failed), F.lit(False)).alias("retry_started"))

    def delete(self, gone: DataFrame) -> int:
        """Documents go with their pages, facts and quarantine, and the relationships of these facts: marks, no table is rewritten."""
        ids = gone.select("document_id").distinct()
        change = self.tables.begin()
        self._unlink(change, ids)
        for name in ("documents", "pages", "facts", "quarantine"):
            change.delete(name, ids, ["document_id"])
        return change.commit()

    def retry(self, failed: DataFrame, model: str, prompt_version: str) -> int:
        """Failed documents are queued again; others among those named stay as they are. Relationships of their facts go. Where the
        checkpoint is of another model or prompt, or has no pages, facts go too and counters are 0; stored pages are kept."""
        change = self.tables.begin()
        self._retry(change, failed.select("document_id").distinct(), model, prompt_version)
        return change.commit()

    def save_relationships(self, relationships: DataFrame, order: list[str] | None = None) -> int:
        """Relationships by unordered pair of facts take the place of stored ones; by an order, if they come later in it."""
        low, high = (f(F.col("fact_a_id"), F.col("fact_b_id")) for f in (F.least, F.greatest))
        change = self.tables.begin()
        change.upsert("relationships", relationships.withColumns({"fact_a_id": low, "fact_b_id": high}), order)
        return change.commit()

    def process(self, provider: BatchProvider, model: str, prompt_version: str, resolver: Provider | None = None, per_round: int = 16, sleep: Callable[[float], None] | None = None, passing: tuple[type[Exception], ...] = PASSING, **aliases: DataFrame) -> None:
        """Extracts and compares all documents that are queued or were left under way. ``per_round`` batches of each document are
        asked for between commits: what a lost run repeats, at most."""
        self._begin()
        while self._extract(provider, model, prompt_version, per_round, sleep, passing, aliases):
            pass
        self._compare(resolver)

    def _retry(self, change: Change, ids: DataFrame, model: str, prompt_version: str) -> None:
        documents, all_pages = change.read("documents"), change.read("pages")
        mine = documents.join(ids, "document_id", "left_semi")
        again = stored(store.prepare_retries(mine, all_pages, model, prompt_version), "retried")
        self._unlink(change, again.select("document_id"))
        anew = again.where("NOT resumes")
        change.delete("facts", anew, ["document_id"])
        change.delete("quarantine", anew, ["document_id"])
        forgotten = {c: F.when(F.col("resumes"), F.col(c)) for c in ("checkpoint_model", "checkpoint_prompt_version")}
        change.upsert("documents", again.withColumns(forgotten).drop("resumes"))

    def _unlink(self, change: Change, ids: DataFrame) -> None:
        """Relationships either fact of which belongs to the documents."""
        facts, rel = change.read("facts"), change.read("relationships")
        if facts is not None and rel is not None:
            theirs = facts.join(ids, "document_id", "left_semi").select("fact_id")
            change.delete("relationships", store.touching(rel, theirs))

    def _begin(self) -> None:
        change = self.tables.begin()
        documents = change.read("documents")
        todo = documents.where(F.col("status").isin(QUEUED, INGESTING))
        with_pages = change.read("pages").select("document_id").distinct().withColumn("_has", F.lit(True))
        started = todo.join(with_pages, "document_id", "left")
        begun = started.withColumns({"status": F.when(F.col("_has"), EXTRACTING).otherwise(FAILED), "failure_reason": F.when(F.col("_has").isNull(), NO_PAGES)})
        begun = stored(begun.drop("_has"), "begun")
        if not begun.isEmpty():
            change.upsert("documents", begun)
            change.commit()

    def _extract(self, provider: BatchProvider, model: str, prompt_version: str, per_round: int, sleep: Callable[[float], None] | None, passing: tuple[type[Exception], ...], aliases: dict[str, DataFrame]) -> bool:
        """One round over all documents under way; false if there is none."""
        change = self.tables.begin()
        documents = change.read("documents").where(F.col("status") == EXTRACTING)
        if documents.isEmpty():
            return False
        done = documents.select("document_id", F.col("processed_page_count").alias("_done"), F.col("extraction_batch_count").alias("_batches"))
        todo = change.read("pages").join(done, "document_id").where("page > _done")
        s = self.settings
        packed = pages.page_batches(todo.drop("_done", "_batches"), s.batch_chars, s.batch_pages).where(F.col("batch") <= per_round)
        asked = stored(packed.join(todo.select("document_id", "page", "text", "_batches"), ["document_id", "page"]).withColumn("batch", F.col("batch") + F.col("_batches")).drop("_batches"), "asked")
        attempts, base = s.attempts, s.backoff

        def ask(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Documents one after the other, and a document's batches in order, until one fails; rows come in that order."""
            out, kind = [], None

            def rows() -> Iterator[tuple]:
                nonlocal kind
                for part in parts:
                    kind = part.schema.field("document_id").type
                    yield from zip(*(part.column(c).to_pylist() for c in ("document_id", "batch", "page", "text")))

            def told() -> pa.RecordBatch:
                columns = [pa.array(c, t) for c, t in zip(zip(*out), (kind, *_ANSWER.values()))]
                out.clear()
                return pa.RecordBatch.from_arrays(columns, ["document_id", *_ANSWER])

            for document, mine in groupby(rows(), itemgetter(0)):
                for number, batch in groupby(mine, itemgetter(1)):
                    given = [(page, text) for _, _, page, text in batch]
                    try:
                        extra = {} if sleep is None else {"sleep": sleep}
                        found, calls = retrying(lambda: [{c: x.get(c) for c in _FIELDS} for x in provider(document, given)], attempts, base, passing=passing, **extra)
                        out.append((document, number, len(given), calls, None, found))
                    except Exception as e:  # a provider's error is its document's, not the job's
                        out.append((document, number, 0, 0, f"{type(e).__name__}: {e}", []))
                        break
                    if len(out) >= ANSWERS:
                        yield told()
            if out:
                yield told()

        kind = asked.schema["document_id"].dataType.simpleString()
        ordered = spread(asked.select("document_id", "batch", "page", "text"), "document_id").sortWithinPartitions("document_id", "batch", "page")
        answers = stored(ordered.mapInArrow(ask, f"document_id {kind}, batch int, n_pages int, calls int, error string, candidates array<struct<{CANDIDATE.replace(' ', ':').replace(',:', ',')}>>"), "answers")
        found = answers.where("error IS NULL").select("document_id", "batch", F.posexplode("candidates").alias("ordinal", "c")).select("document_id", "batch", "ordinal", "c.*")
        good, bad = split_candidates(found)
        cited = good.join(asked.select("document_id", "batch", "page", "text"), ["document_id", "batch", "page"], "left")
        # Ids hold the batch and its ordinal, and batches that are asked for have nothing stored.
        change.append("facts", ground(cited, s, **aliases))
        change.append("quarantine", quarantined(bad))
        sums = answers.groupBy("document_id").agg(F.sum("n_pages").alias("_pages"), F.count_if(F.isnull("error")).alias("_n"), F.sum("calls").alias("_calls"), F.max("error").alias("_error"))
        last = change.read("pages").groupBy("document_id").agg(F.max("page").alias("_last"))
        counted = documents.join(last, "document_id").join(sums, "document_id", "left").fillna(0, ["_pages", "_n", "_calls"])
        more = lambda c, d: (F.col(c) + F.col(d)).cast("int")
        some, ended = F.col("_n") > 0, F.col("processed_page_count") + F.col("_pages") >= F.col("_last")
        change.upsert("documents", counted.withColumns({
            "processed_page_count": more("processed_page_count", "_pages"), "extraction_batch_count": more("extraction_batch_count", "_n"), "provider_attempt_count": more("provider_attempt_count", "_calls"),
            "checkpoint_model": F.when(some, F.lit(model)).otherwise(F.col("checkpoint_model")), "checkpoint_prompt_version": F.when(some, F.lit(prompt_version)).otherwise(F.col("checkpoint_prompt_version")),
            # Verifying and normalising are done with the facts that this change stores.
            "status": F.when(F.col("_error").isNotNull(), FAILED).when(ended, CLASSIFYING).otherwise(EXTRACTING), "failure_reason": F.col("_error"),
        }).drop("_pages", "_n", "_calls", "_error", "_last"))
        change.commit()
        dropped(asked, answers)
        return True

    def _compare(self, resolver: Provider | None) -> None:
        """Documents whose facts are stored meet all others; their relationships and their state are one change."""
        change = self.tables.begin()
        ready = stored(change.read("documents").where(F.col("status") == CLASSIFYING), "ready")
        if ready.isEmpty():
            return
        facts = change.read("facts")
        if facts is not None:
            known, new = facts.where("eligible"), ready.select("document_id")
            found = pairs.delta_pairs(pairs.in_shared_blocks(known), new)
            if resolver is not None:
                s = self.settings
                asked = tie_break(pairs.ambiguous_pairs(known, s.ambiguous_low, s.ambiguous_high, s.ambiguous_pairs), resolver)
                mine = new.select(F.col("document_id").alias("_id"), F.lit(True).alias("_mine")).distinct()
                sides = [mine.toDF(f"{x}_document_id", f"_mine_{x}") for x in "ab"]
                resolved = pairs.resolved_pairs(known, asked).join(sides[0], "a_document_id", "left").join(sides[1], "b_document_id", "left").where("_mine_a OR _mine_b").drop("_mine_a", "_mine_b")
                found = found.unionByName(resolved, allowMissingColumns=True)
            change.upsert("relationships", relate(found))
        change.upsert("documents", ready.withColumn("status", F.lit(COMPLETED)))
        change.commit()
        dropped(ready)
