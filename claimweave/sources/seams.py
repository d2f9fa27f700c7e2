"""Seams to the outside: files, aliases, labels, and candidate or tie-break providers.

A provider is a callable from a DataFrame to a DataFrame; the default reads a table, as no network is
assumed. ``retrying`` wraps a call to one with a bounded exponential backoff.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Provider = Callable[[DataFrame], DataFrame]
PageParser = Callable[[bytes], list[str]]


def read_aliases(spark: SparkSession, path: str | None, kind: str) -> DataFrame:
    """(alias, canonical) of one kind ("entity_aliases" or "predicate_aliases") from a JSON file; no path, no aliases."""
    if not path:
        return spark.createDataFrame([], "alias string, canonical string")
    shape = "entity_aliases map<string,string>, predicate_aliases map<string,string>"
    return spark.read.schema(shape).json(path, multiLine=True).select(F.explode(kind).alias("alias", "canonical"))


def read_labels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scope, facts, relationships) of a JSON label file, each with its ordinal."""
    fact = "struct<id:string,document_key:string,subject:string,predicate:string,value:string,unit:string,currency:string,temporal_scope:string,physical_page_number:int,evidence_quote:string>"
    shape = f"scope array<struct<document_key:string,physical_pages:array<int>>>, facts array<{fact}>, relationships array<struct<id:string,fact_a_id:string,fact_b_id:string,classification:string>>"
    raw = spark.read.schema(shape).json(path, multiLine=True)
    part = lambda name: raw.select(F.posexplode(name).alias("ordinal", "x")).select("ordinal", "x.*")
    scope = part("scope").withColumnRenamed("physical_pages", "pages")
    facts = part("facts").withColumnsRenamed({"physical_page_number": "page", "evidence_quote": "quote"})
    return scope, facts, part("relationships").withColumnsRenamed({"fact_a_id": "a", "fact_b_id": "b"})


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """file_name, content and sha256 of binary files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "content", F.sha2("content", 256).alias("sha256"))


def parse_files(files: DataFrame, parser: PageParser) -> DataFrame:
    """(file_name, sha256, page, text, error): pages by a parser that is given; errors are values, not exceptions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, content, digest in zip(batch["file_name"], batch["content"], batch["sha256"]):
                if not content:
                    out.append((name, digest, None, None, "empty"))
                elif b"%PDF-" not in bytes(content[:1024]):
                    out.append((name, digest, None, None, "not_pdf"))
                else:
                    try:
                        pages = parser(bytes(content))
                        out += [(name, digest, k, t, None) for k, t in enumerate(pages, 1)] or [(name, digest, None, None, "no_pages")]
                    except PermissionError:
                        out.append((name, digest, None, None, "encrypted"))
                    except Exception as e:  # a bad file must not end the job
                        out.append((name, digest, None, None, f"corrupt: {type(e).__name__}"))
            yield pd.DataFrame(out, columns=["file_name", "sha256", "page", "text", "error"]).astype({"page": "Int32"})

    return files.select("file_name", "content", "sha256").mapInPandas(run, "file_name string, sha256 string, page int, text string, error string")


def table_provider(table: DataFrame, keys: list[str]) -> Provider:
    """Candidates that a table has for the rows asked for."""
    return lambda asked: table.join(asked.select(*keys).distinct(), keys, "left_semi")


def tie_break(pairs: DataFrame, decide: Provider | None) -> DataFrame:
    """Decisions on the ambiguous pairs that were asked about, and no others; without a resolver, none."""
    if decide is None:
        return pairs.limit(0).select("pair_id", F.lit(False).alias("same_entity"), "similarity")
    decided = decide(pairs).where("same_entity").select("pair_id", "same_entity").distinct()
    return pairs.join(decided, "pair_id").select("pair_id", "same_entity", "similarity")


def split_candidates(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined with ``problem``) by the contract of a candidate."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    problem = F.when(blank("subject"), "blank subject").when(blank("predicate"), "blank predicate").when(blank("value"), "blank value").when(F.coalesce(F.length("quote") < 1, F.lit(True)), "empty quote").when(F.coalesce(F.col("page") < 1, F.lit(True)), "bad page")
    judged = candidates.withColumn("problem", problem)
    trimmed = {c: F.trim(F.col(c)) for c in ("subject", "predicate", "value")}
    return judged.where("problem IS NULL").drop("problem").withColumns(trimmed), judged.where("problem IS NOT NULL")


#: Errors that a later call may not meet again.
PASSING = (ConnectionError, TimeoutError)


def retrying(call: Callable[[], object], attempts: int = 4, base: float = 2.0, sleep: Callable[[float], None] = time.sleep, passing: tuple[type[Exception], ...] = PASSING) -> tuple[object, int]:
    """The call's result and the number of calls made; only ``passing`` errors are tried again, after waits that double."""
    if attempts < 1 or base < 0:
        raise ValueError("attempts is 1 or more, base 0 or more")
    waits = [base * 2**k for k in range(attempts - 1)]
    while True:
        try:
            return call(), attempts - len(waits)
        except passing:
            if not waits:
                raise
            sleep(waits.pop(0))
