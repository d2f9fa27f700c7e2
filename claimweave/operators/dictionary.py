"""Texts in normal form once each: distinct texts are normalised, kept if asked, and joined back to the rows that hold them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.sources.scratch import stored
from claimweave.sources.versioned import Table, VersionedTables

#: The one table of a kept dictionary.
DICTIONARY = {"forms": Table(("key",), ("key",))}


def _key(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)  # nulls are left out, so they differ from empty texts


def normalised(rows: DataFrame, texts: list[str], form: Callable[[DataFrame], DataFrame], kept: VersionedTables | None = None, seen: DataFrame | None = None) -> DataFrame:
    """``rows`` with the columns that ``form`` adds to a table of their distinct ``texts``.

    ``form`` sees each text once, whatever the number of rows; with ``kept``, tables over ``DICTIONARY``, only those that no earlier
    call has seen. Distinct texts are summed up before they move. The dictionary is stored, so that Spark knows its size: a
    small one is broadcast, one that is not is joined by a hash of the texts, where adaptive execution splits a frequent text.
    ``rows`` are read twice, unless ``seen``, a table that holds all their texts and is had more easily, is read for these."""
    asked = (rows if seen is None else seen).select(*texts).distinct().withColumn("key", _key(texts))
    if kept is None:
        made = stored(form(asked), "dictionary")
    else:
        change = kept.begin()
        known = change.matching("forms", asked)
        new = asked if known is None else asked.join(known.select("key"), "key", "left_anti")
        change.append("forms", form(new))
        change.commit()
        made = kept.read("forms")
    added = [c for c in made.columns if c not in (*texts, "key")]
    return rows.withColumn("_key", _key(texts)).join(made.select(F.col("key").alias("_key"), *added), "_key", "left").drop("_key")
