"""Comparison keys of names, predicates and scopes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .fixed_values import COMPOUND_SUFFIXES, LEGAL_SUFFIXES

WORD = r"([\p{L}\p{N}]+)"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(1))


def comparison_key(text: Column) -> Column:
    """Lower-cased words joined by a space, ``&`` read as "and". Text beyond ASCII goes through ``folded`` first."""
    return F.array_join(words(F.replace(text, F.lit("&"), F.lit(" and "))), " ")


@F.pandas_udf(StringType())
def _compatible(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t).casefold(), na_action="ignore")


def folded(text: Column) -> Column:
    """Text whose compatibility forms and cases are one: ligatures, full width, sharp s. ASCII text stays as it is,
    natively, and goes through the Arrow function as null. Marked as not deterministic, it isn't copied into later expressions."""
    return F.coalesce(_compatible.asNondeterministic()(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


@F.pandas_udf(StringType())
def _one_case(texts: pd.Series) -> pd.Series:
    return texts.map(str.casefold, na_action="ignore")


def case_folded(text: Column) -> Column:
    """Text whose cases are one, sharp s included, and whose compatibility forms stay apart; ASCII text as in ``folded``."""
    return F.coalesce(_one_case.asNondeterministic()(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def scope_key(text: Column) -> Column:
    """Words of a scope; null and blank are null."""
    return F.when(F.trim(text) != "", F.array_join(words(text), " "))


def clean(text: Column) -> Column:
    """Words of a text; blank stays empty, null stays null."""
    return F.array_join(words(text), " ")


def _array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def stripped_name(key: Column, drop_article: bool = True) -> tuple[Column, Column]:
    """(key without a leading article and trailing legal forms, or the full key if nothing would be left; the forms removed)."""
    tokens = F.split(key, " ")
    if drop_article:
        tokens = F.when((F.element_at(tokens, 1) == "the") & (F.size(tokens) > 1), F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))).otherwise(tokens)
    last, before = F.element_at(tokens, -1), F.try_element_at(tokens, F.lit(-2))
    one = F.array_contains(_array(LEGAL_SUFFIXES), last)
    two = one & F.coalesce(F.array_contains(_array(COMPOUND_SUFFIXES), before), F.lit(False))
    removed = F.when(two, 2).when(one, 1).otherwise(0)
    kept = F.array_join(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - removed, F.lit(0))), " ")
    forms = F.when(removed == 0, F.array().cast("array<string>")).otherwise(F.slice(tokens, F.size(tokens) - removed + 1, removed))
    return F.when(kept == "", key).otherwise(kept), forms


def normalize_entities(df: DataFrame, name: str, aliases: DataFrame | None = None) -> DataFrame:
    """Adds entity_key, alias_applied and removed_suffixes. ``aliases`` (alias, canonical): the full key is
    looked up first, then the stripped one; the target's legal forms go too, its article stays."""
    out = df.withColumn("_full", comparison_key(folded(F.col(name))))
    stripped, forms = stripped_name(F.col("_full"))
    out = out.withColumn("_stripped", stripped).withColumn("removed_suffixes", forms)
    if aliases is None:
        return out.withColumn("entity_key", F.col("_stripped")).withColumn("alias_applied", F.lit(False)).drop("_full", "_stripped")
    named = aliases.select(*(comparison_key(folded(F.col(c))).alias(c) for c in ("alias", "canonical")))
    target, _ = stripped_name(F.col("canonical"), drop_article=False)
    table = named.select(F.col("alias").alias("_alias"), target.alias("_target")).groupBy("_alias").agg(F.max("_target").alias("_target"))
    full, short = table.toDF("_full", "_by_full"), table.toDF("_stripped", "_by_short")
    out = out.join(full, "_full", "left").join(short, "_stripped", "left")
    hit = F.coalesce("_by_full", "_by_short")
    return out.withColumn("entity_key", F.coalesce(hit, "_stripped")).withColumn("alias_applied", hit.isNotNull()).drop("_full", "_stripped", "_by_full", "_by_short")


def canonical_predicates(df: DataFrame, predicate: str, aliases: DataFrame | None = None) -> DataFrame:
    """Adds predicate_key: the key, or what an alias of it stands for."""
    out = df.withColumn("predicate_key", comparison_key(folded(F.col(predicate))))
    if aliases is None:
        return out
    named = aliases.select(*(comparison_key(folded(F.col(c))).alias(c) for c in ("alias", "canonical")))
    table = named.groupBy(F.col("alias").alias("predicate_key")).agg(F.max("canonical").alias("_target"))
    return out.join(table, "predicate_key", "left").withColumn("predicate_key", F.coalesce("_target", "predicate_key")).drop("_target")
