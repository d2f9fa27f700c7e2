"""Pairs of facts to compare. Facts: fact_id, document_id, entity_key, predicate_key, and whatever else."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.sources.scratch import spread, stored


def _sides(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(facts.select(*(F.col(c).alias(f"{x}_{c}") for c in facts.columns)) for x in "ab")


def _in_order() -> Column:
    return F.struct("a_document_id", "a_fact_id") < F.struct("b_document_id", "b_fact_id")


#: Rows of a key's part; a key with more is cut in as many parts as it fills.
PART_ROWS = 4096


def in_cells(rows: DataFrame, key: list[str], by: list[str], part_rows: int = PART_ROWS) -> DataFrame:
    """``rows`` with ``_part`` and ``_cell``, ready to be joined with themselves on a key that may be frequent.

    A key of n rows is cut in p parts by a hash of ``by``, and its pairs of rows lie in p x p cells, part by part, all of about the
    same size. A row goes to the p cells of its part; one of part i in cell j meets those of part j in cell i (``same_cell``), so a
    cell is a join key of its own and no task gets a frequent key whole. Keys are counted first; rows of those that fill one
    part move once, as in a plain join."""
    return _dealt(rows, frequent_keys(rows, key, part_rows), key, by)


def frequent_keys(rows: DataFrame, key: list[str], part_rows: int) -> DataFrame:
    """Keys with more rows than a part holds, and the number of ``_parts`` that they fill."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > part_rows).select(*key, F.ceil(F.col("_n") / part_rows).cast("int").alias("_parts"))


def _dealt(rows: DataFrame, large: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    cut = rows.join(large, key, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    placed = cut.withColumn("_part", F.pmod(F.xxhash64(*by), "_parts").cast("int")).withColumn("_cell", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return placed.select(*rows.columns, "_part", "_cell")


def same_cell() -> Column:
    return (F.col("a__part") == F.col("b__cell")) & (F.col("a__cell") == F.col("b__part"))


def block_pairs(facts: DataFrame, cross_document_only: bool = True, part_rows: int = PART_ROWS) -> DataFrame:
    """Pairs within an entity and predicate, in order of document and fact; a frequent block is dealt out in cells.

    Frequent blocks are stored first, so that Spark knows their number and broadcasts them: facts move once for the join, not for a look at
    their block's size too. Where there are none, facts move once for both sides."""
    key = ["entity_key", "predicate_key"]
    large = stored(frequent_keys(facts, key, part_rows), "frequent-blocks")
    if large.isEmpty():
        a, b = _sides(facts.repartition(*key))
        cell = F.lit(True)
    else:
        a, b = _sides(_dealt(facts, large, key, ["fact_id", "document_id"]))
        cell = same_cell()
    met = a.join(b, (F.col("a_entity_key") == F.col("b_entity_key")) & (F.col("a_predicate_key") == F.col("b_predicate_key")) & cell)
    pairs = met.where(_in_order() & (F.col("a_fact_id") != F.col("b_fact_id"))).drop("a__part", "a__cell", "b__part", "b__cell")
    if cross_document_only:
        pairs = pairs.where(~F.col("a_document_id").eqNullSafe(F.col("b_document_id")))
    return pairs.withColumn("resolved", F.lit(False))


def in_shared_blocks(facts: DataFrame) -> DataFrame:
    """Facts of the entities and predicates that more than one document has; no others are in a pair of two documents.

    Blocks are told by keys and documents alone, and stored, so that Spark knows their number: where they are few, facts don't move."""
    key = ["entity_key", "predicate_key"]
    documents = facts.groupBy(*key).agg(F.min("document_id").alias("_first"), F.max("document_id").alias("_last"))
    return facts.join(stored(documents.where("_first != _last").select(*key), "shared-blocks"), key, "left_semi")


def delta_pairs(facts: DataFrame, new_documents: DataFrame) -> DataFrame:
    """The pairs of ``block_pairs`` that touch a new document: new facts meet all facts, not all meet all.

    Facts are marked by the documents' ids, which are stored so that Spark knows their size: facts don't move by document, of which one may hold
    most of them. Facts of two new documents meet in the order of these."""
    ids = stored(new_documents.select("document_id").distinct().withColumn("_new", F.lit(True)), "new-documents")
    marked = facts.join(ids, "document_id", "left").withColumn("_new", F.coalesce("_new", F.lit(False)))
    n, o = (df.select(*(F.col(c).alias(f"{x}_{c}") for c in df.columns)) for df, x in ((marked.where("_new"), "n"), (marked, "o")))
    same = (F.col("n_entity_key") == F.col("o_entity_key")) & (F.col("n_predicate_key") == F.col("o_predicate_key")) & (F.col("n_document_id") != F.col("o_document_id"))
    first = F.col("n_document_id") < F.col("o_document_id")
    met = n.join(o, same & (~F.col("o__new") | first)).withColumn("_first", first)
    return met.select(*(F.when(F.col("_first"), F.col(f"{x}_{c}")).otherwise(F.col(f"{y}_{c}")).alias(f"{side}_{c}") for side, x, y in (("a", "n", "o"), ("b", "o", "n")) for c in facts.columns), F.lit(False).alias("resolved"))


def pair_id(a: Column, b: Column) -> Column:
    return F.concat(F.least(a.cast("string"), b.cast("string")), F.lit("::"), F.greatest(a.cast("string"), b.cast("string")))


def telling_letters(keys: DataFrame, low: float) -> DataFrame:
    """(predicate_key, entity_key, letters): as many of a name's letters, the rarest of its predicate first, as a similar
    name must share one of. Letters are numbered by how often they came before.

    Names alike by ``low`` share at least low / (2 - low) of a name's letters; so one lies among as many of the first
    as are left out of that, and one more, in any order that all names share."""
    letters = F.regexp_extract_all("entity_key", F.lit("(?s)."), F.lit(0))
    numbered = F.transform(letters, lambda c, i: F.concat(c, F.size(F.filter(F.slice(letters, 1, i + 1), lambda d: d == c)).cast("string")))
    each = keys.select("predicate_key", "entity_key", F.size(letters).alias("n"), F.explode(numbered).alias("letter"))
    often = each.groupBy("predicate_key", "letter").agg(F.count(F.lit(1)).alias("often"))
    by = each.join(often, ["predicate_key", "letter"]).groupBy("predicate_key", "entity_key", "n").agg(F.array_sort(F.collect_list(F.struct("often", "letter"))).alias("ls"))
    kept = F.slice("ls", F.lit(1), F.col("n") - F.ceil(F.col("n") * (low / (2 - low)) - 1e-9).cast("int") + 1)
    return by.select("predicate_key", "entity_key", F.transform(kept, lambda x: x["letter"]).alias("letters"))


def common_length(p: str, q: str) -> int:
    """The length of the longest common subsequence, a letter of ``q`` at a time over all of ``p`` as bits."""
    places: dict[str, int] = {}
    for k, c in enumerate(p):
        places[c] = places.get(c, 0) | 1 << k
    full = (1 << len(p)) - 1
    row = full
    for c in q:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(p) - row.bit_count()


#: Names up to these lengths are compared in arrays of that width; longer ones, or those that difflib treats apart, one by one.
WIDTHS = (16, 32, 64)


def _block_ratios(left: list[str], right: list[str]) -> np.ndarray:
    """``SequenceMatcher.ratio`` of each pair, for names of up to 199 letters: longest common blocks, the earliest in the left name and then in
    the right one first, and again before and behind them, for all pairs at once."""
    n, width = len(left), max(1, *map(len, left), *map(len, right))
    xs, ys = (np.array(side, dtype=f"U{width}").view(np.uint32).reshape(n, width) for side in (left, right))
    la, lb = (np.fromiter(map(len, side), np.int16, n) for side in (left, right))
    matched, places = np.zeros(n, np.int64), np.arange(width, dtype=np.int16)
    pair, alo, ahi, blo, bhi = np.arange(n), np.zeros(n, np.int16), la, np.zeros(n, np.int16), lb
    while len(pair):
        x, y = xs[pair], ys[pair]
        inside = (places >= blo[:, None]) & (places < bhi[:, None])
        best, besti, bestj = (np.zeros(len(pair), np.int16) for _ in range(3))
        run = np.zeros((len(pair), width + 1), np.uint8)
        for i in range(int(alo.min()), int(ahi.max())):
            hit = (x[:, i : i + 1] == y) & inside
            hit &= ((alo <= i) & (i < ahi))[:, None]
            run[:, 1:] = (run[:, :-1] + 1) * hit
            j = run.argmax(1)
            length = run[np.arange(len(pair)), j].astype(np.int16)
            longer = length > best
            best[longer], besti[longer], bestj[longer] = length[longer], i + 1 - length[longer], j[longer] - length[longer]
        found = best > 0
        matched += np.bincount(pair[found], best[found], n).astype(np.int64)
        before, behind = found & (alo < besti) & (blo < bestj), found & (besti + best < ahi) & (bestj + best < bhi)
        cut = [(pair, pair), (alo, besti + best), (besti, ahi), (blo, bestj + best), (bestj, bhi)]
        pair, alo, ahi, blo, bhi = (np.concatenate([p[before], q[behind]]) for p, q in cut)
    return 2.0 * matched / np.maximum(la.astype(np.int64) + lb, 1)


def similarities(left: pd.Series, right: pd.Series, low: float) -> pd.Series:
    """``SequenceMatcher.ratio`` of pairs of names; of long ones that can't reach ``low``, 0: what matches is a common subsequence,
    so its greatest length tells these apart."""
    a, b, out = left.tolist(), right.tolist(), np.zeros(len(left))
    width = np.searchsorted(WIDTHS, np.maximum(left.str.len(), right.str.len()))
    for w in range(len(WIDTHS)):
        if len(at := np.flatnonzero(width == w)):
            out[at] = _block_ratios([a[k] for k in at], [b[k] for k in at])
    for k in np.flatnonzero(width == len(WIDTHS)):
        if 2 * common_length(a[k], b[k]) >= low * (len(a[k]) + len(b[k])):
            out[k] = difflib.SequenceMatcher(None, a[k], b[k]).ratio()
    return pd.Series(out)


def ambiguous_pairs(facts: DataFrame, low: float = 0.82, high: float = 0.97, top: int | None = 20, part_rows: int = PART_ROWS) -> DataFrame:
    """(pair_id, a_fact_id, b_fact_id, similarity): facts of one predicate and two documents whose different
    entity keys are alike. Names meet once for each predicate, in the list of the first telling letter that both have, and are
    compared in the orders that their facts' documents have, if any, after a bound on their lengths. A frequent letter's list is dealt
    out in cells. The best ``top`` are returned, or all."""
    keys = facts.where("entity_key != ''").groupBy("predicate_key", "entity_key").agg(F.min("document_id").alias("first"), F.max("document_id").alias("last"))
    listed = telling_letters(keys, low).join(keys, ["predicate_key", "entity_key"]).withColumn("letter", F.explode("letters"))
    a, b = _sides(in_cells(listed, ["predicate_key", "letter"], ["entity_key"], part_rows))
    a, b = spread(a, "a_predicate_key", "a_letter", "a__part", "a__cell"), spread(b, "b_predicate_key", "b_letter", "b__cell", "b__part")
    la, lb = F.length("a_entity_key"), F.length("b_entity_key")
    shared = F.array_min(F.array_intersect("a_letters", "b_letters"))  # of the lists that hold both names, one has the pair
    met = a.join(b, (F.col("a_predicate_key") == F.col("b_predicate_key")) & (F.col("a_letter") == F.col("b_letter")) & same_cell())
    met = met.where((F.col("a_entity_key") < F.col("b_entity_key")) & (2 * F.least(la, lb) >= low * (la + lb)) & (shared == F.col("a_letter")))
    # The left name is that of the earlier document, and a ratio may differ by the order of names.
    order = lambda x, y: F.when(F.col(f"{x}_first") < F.col(f"{y}_last"), F.struct(F.col(f"{x}_entity_key").alias("key_a"), F.col(f"{y}_entity_key").alias("key_b")))
    met = met.select(F.col("a_predicate_key").alias("predicate_key"), F.explode(F.array_compact(F.array(order("a", "b"), order("b", "a")))).alias("_keys")).select("predicate_key", "_keys.*")

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return similarities(a, b, low)

    near = met.withColumn("similarity", ratio("key_a", "key_b")).where((F.col("similarity") >= low) & (F.col("similarity") < high))
    a, b = _sides(facts.select("fact_id", "document_id", "entity_key", "predicate_key"))
    joined = near.join(a, (F.col("a_entity_key") == F.col("key_a")) & (F.col("a_predicate_key") == F.col("predicate_key")))
    joined = spread(joined, "key_b", "predicate_key").join(b, (F.col("b_entity_key") == F.col("key_b")) & (F.col("b_predicate_key") == F.col("predicate_key")) & (F.col("a_document_id") < F.col("b_document_id")))
    out = joined.select(pair_id(F.col("a_fact_id"), F.col("b_fact_id")).alias("pair_id"), "a_fact_id", "b_fact_id", "similarity")
    return out.orderBy(F.desc("similarity"), "pair_id").limit(top) if top else out


def resolved_pairs(facts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Pairs that a tie-break (pair_id, same_entity, similarity) found to name one entity; both facts must
    exist, share the predicate, and differ in document."""
    yes = decisions.where("same_entity").select(F.split_part("pair_id", F.lit("::"), F.lit(1)).alias("_a"), F.split_part("pair_id", F.lit("::"), F.lit(2)).alias("_b"), "similarity").distinct()
    a, b = _sides(facts)
    pairs = yes.join(a, F.col("_a") == F.col("a_fact_id").cast("string")).join(b, F.col("_b") == F.col("b_fact_id").cast("string"))
    return pairs.where((F.col("a_predicate_key") == F.col("b_predicate_key")) & (F.col("a_document_id") != F.col("b_document_id"))).drop("_a", "_b").withColumn("resolved", F.lit(True))
