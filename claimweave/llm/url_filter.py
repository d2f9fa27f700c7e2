"""URL rules by hashed expressions, in DataFrame functions only.

Each URL expands into expressions: a suffix of its host joined with a prefix of its path. The first
32 bits of an expression's SHA-256 equi-join it with the rules; the whole digest then confirms, and
among the rules that fit the longest (host and path) wins, then the longest host, then block over allow.
Only suffixes with as many labels, and prefixes with as many characters, as some rule has are
expanded, so a URL's expansions are bounded by the rules and not by its own length.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: then up to
``?``, ``#`` or the end. A rule fits its host and all subdomains, if the path starts with the rule's.

Defined cases: a null URL, or one without ``://``, has an empty host and path and gets the default
verdict; repeated rows are returned as often as they come; other columns are not read; without
rules every URL gets the default; rules with a null host, or repeated, count once or not at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of the digest that the join compares.
PREFIX_DIGITS = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def compiled(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with rule text, digest, its prefix, labels and path length."""
    clean = rules.select(F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict").where("rule_host is not null")
    one = clean.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("rule_verdict"))  # block over allow
    digest = _digest(F.col("rule_host"), F.col("rule_path"))
    return one.select(
        "rule_host", "rule_path", "rule_verdict", digest.alias("rule_digest"),
        F.substring(digest, 1, PREFIX_DIGITS).alias("short"),
        F.size(F.split("rule_host", r"\.")).alias("labels"),
        F.length("rule_path").alias("path_length"),
    )


def judge(urls: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url", default: str = "allow") -> DataFrame:
    """id, url, host, path, rule (or null) and verdict of every row."""
    table = compiled(rules)
    # Scalars over the rules: the distinct label counts and path lengths.
    label_counts = table.agg(F.collect_set("labels")).scalar()
    path_lengths = table.agg(F.collect_set("path_length")).scalar()
    rows = urls.groupBy(F.col(id_column).alias("id"), F.col(url_column).alias("url")).agg(F.count(F.lit(1)).alias("copies"))
    parts = rows.select("id", "url", "copies", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), label_counts.alias("label_counts"), path_lengths.alias("path_lengths"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.filter("label_counts", lambda n: n <= F.size(labels)), lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    prefixes = F.transform(F.filter("path_lengths", lambda n: n <= F.length("path")), lambda n: F.col("path").substr(F.lit(1), n))
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: _digest(h, p))))
    exploded = parts.select("id", "url", "host", "path", "copies", F.explode_outer(expressions).alias("digest"))
    hits = exploded.withColumn("short", F.substring("digest", 1, PREFIX_DIGITS)).join(table, "short", "left").select(
        "id", "url", "host", "path", "copies",
        F.when(F.col("digest") == F.col("rule_digest"), F.struct(F.length(F.concat("rule_host", "rule_path")).alias("n"), F.length("rule_host").alias("h"), "rule_verdict", "rule_host", "rule_path")).alias("hit"),
    )
    best = hits.groupBy("id", "url", "host", "path", "copies").agg(F.max("hit").alias("hit"))
    judged = best.select(
        "id", "url", "host", "path", F.concat("hit.rule_host", "hit.rule_path").alias("rule"),
        F.coalesce("hit.rule_verdict", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"),
    )
    return judged.drop("copy")
