"""Documents to pages, offsets, labels and extraction batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.functions.binding import let

ROMAN_OR_DIGITS = r"(?i)\A(?:page\s+)?([0-9]{1,4}|[ivxlcdm]{1,12})(?:\s*(?:/|of)\s*[0-9]{1,4})?\z"


def hashed(documents: DataFrame, content: str = "text") -> DataFrame:
    return documents.withColumn("sha256", F.sha2(F.col(content), 256))


def first_by_hash(documents: DataFrame, order: str, content: str = "text") -> DataFrame:
    """Every document with ``first_id``, the earliest of equal content, and whether it reuses that one.

    Ids and hashes alone are grouped and joined back; they are as many as the contents, so they are merged, not sent to the driver and back.
    Documents without content are each their own first."""
    hashes = hashed(documents, content)
    first = hashes.where("sha256 IS NOT NULL").groupBy("sha256").agg(F.min(order).alias("first_id"))
    found = hashes.join(first.hint("merge"), "sha256", "left").withColumn("first_id", F.coalesce("first_id", order))
    return found.withColumn("duplicate_reused", F.col(order) != F.col("first_id"))


def running_starts(lengths: Column, block: int = 16) -> Column:
    """The sum of the lengths before each: sums of whole blocks, then those within a block, so long arrays stay cheap."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda acc, x: acc + x)
    part = lambda k, n: F.slice(lengths, k * block + 1, n)
    sums = F.transform(F.sequence(F.lit(0), (F.size(lengths) / block).cast("int")), lambda k: total(part(k, F.lit(block))))
    firsts = F.aggregate(sums, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    return let({"firsts": firsts}, lambda b: F.transform(lengths, lambda _, i: F.get(b["firsts"], (i / block).cast("int")) + total(part((i / block).cast("int"), i % block))))


def to_pages(documents: DataFrame, separator: str = "\f", document: str = "document_id", text: str = "text") -> DataFrame:
    """A row for each page, numbered from 1, with offsets that run on across one separator a page; no shuffle."""
    pieces = F.split(F.col(text), F.lit("\\Q" + separator + "\\E"))
    whole = let({"pieces": pieces}, lambda p: let({"lengths": F.transform(p["pieces"], lambda x: F.length(x) + 1)}, lambda n: F.arrays_zip(p["pieces"].alias("text"), running_starts(n["lengths"]).alias("start"))))
    rows = documents.select(F.col(document).alias("document_id"), F.posexplode(whole).alias("at", "page"))
    text, start = rows["page"]["text"], rows["page"]["start"]
    return rows.select("document_id", (F.col("at") + 1).alias("page"), text.alias("text"), start.alias("start_offset"), (start + F.length(text)).alias("end_offset"))


def with_offsets(pages: DataFrame) -> DataFrame:
    """Offsets of stored pages (document_id, page, text)."""
    before = Window.partitionBy("document_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("int")
    return pages.withColumn("start_offset", start).withColumn("end_offset", F.col("start_offset") + F.length("text"))


def document_text(pages: DataFrame, separator: str = "\f") -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    return pages.groupBy("document_id").agg(ordered.alias("p")).select("document_id", F.array_join(F.transform("p", lambda x: x["text"]), separator).alias("text"))


def page_slice(text: Column, start: Column, end: Column) -> Column:
    """text[start:end], null unless 0 <= start < end <= length."""
    return F.when((start >= 0) & (start < end) & (end <= F.length(text)), F.substring(text, start + 1, end - start))


def layout_violations(pages: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """(document_id, page, problem) of pages out of sequence, with gaps between offsets, or a text that isn't the source's."""
    w = Window.partitionBy("document_id").orderBy("page")
    checked = pages.withColumn("_last", F.lag("page").over(w)).withColumn("_end", F.lag("end_offset").over(w))
    problem = (
        F.when(F.col("page") != F.coalesce(F.col("_last"), F.lit(0)) + 1, "page numbers are not consecutive")
        .when(F.col("start_offset") != F.coalesce(F.col("_end") + 1, F.lit(0)), "offsets are not consecutive")
        .when(F.col("end_offset") - F.col("start_offset") != F.length("text"), "offsets do not fit the text")
    )
    found = checked.select("document_id", "page", problem.alias("problem"))
    if documents is not None:
        both = pages.join(documents.select("document_id", F.col("text").alias("_source")), "document_id")
        differs = F.col("text") != F.substring("_source", F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset"))
        found = found.union(both.select("document_id", "page", F.when(differs, "the source differs").alias("problem")))
    return found.where("problem IS NOT NULL")


def page_label(text: Column) -> Column:
    """A printed page label, or null: no brackets around it, dashes and dots stripped once, digits or roman numerals."""
    trimmed = F.trim(text)
    bracketed = trimmed.rlike(r"(?s)\A\(.*\)\z") | trimmed.rlike(r"(?s)\A\[.*\]\z")
    bare = F.regexp_replace(trimmed, "^[-–—|·•]+|[-–—|·•]+$", "")
    return F.when(~bracketed, F.nullif(F.regexp_extract(bare, ROMAN_OR_DIGITS, 1), F.lit("")))


def label_is_year(label: Column) -> Column:
    return F.coalesce(label.try_cast("int").between(1900, 2099), F.lit(False))


def detect_labels(words: DataFrame) -> DataFrame:
    """(document_id, page, label) from positioned words (x0, y0, x1, y1, word, width, height).

    Words of the top and bottom tenth form lines (centres within max(2, 0.4 % of the height) of the line's
    mean); a whole line that is a label scores 4, a label at an edge (outermost 22 %) 3, two consecutive
    numbers of one line's edges make a spread. The best score, then the nearest to the edge wins; a tie
    between different labels gives null. A page's margin words are few, so the fold over them is short.
    """
    y, h = (F.col("y0") + F.col("y1")) / 2, F.col("height")
    margin = words.where((y <= 0.1 * h) | (y >= 0.9 * h)).withColumn("mid", y)
    by_page = margin.groupBy("document_id", "page").agg(
        F.array_sort(F.collect_list(F.struct("mid", "x0", "x1", "word"))).alias("ws"), F.max("height").alias("h"), F.max("width").alias("w"),
    )
    tolerance = F.greatest(F.lit(2.0), 0.004 * F.col("h"))
    kind = "array<struct<mean:double,n:int,words:array<struct<x0:double,x1:double,word:string>>>>"
    word = lambda x: F.struct(x["x0"].cast("double").alias("x0"), x["x1"].cast("double").alias("x1"), x["word"].alias("word"))

    def place(lines: Column, x: Column) -> Column:
        last = F.try_element_at(lines, F.lit(-1))
        joined = F.struct(((last["mean"] * last["n"] + x["mid"]) / (last["n"] + 1)).alias("mean"), (last["n"] + 1).alias("n"), F.concat(last["words"], F.array(word(x))).alias("words"))
        fresh = F.struct(x["mid"].cast("double").alias("mean"), F.lit(1).alias("n"), F.array(word(x)).alias("words"))
        fits = F.coalesce(F.abs(last["mean"] - x["mid"]) <= tolerance, F.lit(False))
        return F.when(fits, F.concat(F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(lines, F.array(fresh)))

    lines = by_page.select("document_id", "page", "h", "w", F.explode(F.aggregate("ws", F.array().cast(kind), place)).alias("line"))
    ordered = lines.withColumn("ws", F.array_sort("line.words")).withColumn("edge", F.least("line.mean", F.col("h") - F.col("line.mean")))
    text = F.array_join(F.transform("ws", lambda x: x["word"]), " ")
    edge_words = F.filter("ws", lambda x: ((x["x1"] <= 0.22 * F.col("w")) | (x["x0"] >= 0.78 * F.col("w"))) & page_label(x["word"]).isNotNull())
    labels = F.transform(edge_words, lambda x: page_label(x["word"]))
    first, second = F.try_element_at(labels, F.lit(1)), F.try_element_at(labels, F.lit(2))
    spread = (F.size(labels) == 2) & F.coalesce(second.try_cast("int") - first.try_cast("int") == 1, F.lit(False))
    label = F.when(page_label(text).isNotNull(), page_label(text)).when(spread, F.concat(first, F.lit("–"), second)).when(F.size(labels) == 1, first)
    scored = ordered.select("document_id", "page", "edge", label.alias("label"), F.when(page_label(text).isNotNull(), 4).otherwise(3).alias("score")).where(F.col("label").isNotNull() & ~label_is_year(F.col("label")))
    best = scored.withColumn("rank", F.dense_rank().over(Window.partitionBy("document_id", "page").orderBy(F.desc("score"), "edge"))).where("rank = 1")
    winners = best.groupBy("document_id", "page").agg(F.when(F.countDistinct("label") == 1, F.max("label")).alias("label"))
    return words.select("document_id", "page").distinct().join(winners, ["document_id", "page"], "left")


def coalesce_labels(visible: Column, metadata: Column) -> tuple[Column, Column]:
    """(label, source): a visible label wins over the file's own."""
    return F.coalesce(visible, metadata), F.when(visible.isNotNull(), "visible_text").when(metadata.isNotNull(), "pdf_metadata")


def page_batches(pages: DataFrame, max_chars: int = 50_000, max_pages: int = 8, resume_after: Column | int = 0) -> DataFrame:
    """(document_id, batch, page) by greedy packing in page order: a page that would exceed the characters,
    or the number of pages, opens the next batch; a page is never split. Pages up to ``resume_after`` go first."""
    todo = pages.where(F.col("page") > resume_after)
    ordered = todo.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page", F.length("text").alias("n")))).alias("ps"))
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("chars"), F.lit(0).alias("count"), F.array().cast("array<struct<page:bigint,batch:int>>").alias("out"))

    def add(acc: Column, p: Column) -> Column:
        opens = (acc["count"] == 0) | (acc["chars"] + p["n"] > max_chars) | (acc["count"] >= max_pages)
        batch = F.when(opens, acc["batch"] + 1).otherwise(acc["batch"])
        return F.struct(batch.alias("batch"), F.when(opens, p["n"]).otherwise(acc["chars"] + p["n"]).alias("chars"), F.when(opens, F.lit(1)).otherwise(acc["count"] + 1).alias("count"), F.concat(acc["out"], F.array(F.struct(p["page"].cast("bigint").alias("page"), batch.alias("batch")))).alias("out"))

    return ordered.select("document_id", F.explode(F.aggregate("ps", start, add)["out"]).alias("o")).select("document_id", "o.batch", "o.page")


def batch_counters(batches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Running checkpoints by batch: batches, pages and facts done so far."""
    facts = candidates.join(batches, ["document_id", "page"]).groupBy("document_id", "batch").agg(F.count(F.lit(1)).alias("facts"))
    per = batches.groupBy("document_id", "batch").agg(F.count(F.lit(1)).alias("pages")).join(facts, ["document_id", "batch"], "left")
    upto = Window.partitionBy("document_id").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    return per.select("document_id", "batch", F.sum("pages").over(upto).alias("completed_pages"), F.sum(F.coalesce("facts", F.lit(0))).over(upto).alias("facts_seen"))
