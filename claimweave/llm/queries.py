"""The operators' queries over whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, collision_search, filter_audit, importance_resampling, jaccard_join, packing, pivot_dedup, quality, sentencepiece_fst, token_counts, token_output, toxicity, url_filter

TOKENIZER = "byte_bpe_50k.json"
VOCABULARY = 50_257


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and what they decode to, by digests."""
    decoded = sentencepiece_fst.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return decoded.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"),
        F.length("text").cast("long").alias("decoded_chars"), F.sha2("text", 256).alias("decoded_sha256"),
    )


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    return chat_format.read_back(chat_format.examples(rows.unionByName(extra)))


OP2_SQL = """
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
    SELECT *, regexp_replace(regexp_replace(replace(text, '\\', '\\s'),
        '<(\\||/?s>|</?SYS>>|/?start_of_turn>|/?end_of_turn>)', '<\\\\z\\1', 'g'), '\\[(/?INST\\])', '[\\\\z\\1', 'g') AS body,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
        count(*) OVER (PARTITION BY conv_id) AS n
    FROM turns
), placed AS (
    SELECT *, sum(length('<|turn|>' || role || '<|says|>' || body || '<|end|>')) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM escaped
)
SELECT conv_id,
    count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(upto) FILTER (role = 'assistant' OR k = n)::BIGINT AS formatted_chars,
    count(*) FILTER (role = 'assistant' OR k = n) AS n_examples
FROM placed GROUP BY conv_id
"""

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS rules(host, path, verdict)")
    judged = url_filter.judge(table(spark, sf_dir, "pages"), rules)
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


OP3_SQL = f"""
WITH rules(rh, rp, rv) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
parts AS (
    SELECT row_number() OVER () AS k, page_id,
        translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
), fitting AS (
    SELECT k, rh || rp AS rule, rv, row_number() OVER (PARTITION BY k ORDER BY length(rh || rp) DESC, length(rh) DESC, rv DESC) AS place
    FROM parts JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
)
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM parts LEFT JOIN (SELECT * FROM fitting WHERE place = 1) AS best USING (k)
"""


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_digests(spark, table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER), end_id=0, vocabulary=VOCABULARY)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER), budget=512)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER), end_id=1, window=2048))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents"))


def op8_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return collision_search.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return toxicity.score(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")  # a null id isn't held out


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filter_audit.failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return filter_audit.audit(filter_audit.mask_counts(rows))


OP11_SQL = r"""
WITH texts AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), known AS (
    SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1
), failing AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        CASE WHEN len(words) < 50 THEN 'A' ELSE '' END
        || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
        || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
    FROM texts LEFT JOIN known USING (doc_id)
), counted AS (
    SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM failing GROUP BY 1, 2
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
    SELECT filter_order, step::INTEGER AS step, filter_order[step] AS own, filter_order[1:step - 1] AS before FROM orders, range(1, 6) AS r(step)
), judged AS (
    SELECT part, filter_order, step, own, n, n_good, n_toxic, contains(fails, own) AS fails_own, fails = own AS only_own,
        len(list_filter(string_split(before, ''), lambda c: c <> '' AND contains(fails, c))) > 0 AS gone FROM counted, steps
), figures AS (
    SELECT part, filter_order, step, own,
        coalesce(sum(n) FILTER (NOT gone AND NOT fails_own), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (NOT gone AND fails_own), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (gone AND fails_own), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (only_own), 0)::BIGINT AS unique_fails,
        coalesce(sum(n_good) FILTER (NOT gone AND fails_own), 0)::BIGINT AS good_lost,
        coalesce(sum(n_toxic) FILTER (NOT gone AND fails_own), 0)::BIGINT AS toxic_lost
    FROM judged GROUP BY ALL
)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM figures
"""


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, least=20, order=1, buckets=10_000, seed=2024)


OP12_SQL = r"""
WITH crc AS (
    SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab
), docs AS (SELECT row_number() OVER () AS k, doc_id, text FROM documents),
words AS (
    SELECT k, true AS own, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM docs
    UNION ALL
    SELECT 0, false, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), hashed AS (
    SELECT w, xor(4294967295, list_reduce([4294967295] || list_transform(range(length(hex(w)) // 2), lambda i: ('0x' || substr(hex(w), (2 * i + 1)::INTEGER, 2))::BIGINT),
        lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8))) % 10000 AS bucket FROM (SELECT DISTINCT w FROM words), crc
), counted AS (
    SELECT bucket, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM words JOIN hashed USING (w) GROUP BY 1
), totals AS (SELECT sum(s)::DOUBLE AS ss, sum(t)::DOUBLE AS tt FROM counted),
gains AS (
    SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (ss + 10000) / ((s + 1)::DOUBLE * (tt + 10000))))::BIGINT AS gain FROM counted, totals
), weighed AS (
    SELECT k, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM words JOIN hashed USING (w) JOIN gains USING (bucket) WHERE own GROUP BY 1
), scored AS (
    SELECT k, doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM docs LEFT JOIN weighed USING (k)
), placed AS (
    SELECT k, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS eligible FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * eligible // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (k)
"""


def op13_pivot_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_chat_format": op2_chat_format,
        "op3_url_filter": op3_url_filter,
        "op4_token_output": op4_token_output,
        "op5_token_counts": op5_token_counts,
        "op6_packing": op6_packing,
        "op7_jaccard_join": op7_jaccard_join,
        "op8_collision_search": op8_collision_search,
        "op9_quality_rules": op9_quality_rules,
        "op10_toxicity": op10_toxicity,
        "op11_filter_audit": op11_filter_audit,
        "op12_importance_resampling": op12_importance_resampling,
        "op13_pivot_dedup": op13_pivot_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": OP2_SQL, "op3_url_filter": OP3_SQL, "op11_filter_audit": OP11_SQL, "op12_importance_resampling": OP12_SQL}
