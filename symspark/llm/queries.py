"""Registered queries of the operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_repair, decontaminate, knn_quality, line_dedup, mixing, ngram_jaccard_join, pii, pitman_yor, quality_cascade, warc
from .store import new_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(column: str, modulus: int):
    """crc32 of an id as text, modulo; null for a null id."""
    return F.crc32(F.col(column).cast("string")) % modulus


def op1_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.repair(_table(spark, sf_dir, "conversations"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join.near_duplicates(_table(spark, sf_dir, "documents"), size=3, similarity="0.9")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.col("item_list").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op4_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source"))


def op5_pii_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op6_warc_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    warc.write_archives(_table(spark, sf_dir, "pages"), folder)
    return warc.page_digests(warc.read_archives(spark, folder))


def op7_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cascade.quality_rules(_table(spark, sf_dir, "documents"))


def op8_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(_remainder("doc_id", 3) == 1, F.lit(False))
    model = knn_quality.fit(docs, _table(spark, sf_dir, "labels").where(~held_out))
    return knn_quality.score_quality(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_pitman_yor_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(_remainder("doc_id", 7) == 2, F.lit(False))
    docs = docs.select("doc_id", "text", (~held_out).alias("train"))
    model = pitman_yor.fit(docs)
    return pitman_yor.score(docs, model).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.kept_digest(line_dedup.drop_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_repair": op1_chat_repair,
        "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
        "op3_decontamination": op3_decontamination,
        "op4_pfair_mixing": op4_pfair_mixing,
        "op5_pii_deobfuscation": op5_pii_deobfuscation,
        "op6_warc_reassembly": op6_warc_reassembly,
        "op7_quality_cascade": op7_quality_cascade,
        "op8_knn_quality": op8_knn_quality,
        "op9_pitman_yor_lm": op9_pitman_yor_lm,
        "op10_line_dedup": op10_line_dedup,
    }


OP6_SQL = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), f AS (
    SELECT digest, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY digest
)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
    CASE WHEN f.first_id IS NOT NULL AND p.page_id IS DISTINCT FROM f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN f.first_id IS NOT NULL AND p.page_id IS DISTINCT FROM f.first_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest AND p.n >= 100
"""

OP10_SQL = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
    SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM docs
), keyed AS (
    SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), frequent AS (
    SELECT k, max(doc_id) AS last_id FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
    SELECT keyed.*, f.k IS NOT NULL AND keyed.doc_id <> f.last_id AS dropped FROM keyed LEFT JOIN frequent f ON keyed.k = f.k
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
    sha256(coalesce(string_agg(CASE WHEN NOT dropped THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


OP3_SQL = r"""
WITH d AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
    SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), win AS (
    SELECT item_id, w[i:i + 9] AS g, len(w[i:i + 9]) AS k FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT k FROM win),
place AS (
    SELECT doc_id, k, i, w[i:i + k - 1] AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)
), m AS (SELECT DISTINCT doc_id, i, p.k, item_id FROM place p JOIN win ON p.g = win.g),
hit AS (SELECT doc_id, count(DISTINCT word_at) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS word_at FROM m) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

OP7_SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
        string_split(coalesce(text, ''), chr(10)) AS every_line FROM documents
), win AS (
    SELECT doc_id, i, w[i:i + 7] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
), twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT word_at) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS word_at FROM twice) GROUP BY doc_id),
c AS (
    SELECT d.doc_id, text, w, every_line, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
    FROM (SELECT *, list_filter(every_line, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d) d LEFT JOIN rep ON d.doc_id = rep.doc_id
), f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR 10 * n_symbols > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 25 * n_words OR 10 * n_dup_lines > 5 * len(every_line)
        OR 2 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > length(regexp_replace(text, '[^A-Za-z]+', '', 'g'))
        OR len(list_distinct(w)) * len(list_distinct(w)) < len(w)) AS kept
FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": OP3_SQL, "op6_warc_reassembly": OP6_SQL, "op7_quality_cascade": OP7_SQL, "op10_line_dedup": OP10_SQL}
