"""The registered queries of this folder: the operators with production parameters over whole tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laborlake.llm import (cube_mixing, dom_extract, hard_negatives, line_dedup, packing, quality_rules, simhash, spotsigs,
                           subword_quality, suffix_dedup, toxicity, turn_repair, warc)
from laborlake.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn
    return deco


@query("op1_spotsigs")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spotsigs.fingerprints(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"),
        spotsigs.fingerprint_text(F.col("signatures")).alias("fingerprint"),
        spotsigs.fingerprint_text(F.col("edited_signatures")).alias("edited_fingerprint"),
        "near_edited", "near_next", "n_signatures",
        spotsigs.length_partition(F.col("n_signatures"), 0.8).alias("length_partition"))


@query("op4_quality_rules")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op5_cube_mixing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube_mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies")


@query("op9_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_cost")


@query("op10_warc", """
WITH p AS (
  SELECT page_id, coalesce(strlen(html), 0) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (
  SELECT page_id, payload_bytes, min(page_id) OVER (PARTITION BY hex) AS first,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + (((('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS BIGINT), 5))::BIGINT) >> (15 - 5 * (i % 4))) & 31)::BIGINT, 1)), '')
    AS payload_digest FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM d
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op8_simhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query("op3_suffix_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def _crc(modulus: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


@query("op2_quality_classifier")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = subword_quality.learn(docs, table(spark, sf_dir, "labels"), "quality", _crc(3) != 1)
    return subword_quality.score(docs, model).select(
        "doc_id", F.coalesce(_crc(3) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), "toxic", _crc(4) != 2)
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(_crc(4) == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op6_html_extract")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dom_extract.extract(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op13_line_dedup", """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
common AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, common.key IS NOT NULL AS gone FROM k LEFT JOIN common ON k.key = common.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_common_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op12_turn_repair")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations")
    summary, rows = turn_repair.repair(turn_repair.damage(talks))
    keys = [F.col("conv_id").isNull().alias("cn"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("ck")]
    every = talks.select(F.col("conv_id").cast("long").alias("id")).distinct().select(
        F.col("id").alias("conv_id"), F.col("id").isNull().alias("cn"), F.coalesce("id", F.lit(0)).alias("ck"))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    out = (every.join(summary.select(*keys, *counts, "audit"), ["cn", "ck"], "left")
           .join(turn_repair.repaired_hash(rows), ["cn", "ck"], "left"))
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


@query("op11_hard_negatives", """
WITH valid AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other, a.label = r.label AS alike, list_dot_product(a.q, r.q)::BIGINT AS score
  FROM valid a JOIN valid r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id),
positive AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM pairs WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.other AS negative_id, positive_score, n.score AS negative_score
FROM positive JOIN pairs n USING (anchor_id)
WHERE NOT n.alike AND 30 * positive_score <= 100 * n.score AND 100 * n.score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.other)
QUALIFY row_number() OVER w <= 10
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    relabelled = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(
        F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives.mine(relabelled)
