"""Corpus pipeline: documents to packed training sequences, one written table after another."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from laborlake.llm import cube_mixing, packing, simhash, suffix_dedup, toxicity
from laborlake.llm.common import scratch, table

DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go; it learns from the same rows as op7."""
    learnable = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2
    docs = docs.select(*DOCUMENTS)
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), "toxic", learnable)
    return toxicity.clean(docs, model, threshold=0.3)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: the one with the smallest doc_id, rows without
    an id last, and of one id the one with the smallest hash of its text.  Rows equal in both
    are one; they keep the smallest lang, source and n_chars."""
    key = [F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).alias("key"), "th"]
    stay = simhash.representatives(docs).select(*key)
    rows = (docs.select(*DOCUMENTS, F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
            .select(*DOCUMENTS, *key))
    return (rows.join(stay, ["none", "key", "th"]).groupBy("none", "key", "th")
            .agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"), F.min(F.struct("lang", "source", "n_chars")).alias("rest"))
            .select("doc_id", "text", "rest.*").select(*DOCUMENTS))


#: One UTF-8 character, bytes read as Latin-1 letters; what no character covers is a stray byte.
_CHARACTER = ("[\\x00-\\x7f]|[\\xc2-\\xdf][\\x80-\\xbf]|\\xe0[\\xa0-\\xbf][\\x80-\\xbf]|[\\xe1-\\xec\\xee\\xef][\\x80-\\xbf]{2}|"
              "\\xed[\\x80-\\x9f][\\x80-\\xbf]|\\xf0[\\x90-\\xbf][\\x80-\\xbf]{2}|[\\xf1-\\xf3][\\x80-\\xbf]{3}|\\xf4[\\x80-\\x8f][\\x80-\\xbf]{2}")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; a document with nothing left goes.

    A cut may part a character's bytes; the stray bytes are left out of the text, and nothing
    else.  Rows alike in id and text get the same text each, whatever their other columns."""
    got = suffix_dedup.dedup(docs).where("n_removed < n_bytes or n_bytes = 0")
    # One partitioning serves the distinct and the join: the texts are shuffled once.
    key = [F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("key")]
    kept = got.select(*key, "th", "kept").dropDuplicates(["none", "key", "th"])
    rest = docs.select("doc_id", *key, F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "lang", "source")
    letters = F.regexp_replace(F.decode("kept", "ISO-8859-1"), f"({_CHARACTER})|[\\x80-\\xff]", "$1")
    whole = F.when(F.is_valid_utf8(F.col("kept").cast("string")), F.col("kept").cast("string")).otherwise(
        F.encode(letters, "ISO-8859-1").cast("string"))
    return (kept.join(rest, ["none", "key", "th"]).withColumn("text", whole).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
            .select(*DOCUMENTS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    Rows alike in id and text share their copies, one more for the first ones if they are uneven."""
    copies = (cube_mixing.mix(docs).groupBy(F.col("doc_id").alias("id"), "th")
              .agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("alike")).where("copies > 0"))
    docs = docs.select(*DOCUMENTS).withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    same = docs["doc_id"].eqNullSafe(copies["id"]) & (docs["th"] == copies["th"])
    taken = docs.join(copies, same).select(*DOCUMENTS, docs["th"], "copies", "alike")
    place = F.row_number().over(Window.partitionBy("doc_id", "th").orderBy("lang", "source", "n_chars"))
    share = F.floor(F.col("copies") / F.col("alike")) + (place <= F.col("copies") % F.col("alike")).cast("int")
    alike = taken.where("alike > 1").withColumn("copies", share).where("copies > 0")
    return (taken.where("alike = 1").unionByName(alike)
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*DOCUMENTS))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every row's text (null: empty) in training sequences; each row is packed."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", near_dedup),
    ("suffix_dedup", cut_repeats),
    ("mix_sources", mix_sources),
    ("packing", pack_documents),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = scratch(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
