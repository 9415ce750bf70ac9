"""Job-board feed adapters: landed JSON pages → one normalized posting shape.

The HTTP fetching itself is not part of this library (see README); the adapters take
the *landed* pages (one row per API page, the job list as an array of structs), explode
them, apply the relevance filter and normalise every posting with column expressions.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlake.functions.lists import feed_country_region
from laborlake.functions.salary import native_currency, to_usd
from laborlake.functions.text import (blank_to_null, infer_seniority, is_remote,
                                      match_terms, month_from_iso, skills_or_extracted, term_contains)

# --- fixed values (must equal the reference for identical results) -------------------
REMOTIVE_REGION = "Remote"
ARBEITNOW_REGION = "Europe"
# ---------------------------------------------------------------------------------------

POSTING_COLUMNS = ["posting_id", "title", "company", "location", "region", "seniority", "remote",
                   "salary", "salary_currency_original", "required_skills", "description", "source",
                   "is_real", "url", "posted_month"]

ADZUNA_RESULT = ("struct<id:string,title:string,company:struct<display_name:string>,"
                 "location:struct<display_name:string>,salary_min:double,description:string,"
                 "redirect_url:string,created:string>")
REMOTIVE_JOB = ("struct<id:string,title:string,company_name:string,candidate_required_location:string,"
                "salary:string,tags:array<string>,description:string,url:string,publication_date:string>")
ARBEITNOW_JOB = ("struct<slug:string,title:string,company_name:string,location:string,tags:array<string>,"
                 "description:string,url:string>")


def normalize_posting(df: DataFrame, description_chars: int | None = None) -> DataFrame:
    """Per-source rows (posting_id, title, company, location, region, salary, tags,
    description, source, url, posted_month) → the posting shape; descriptions stay whole
    unless ``description_chars`` bounds them."""
    tags = F.col("tags")
    desc = F.coalesce(F.col("description"), F.lit(""))
    return df.select(
        "posting_id",
        blank_to_null("title").alias("title"),
        "company", "location", "region",
        infer_seniority("title", "description").alias("seniority"),
        is_remote("source", "title", "description").alias("remote"),
        to_usd("salary", "source").alias("salary"),
        native_currency("source").alias("salary_currency_original"),
        skills_or_extracted(tags, F.col("title"), F.col("description")).alias("required_skills"),
        (desc if description_chars is None else F.substring(desc, 1, description_chars)).alias("description"),
        "source",
        F.lit(True).alias("is_real"),
        "url",
        F.col("posted_month").cast("int").alias("posted_month"),
        *(["ingest_seq"] if "ingest_seq" in df.columns else []))


FEED_RANK = {"adzuna": 0, "remotive": 1, "arbeitnow": 2}


def _explode(pages: DataFrame, col: str, feed: str, *keep: str) -> DataFrame:
    """One row per job with its ingest order (feed, country, page, position)."""
    page = F.col("page").cast("bigint") if "page" in pages.columns else F.lit(0).cast("bigint")
    x = pages.select(*keep, page.alias("__page"), F.posexplode(col).alias("__pos", "j"))
    country = F.col("country") if "country" in keep else F.lit("")
    order = F.struct(F.lit(FEED_RANK[feed]).alias("feed"), country.alias("country"),
                     F.col("__page").alias("page"), F.col("__pos").alias("position"))
    return x.withColumn("ingest_seq", order).drop("__page", "__pos")


def adzuna_postings(pages: DataFrame) -> DataFrame:
    """Pages (country, results: array<result>) → postings."""
    j = _explode(pages, "results", "adzuna", "country")
    rows = j.select(
        F.concat(F.lit("adzuna_"), F.col("j.id")).alias("posting_id"),
        F.col("j.title").alias("title"),
        F.col("j.company.display_name").alias("company"),
        F.col("j.location.display_name").alias("location"),
        feed_country_region("country").alias("region"),
        F.col("j.salary_min").cast("string").alias("salary"),
        F.array().cast("array<string>").alias("tags"),
        F.col("j.description").alias("description"),
        F.concat(F.lit("adzuna_"), F.lower("country")).alias("source"),
        F.col("j.redirect_url").alias("url"),
        month_from_iso(F.col("j.created")).alias("posted_month"), "ingest_seq")
    return normalize_posting(rows)


def remotive_postings(pages: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """Pages (jobs: array<job>) → postings kept by the title relevance filter."""
    j = _explode(pages, "jobs", "remotive")
    t = F.array(*[F.lit(x) for x in (terms or [])]).cast("array<string>")
    j = j.filter(match_terms(F.coalesce(F.col("j.title"), F.lit("")), t))
    sal = F.col("j.salary")
    rows = j.select(
        F.concat(F.lit("remotive_"), F.col("j.id")).alias("posting_id"),
        F.col("j.title").alias("title"),
        F.col("j.company_name").alias("company"),
        F.col("j.candidate_required_location").alias("location"),
        F.lit(REMOTIVE_REGION).alias("region"),
        F.when(sal != "", sal).alias("salary"),
        F.col("j.tags").alias("tags"),
        F.col("j.description").alias("description"),
        F.lit("remotive").alias("source"),
        F.col("j.url").alias("url"),
        month_from_iso(F.col("j.publication_date")).alias("posted_month"), "ingest_seq")
    return normalize_posting(rows)


def arbeitnow_postings(pages: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """Pages (data: array<job>) → postings kept by the plain title-contains filter."""
    j = _explode(pages, "data", "arbeitnow")
    if terms:
        t = F.array(*[F.lit(x.lower()) for x in terms])
        j = j.filter(term_contains(F.coalesce(F.col("j.title"), F.lit("")), t))
    rows = j.select(
        F.concat(F.lit("arbeitnow_"), F.col("j.slug")).alias("posting_id"),
        F.col("j.title").alias("title"),
        F.col("j.company_name").alias("company"),
        F.col("j.location").alias("location"),
        F.lit(ARBEITNOW_REGION).alias("region"),
        F.lit(None).cast("string").alias("salary"),
        F.col("j.tags").alias("tags"),
        F.col("j.description").alias("description"),
        F.lit("arbeitnow").alias("source"),
        F.col("j.url").alias("url"),
        F.lit(None).cast("int").alias("posted_month"), "ingest_seq")
    return normalize_posting(rows)


def feeds_union(*frames: DataFrame) -> DataFrame:
    """Concatenate feed outputs by column name (missing columns → NULL)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def unique_postings(postings: DataFrame, seq: str = "ingest_seq") -> DataFrame:
    """Ingest-level dedupe: rows without a title skipped, last row per id wins."""
    from laborlake.operators.etl import dedupe_keep_last
    return dedupe_keep_last(postings, "posting_id", seq).drop(seq)
