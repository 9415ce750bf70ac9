"""Star schema: staging view, company and skill dimensions, fact, bridge.

Plan shape at scale
* ``dim_skill`` is a two-phase hash aggregate over the raw skill rows (map-side partial
  counts, so a skill holding a third of all rows is collapsed before the shuffle).
* ``fact`` needs no join for ``company_id``: the dimension is the distinct non-NULL
  names of the same staging rows and its key is ``md5(name)``, so the left join is the
  identity ``md5(company_name)`` (checked by ``dq_relationships``).  The score join is an
  equi join on ``posting_id`` that AQE may turn into a broadcast when the scored side is
  measured small.
* ``bridge`` is a left-semi join on ``posting_id`` followed by a distinct on
  ``(posting_id, skill)``; the distinct reuses the semi join's hash partitioning on
  ``posting_id`` so it adds no second shuffle.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlake.functions.lists import bool_text, surrogate_key

FACT_COLUMNS = ["posting_id", "company_id", "title", "location", "region", "seniority",
                "remote", "salary", "posted_month", "is_real", "source", "url",
                "predicted_salary", "salary_vs_market", "pay_band"]


@dataclass
class Star:
    stg: DataFrame
    dim_company: DataFrame
    dim_skill: DataFrame
    fact: DataFrame
    bridge: DataFrame
    fact_wide: DataFrame   # fact + company_name (denormalised for search pages)


def stage_postings(clean: DataFrame) -> DataFrame:
    """Curated ETL output → staging shape (rename, trim, boolean provenance)."""
    cols = set(clean.columns)
    opt = lambda c, t="string": F.col(c) if c in cols else F.lit(None).cast(t)
    return (clean.filter(F.col("posting_id").isNotNull())
                 .select("posting_id",
                         F.trim("title").alias("title"),
                         F.col("company").alias("company_name"),
                         "location", "region", "seniority", "remote",
                         F.col("salary_clean").alias("salary"),
                         "posted_month",
                         bool_text(opt("is_real")).alias("is_real"),
                         opt("source").alias("source"),
                         opt("url").alias("url")))


def build_dim_company(stg: DataFrame) -> DataFrame:
    return (stg.filter(F.col("company_name").isNotNull())
               .select("company_name").distinct()
               .select(surrogate_key("company_name").alias("company_id"), "company_name"))


def build_dim_skill(posting_skill: DataFrame) -> DataFrame:
    return (posting_skill.filter(F.col("skill").isNotNull())
                         .groupBy("skill").agg(F.count(F.lit(1)).alias("posting_count"))
                         .select(surrogate_key("skill").alias("skill_id"),
                                 F.col("skill").alias("skill_name"), "posting_count"))


def build_fact(stg: DataFrame, scores: DataFrame) -> DataFrame:
    return build_fact_wide(stg, scores).drop("company_name")


def build_fact_wide(stg: DataFrame, scores: DataFrame) -> DataFrame:
    """Fact plus ``company_name`` — the name is on the staging row already, so carrying
    it costs no join (the narrow fact is this frame minus the column)."""
    cols = set(stg.columns)
    opt = lambda c: F.col(c) if c in cols else F.lit(None).cast("string")
    postings = stg.filter(F.col("title").isNotNull()).select(
        "posting_id",
        surrogate_key("company_name").alias("company_id"),
        "title", "location", "region", "seniority", "remote", "salary", "posted_month",
        "is_real", opt("source").alias("source"), opt("url").alias("url"), "company_name")
    s = scores.select("posting_id", "predicted_salary", "salary_vs_market", "pay_band")
    return (postings.join(s, "posting_id", "left")
                    .withColumn("pay_band", F.coalesce("pay_band", F.lit("unknown")))
                    .select(*FACT_COLUMNS, "company_name"))


def build_bridge(posting_skill: DataFrame, fact: DataFrame) -> DataFrame:
    return (posting_skill.filter(F.col("skill").isNotNull())
                         .join(fact.select("posting_id"), "posting_id", "left_semi")
                         .select("posting_id", "skill").distinct()
                         .select("posting_id", surrogate_key("skill").alias("skill_id")))


def build_star(stg: DataFrame, posting_skill: DataFrame, scores: DataFrame) -> Star:
    wide = build_fact_wide(stg, scores)
    fact = wide.drop("company_name")
    return Star(stg=stg, fact_wide=wide,
                dim_company=build_dim_company(stg),
                dim_skill=build_dim_skill(posting_skill),
                fact=fact,
                bridge=build_bridge(posting_skill, fact))


def bridge_skill_names(bridge: DataFrame, dim_skill: DataFrame) -> DataFrame:
    """bridge ⋈ dim_skill → (posting_id, skill_id, skill_name)."""
    return bridge.join(dim_skill.select("skill_id", "skill_name"), "skill_id")
