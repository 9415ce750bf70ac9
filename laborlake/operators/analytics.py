"""Serving analytics over the star schema (dashboard aggregates).

Each function takes the star frames and returns a lazy DataFrame.  Aggregations group
first and join dimension names afterwards, so the dimension join runs on at most one
row per group instead of one per bridge row.  Ordering adds a name / key tie-break so
results are reproducible.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlake.functions.lists import provenance_label


def real_salaried(fact: DataFrame) -> DataFrame:
    return fact.filter(F.col("salary").isNotNull() & F.col("is_real"))


def market_overview(fact: DataFrame, bridge: DataFrame) -> DataFrame:
    """Headline numbers over real postings, plus distinct skills seen on them."""
    real = fact.filter(F.col("is_real"))
    real_ids = real.select("posting_id")
    total_skills = (bridge.join(real_ids, "posting_id", "left_semi")
                          .agg(F.count_distinct("skill_id")).scalar())
    return real.agg(
        F.count(F.lit(1)).alias("total_postings"),
        F.count_distinct("company_id").alias("total_companies"),
        F.round(F.avg("salary")).alias("avg_salary"),
        F.round(F.avg(F.when(F.col("remote"), 1).otherwise(0)) * 100, 1).alias("remote_percent"),
    ).select("*", total_skills.alias("total_skills"))


def skill_counts_real(fact: DataFrame, bridge: DataFrame, dim_skill: DataFrame) -> DataFrame:
    real_ids = fact.filter(F.col("is_real")).select("posting_id")
    counts = (bridge.join(real_ids, "posting_id", "left_semi")
                    .groupBy("skill_id").agg(F.count(F.lit(1)).alias("posting_count")))
    return counts.join(dim_skill.select("skill_id", "skill_name"), "skill_id") \
                 .select("skill_name", "posting_count")


def top_skills(fact: DataFrame, bridge: DataFrame, dim_skill: DataFrame, limit: int = 15) -> DataFrame:
    return (skill_counts_real(fact, bridge, dim_skill)
            .orderBy(F.desc("posting_count"), F.asc("skill_name")).limit(limit))


def salary_by_seniority(fact: DataFrame) -> DataFrame:
    return (real_salaried(fact).groupBy("seniority")
            .agg(F.round(F.avg("salary")).alias("avg_salary"), F.count(F.lit(1)).alias("postings"))
            .orderBy(F.asc("avg_salary"), F.asc_nulls_last("seniority")))


def salary_by_region(fact: DataFrame) -> DataFrame:
    return (real_salaried(fact).groupBy("region")
            .agg(F.round(F.avg("salary")).alias("avg_salary"), F.count(F.lit(1)).alias("postings"))
            .orderBy(F.desc("avg_salary"), F.asc_nulls_last("region")))


def postings_by_month(fact: DataFrame) -> DataFrame:
    return (fact.filter(F.col("posted_month").isNotNull() & F.col("is_real"))
            .groupBy("posted_month").agg(F.count(F.lit(1)).alias("postings"))
            .orderBy("posted_month"))


def skill_premium(fact: DataFrame, bridge: DataFrame, dim_skill: DataFrame,
                  limit: int = 15, min_postings: int = 15) -> DataFrame:
    """Average salary per skill vs. the average of salaried real postings that have at
    least one skill (like-for-like baseline)."""
    scoped_fact = real_salaried(fact).select("posting_id", "salary")
    joined = bridge.join(scoped_fact, "posting_id")          # (posting_id, skill_id, salary)
    baseline = (scoped_fact.join(bridge.select("posting_id"), "posting_id", "left_semi")
                           .agg(F.avg("salary")).scalar())
    per_skill = (joined.groupBy("skill_id")
                       .agg(F.count(F.lit(1)).alias("postings"), F.avg("salary").alias("avg_raw"))
                       .filter(F.col("postings") >= min_postings))
    return (per_skill.join(dim_skill.select("skill_id", "skill_name"), "skill_id")
            .select("skill_name", "postings",
                    F.round("avg_raw").alias("avg_salary"),
                    F.round(F.col("avg_raw") - baseline).alias("premium_vs_average"))
            .orderBy(F.desc("avg_salary"), F.asc("skill_name")).limit(limit))


def salary_distribution(fact: DataFrame, bucket: int = 25000, ceiling: int = 250000) -> DataFrame:
    """Histogram: bucket start per salary; below 0 → -bucket, at/above ceiling → ceiling."""
    start = ((F.width_bucket(F.col("salary"), F.lit(0), F.lit(ceiling), F.lit(ceiling // bucket))
              - 1) * bucket).cast("bigint")
    return (real_salaried(fact).groupBy(start.alias("bucket_start"))
            .agg(F.count(F.lit(1)).alias("postings")).orderBy("bucket_start"))


def source_counts(fact: DataFrame) -> DataFrame:
    return (fact.groupBy(provenance_label("is_real").alias("kind"))
                .agg(F.count(F.lit(1)).alias("n")).orderBy("kind"))


def pay_band_distribution(scores: DataFrame) -> DataFrame:
    return (scores.groupBy("pay_band").agg(F.count(F.lit(1)).alias("count"))
                  .orderBy(F.desc("count"), F.asc("pay_band")))
