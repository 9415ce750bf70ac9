"""Batch ETL: dedupe, clean, skill bridge rows, the four batch aggregates and the audit.

All aggregates are two-phase hash aggregates (partial counts/sums map-side), so a
seniority or region holding a third of all postings is collapsed before the shuffle.
The median is exact, from counts of distinct salaries.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laborlake.functions.lists import skill_count
from laborlake.functions.salary import clean_salary


def _order_code(df: DataFrame, name: str) -> Column:
    """A long that never falls as the column rises (null lowest): numbers rounded down, dates
    as days, texts as their first seven bytes.  Ties are settled on the rows themselves."""
    c, kind = F.col(name), df.schema[name].dataType
    if isinstance(kind, (T.FractionalType, T.IntegralType)):
        code = c if isinstance(kind, T.IntegralType) else F.floor(F.least(F.greatest(c.cast("double"), F.lit(-9e18)), F.lit(9e18)))
    elif isinstance(kind, T.StringType):
        code = F.conv(F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), 1, 7)), 14, "0"), 16, 10)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        code = F.datediff(c, F.lit("1970-01-01").cast("date"))
    elif isinstance(kind, T.BooleanType):
        code = c.cast("int")
    else:
        return F.lit(0).cast("bigint")
    return F.coalesce(code.cast("bigint"), F.lit(-2 ** 63))


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One whole row per key, the first by ``order`` (nulls first; null keys are one key).

    A hash aggregate finds each key's lowest order code, a long, from (key, code) alone; the wide
    rows meet it once, and only rows with that code, few of each key, are put in order.  All three go
    by the key columns themselves: rows that lie by them already, in buckets, are not shuffled.
    A key with a null meets no code, and all its rows are put in order."""
    rows = df.withColumn("__code", _order_code(df, order[0]))
    low = rows.groupBy(*keys).agg(F.min("__code").alias("__low"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    return (rows.join(low, keys, "left").where(F.col("__low").isNull() | (F.col("__code") == F.col("__low")))
            .withColumn("__place", place).where(F.col("__place") == 1).select(*df.columns))


def dedupe_postings(raw: DataFrame, key: str | list[str] = "posting_id") -> DataFrame:
    """One row per key: the smallest by its other columns, in their order, so a task that
    runs again keeps the same row."""
    keys = [key] if isinstance(key, str) else list(key)
    others = [c for c in raw.columns if c not in keys]
    return first_rows(raw, keys, others) if others else raw.distinct()


#: So many repeated ids' hashes are handed to every task; with more, all rows are shuffled.
FEW_IDS = 2_000_000


def dedupe_apart(raw: DataFrame, folder: str, key: str | list[str] = "posting_id") -> DataFrame:
    """``dedupe_postings`` for rows of which few repeat: these are found by the hash of their key,
    settled in ``folder`` and put in order apart; all others stay where they are.  Keys that share
    a hash are only put in order together, each for itself."""
    keys = [key] if isinstance(key, str) else list(key)
    marked = raw.withColumn("__h", F.xxhash64(*keys))

    def settled(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")

    many = settled(marked.groupBy("__h").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__h"), "ids")
    if many.count() > FEW_IDS:
        return dedupe_postings(raw, keys)
    some = settled(marked.join(F.broadcast(many), "__h", "left_semi").drop("__h"), "rows")
    rest = marked.join(F.broadcast(many), "__h", "left_anti").drop("__h")
    return rest.unionByName(dedupe_postings(some, keys))


def dedupe_deterministic(raw: DataFrame, key: str, order_cols: list[str], keep: str = "min") -> DataFrame:
    """One row per key chosen by ``order_cols`` (min or max), ties by the other columns.  The
    order columns are fixed-width here, so the choice is an aggregate of a struct: partial
    aggregation keeps one candidate per key per task, never a whole group."""
    others = [c for c in raw.columns if c != key]
    s = F.struct(*[F.col(c) for c in order_cols], *[F.col(c).alias(f"__v_{c}") for c in others])
    pick = F.min(s) if keep == "min" else F.max(s)
    return (raw.groupBy(key).agg(pick.alias("__pick"))
               .select(key, *[F.col(f"__pick.__v_{c}").alias(c) for c in others]))


def dedupe_keep_last(rows: DataFrame, key: str, seq: str | list[str], title_col: str = "title") -> DataFrame:
    """Within one ingest the last row per key wins; rows without a title are skipped."""
    usable = rows.filter(F.col(title_col).isNotNull())
    return dedupe_deterministic(usable, key, [seq] if isinstance(seq, str) else seq, keep="max")


def clean_postings(raw: DataFrame, apart: str | None = None) -> DataFrame:
    """dedupe → salary_clean → trimmed title → skill_count → drop NULL titles.  With ``apart``, a
    folder, only the rows of repeated ids are shuffled."""
    out = ((dedupe_apart(raw, apart) if apart else dedupe_postings(raw))
           .withColumn("salary_clean", clean_salary("salary"))
           .withColumn("title", F.trim("title")))
    if "required_skills" in raw.columns:
        out = out.withColumn("skill_count", skill_count("required_skills"))
    return out.filter(F.col("title").isNotNull())


def posting_skill_rows(cleaned: DataFrame) -> DataFrame:
    """Bridge rows (posting_id, skill) from the array column (NULL list → none)."""
    return cleaned.select("posting_id", F.explode("required_skills").alias("skill"))


def skill_demand(posting_skills: DataFrame) -> DataFrame:
    return (posting_skills.groupBy("skill").agg(F.count(F.lit(1)).alias("count"))
                          .orderBy(F.desc("count"), F.asc_nulls_last("skill")))


def batch_salary_by_seniority(cleaned: DataFrame) -> DataFrame:
    """One aggregate.  The median is the exact lower one: ``percentile_disc`` merges each task's
    counts per distinct salary, so what a group sends on grows with its distinct salaries."""
    return cleaned.groupBy("seniority").agg(
        F.round(F.avg("salary_clean")).alias("avg_salary"),
        F.expr("percentile_disc(0.5) within group (order by salary_clean)").cast("long").alias("median_salary"),
        F.count(F.lit(1)).alias("postings")).orderBy("seniority")


def batch_postings_by_month(cleaned: DataFrame) -> DataFrame:
    return cleaned.groupBy("posted_month").agg(F.count(F.lit(1)).alias("count")).orderBy("posted_month")


def batch_salary_by_region(cleaned: DataFrame) -> DataFrame:
    return (cleaned.groupBy("region")
            .agg(F.round(F.avg("salary_clean")).alias("avg_salary"), F.count(F.lit(1)).alias("postings"))
            .orderBy(F.desc("avg_salary"), F.asc_nulls_last("region")))


def etl_audit(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """raw / clean / removed counts as one row (two scalar subqueries over the plans)."""
    raw_n = raw.agg(F.count(F.lit(1))).scalar()
    clean_n = cleaned.agg(F.count(F.lit(1))).scalar()
    one = raw.sparkSession.range(1)
    return one.select(raw_n.alias("raw_rows"), clean_n.alias("clean_rows"),
                      (raw_n - clean_n).alias("removed_rows"))


def feed_quality(postings: DataFrame) -> DataFrame:
    """Of unique postings: how many carry a salary / skills, and floor percentages."""
    n = F.count(F.lit(1))
    with_salary = F.count_if(F.col("salary").isNotNull())
    with_skills = F.count_if(skill_count("required_skills") > 0)
    pct = lambda c: F.when(n > 0, F.floor(c * 100 / n)).otherwise(0)
    return postings.agg(n.alias("unique_postings"), with_salary.alias("with_salary"),
                        pct(with_salary).alias("salary_percent"),
                        with_skills.alias("with_skills"), pct(with_skills).alias("skills_percent"))


def mapreduce_skill_count(json_lines: DataFrame) -> DataFrame:
    """The map/shuffle/reduce formulation of the skill count over raw JSON lines:
    map each line to (skill, 1) per listed skill (bad JSON and NULL lists emit nothing),
    shuffle by skill and sum.  Must equal ``skill_demand``."""
    parsed = F.from_json(F.col("value"), "struct<required_skills: array<string>>")
    mapped = json_lines.select(F.explode(parsed["required_skills"]).alias("skill"), F.lit(1).alias("one"))
    return mapped.groupBy("skill").agg(F.sum("one").alias("count")).orderBy(F.desc("count"), F.asc_nulls_last("skill"))
