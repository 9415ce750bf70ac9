"""The warehouse data-quality checks and the gate.

A check's failure count follows the usual test-returns-offending-rows convention:
* not_null            rows where the column is NULL
* unique              distinct non-NULL values that occur more than once
* accepted_values     distinct non-NULL values outside the accepted set
* relationships       child rows with a non-NULL key that has no parent
* accepted_range      rows with a non-NULL value outside [min, max]   (severity warn)

Checks on the same table share one aggregate pass (``count_if`` per column, unpivoted to
rows); uniqueness is a grouped count; relationships are left-anti joins.  The summary is
at most 17 rows, so the gate may bring it to the driver.

``offending_rows`` gives the rows behind the counts: each table is read once for its row-level
checks and emits a failing row with every check that it fails.  ``quarantine`` writes them,
raises if a check of severity error has one, and only then lets the tables
be seen (``sources.releases``).
"""
from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laborlake.operators.star import Star
from laborlake.session import shared_dir

# --- fixed values (must equal the reference for identical results) -------------------
ACCEPTED_SENIORITY = ("junior", "mid", "senior", "unknown")
SALARY_RANGE = (0, 2000000)
# ---------------------------------------------------------------------------------------

KINDS = ("not_null", "unique", "accepted_values", "relationships", "accepted_range")
SUMMARY_SCHEMA = "check string, kind string, severity string, failures bigint"


class DataQualityError(RuntimeError):
    pass


@dataclass(frozen=True)
class Check:
    kind: str
    model: str
    column: str
    severity: str = "error"

    @property
    def name(self) -> str:
        return f"{self.kind}:{self.model}.{self.column}"


def _rows(df: DataFrame, checks: list[Check], exprs: list) -> DataFrame:
    """One aggregate pass computing ``exprs`` (one per check), unpivoted to rows."""
    agg = df.agg(*[e.cast("bigint").alias(f"c{i}") for i, e in enumerate(exprs)])
    stack = ", ".join(f"'{c.name}', '{c.kind}', '{c.severity}', c{i}" for i, c in enumerate(checks))
    return agg.selectExpr(f"stack({len(checks)}, {stack}) as (check, kind, severity, failures)")


def not_null_checks(star: Star) -> list[DataFrame]:
    spec = [("stg_postings", star.stg, ["posting_id", "title"]),
            ("dim_company", star.dim_company, ["company_id", "company_name"]),
            ("dim_skill", star.dim_skill, ["skill_id", "skill_name"]),
            ("fact_job_posting", star.fact, ["posting_id"])]
    out = []
    for model, df, cols in spec:
        checks = [Check("not_null", model, c) for c in cols]
        out.append(_rows(df, checks, [F.count_if(F.col(c).isNull()) for c in cols]))
    return out


def _unique(df: DataFrame, model: str, col: str) -> DataFrame:
    dupes = (df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
               .filter(F.col("n") > 1))
    return _rows(dupes, [Check("unique", model, col)], [F.count(F.lit(1))])


def unique_checks(star: Star) -> list[DataFrame]:
    return [_unique(star.stg, "stg_postings", "posting_id"),
            _unique(star.dim_company, "dim_company", "company_id"),
            _unique(star.dim_skill, "dim_skill", "skill_id"),
            _unique(star.dim_skill, "dim_skill", "skill_name"),
            _unique(star.fact, "fact_job_posting", "posting_id")]


def accepted_values_checks(star: Star) -> list[DataFrame]:
    bad = F.when(~F.col("seniority").isin(*ACCEPTED_SENIORITY), F.col("seniority"))
    return [_rows(star.stg, [Check("accepted_values", "stg_postings", "seniority")],
                  [F.count_distinct(bad)])]


def _orphans(child: DataFrame, model: str, col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    keys = child.select(F.col(col).alias("__k")).filter(F.col("__k").isNotNull())
    parents = parent.select(F.col(parent_col).alias("__k"))
    missing = keys.join(parents, "__k", "left_anti")
    return _rows(missing, [Check("relationships", model, col)], [F.count(F.lit(1))])


def relationship_checks(star: Star) -> list[DataFrame]:
    return [_orphans(star.fact, "fact_job_posting", "company_id", star.dim_company, "company_id"),
            _orphans(star.bridge, "bridge_posting_skill", "posting_id", star.fact, "posting_id"),
            _orphans(star.bridge, "bridge_posting_skill", "skill_id", star.dim_skill, "skill_id")]


def accepted_range_checks(star: Star) -> list[DataFrame]:
    lo, hi = SALARY_RANGE
    s = F.col("salary")
    return [_rows(star.fact, [Check("accepted_range", "fact_job_posting", "salary", "warn")],
                  [F.count_if(s.isNotNull() & ((s < lo) | (s > hi)))])]


_BUILDERS = {"not_null": not_null_checks, "unique": unique_checks,
             "accepted_values": accepted_values_checks, "relationships": relationship_checks,
             "accepted_range": accepted_range_checks}


def run_checks(star: Star, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Summary rows (check, kind, severity, failures) for the requested kinds."""
    parts = [df for k in kinds for df in _BUILDERS[k](star)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def gate_summary(star: Star) -> DataFrame:
    """All 17 checks with a status: pass / warn / fail."""
    return run_checks(star).withColumn(
        "status", F.when(F.col("failures") == 0, "pass")
                   .when(F.col("severity") == "warn", "warn").otherwise("fail"))


def _failing(df: DataFrame, model: str, key: list[str], tests: list[tuple[Check, Column]]) -> DataFrame:
    """(check, severity, model, row_key, value, row): one pass over ``df``."""
    found = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(c.name).alias("check"), F.lit(c.severity).alias("severity"),
                                                           F.col(c.column).cast("string").alias("value"))) for c, bad in tests]))
    return (df.withColumn("__f", F.explode(found)).select(
        "__f.check", "__f.severity", F.lit(model).alias("model"), _row_key(key), "__f.value",
        F.to_json(F.struct(*df.columns)).alias("row")))


def _row_key(key: list[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]).alias("row_key")


def _few(keys: DataFrame) -> DataFrame:
    """The failing keys as a table: their real size decides how the wide rows meet them, and where
    there are few or none, as in a good star, the wide rows stay where they are."""
    path = shared_dir(keys.sparkSession, f"failing-{uuid.uuid4().hex}")
    keys.write.parquet(path)
    return keys.sparkSession.read.schema(keys.schema).parquet(path)


def _repeats(df: DataFrame, model: str, key: list[str], column: str) -> DataFrame:
    """Every row whose non-null value stands in another row as well."""
    twice = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(column)
    return _failing(df.join(_few(twice), column, "left_semi"), model, key, [(Check("unique", model, column), F.lit(True))])


def _without_parent(df: DataFrame, model: str, key: list[str], column: str, parent: DataFrame) -> DataFrame:
    lost = df.where(F.col(column).isNotNull()).select(column).distinct().join(parent.select(column), column, "left_anti")
    return _failing(df.join(_few(lost), column, "left_semi"), model, key, [(Check("relationships", model, column), F.lit(True))])


def offending_rows(star: Star) -> DataFrame:
    """The quarantine table: (check, severity, model, row_key, value, row as JSON)."""
    low, high = SALARY_RANGE

    def missing(model: str, *columns: str) -> list[tuple[Check, Column]]:
        return [(Check("not_null", model, c), F.col(c).isNull()) for c in columns]

    stg, fact = "stg_postings", "fact_job_posting"
    parts = [
        _failing(star.stg, stg, ["posting_id"], [*missing(stg, "posting_id", "title"), (
            Check("accepted_values", stg, "seniority"), ~F.coalesce(F.col("seniority").isin(*ACCEPTED_SENIORITY), F.lit(True)))]),
        _failing(star.dim_company, "dim_company", ["company_id"], missing("dim_company", "company_id", "company_name")),
        _failing(star.dim_skill, "dim_skill", ["skill_id"], missing("dim_skill", "skill_id", "skill_name")),
        _failing(star.fact, fact, ["posting_id"], [*missing(fact, "posting_id"), (
            Check("accepted_range", fact, "salary", "warn"), F.coalesce((F.col("salary") < low) | (F.col("salary") > high), F.lit(False)))]),
        _repeats(star.stg, stg, ["posting_id"], "posting_id"), _repeats(star.dim_company, "dim_company", ["company_id"], "company_id"),
        _repeats(star.dim_skill, "dim_skill", ["skill_id"], "skill_id"), _repeats(star.dim_skill, "dim_skill", ["skill_id"], "skill_name"),
        _repeats(star.fact, fact, ["posting_id"], "posting_id"),
        _without_parent(star.fact, fact, ["posting_id"], "company_id", star.dim_company),
        _without_parent(star.bridge, "bridge_posting_skill", ["posting_id", "skill_id"], "posting_id", star.fact),
        _without_parent(star.bridge, "bridge_posting_skill", ["posting_id", "skill_id"], "skill_id", star.dim_skill),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def quarantine(star: Star, path: str) -> DataFrame:
    """Write the offending rows below ``path`` and raise if one failed a check of severity error.
    Returns them read back; warnings do not stop the gate."""
    offending_rows(star).write.mode("overwrite").parquet(path)
    rows = star.stg.sparkSession.read.parquet(path)
    failed = rows.where("severity = 'error'").groupBy("check").agg(F.count(F.lit(1)).alias("n")).orderBy("check").collect()
    if failed:   # at most one row per check
        names = ", ".join(f"{r['check']}={r['n']}" for r in failed)
        raise DataQualityError(f"{len(failed)} data-quality check(s) failed: {names}; rows in {path}")
    return rows


def enforce(summary: DataFrame) -> list[dict]:
    """Raise if any error-severity check failed; warnings are only reported.
    The summary is bounded (one row per check), so collecting it is safe."""
    rows = [r.asDict() for r in summary.collect()]
    failed = [r for r in rows if r["failures"] and r["severity"] == "error"]
    if failed:
        names = ", ".join(f"{r['check']}={r['failures']}" for r in failed)
        raise DataQualityError(f"{len(failed)} data-quality check(s) failed: {names}")
    return rows
