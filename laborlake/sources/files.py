"""Sources and sinks: JSON-lines landing zone, curated Parquet, warehouse tables, profile
reader, model and metrics artefacts.  All writes are distributed (one file per task);
nothing is funnelled through the driver."""
from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laborlake.sources import releases

log = logging.getLogger(__name__)

# Landing schema: the union of the live-feed and generated shapes; salary is read as text
# because it arrives as int, float, "$123,456/yr" or null in the same field.
POSTING_RAW_SCHEMA = T.StructType([
    T.StructField("posting_id", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("company", T.StringType()), T.StructField("location", T.StringType()),
    T.StructField("region", T.StringType()), T.StructField("seniority", T.StringType()),
    T.StructField("remote", T.BooleanType()), T.StructField("salary", T.StringType()),
    T.StructField("salary_currency_original", T.StringType()),
    T.StructField("required_skills", T.ArrayType(T.StringType())),
    T.StructField("description", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("is_real", T.BooleanType()), T.StructField("url", T.StringType()),
    T.StructField("posted_month", T.IntegerType()),
])

#: The loader's type overrides by curated table.
WAREHOUSE_TYPES = {
    "postings": {"salary_clean": "bigint", "posted_month": "int"},
    "salary_by_seniority": {"avg_salary": "bigint", "median_salary": "bigint"},
    "salary_by_region": {"avg_salary": "bigint"},
    "posting_scores": {"predicted_salary": "bigint", "salary_vs_market": "bigint"},
}

CURATED_OUTPUTS = ("postings", "posting_skills", "skill_demand", "salary_by_seniority",
                   "postings_by_month", "salary_by_region")
CURATED_TABLES = (*CURATED_OUTPUTS, "posting_scores")


#: Rows of a packed JSON file.
LINES_PER_FILE = 250_000


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = POSTING_RAW_SCHEMA) -> DataFrame:
    """Every JSON line under ``path`` (file, dir or glob) with an explicit schema; fields
    missing from a line are NULL and an unparseable line becomes an all-NULL row (the
    ETL's title filter drops it)."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Packed lines.  Packed files are read whole, by a task each, so none holds too many."""
    df.write.mode("overwrite").option("compression", "gzip").option("maxRecordsPerFile", LINES_PER_FILE).json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A job-output directory (part files only; marker files are ignored)."""
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_curated(outputs: dict[str, DataFrame], base: str) -> None:
    """Overwrite each curated directory ``{base}/{name}``."""
    for name, df in outputs.items():
        write_parquet(df, f"{base}/{name}")


def publish_curated(spark: SparkSession, outputs: dict[str, DataFrame], base: str) -> DataFrame:
    """All curated outputs as one release, and their (table, rows) read back from it."""
    missing = set(CURATED_TABLES) - set(outputs)
    if missing:
        raise ValueError(f"curated outputs missing: {', '.join(sorted(missing))}")
    releases.publish(spark, base, {name: outputs[name] for name in CURATED_TABLES})
    return releases.counts(spark, base, list(CURATED_TABLES))


def publish_warehouse(spark: SparkSession, curated: str, base: str) -> None:
    """Full refresh of the warehouse's raw tables from the current curated release: typed by
    the loader's rules, seen by readers all at once.  A count that differs from the curated
    table's stops the refresh."""
    tables = {f"raw_{name}": warehouse_ready(releases.read(spark, curated, name), WAREHOUSE_TYPES.get(name)) for name in CURATED_TABLES}

    def whole(written: dict[str, DataFrame]) -> None:
        want = {r["table"]: r["rows"] for r in releases.counts(spark, curated, list(CURATED_TABLES)).collect()}
        for name, df in written.items():
            n = df.count()
            if n != want[name.removeprefix("raw_")]:
                raise RuntimeError(f"{name}: {n} rows written, {want[name.removeprefix('raw_')]} expected")

    releases.publish(spark, base, tables, whole)


def warehouse_ready(df: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """Loader typing rules: empty strings load as NULL, explicit type overrides, and
    floating columns listed in ``overrides`` as ``bigint`` are rounded first."""
    overrides = overrides or {}
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            c = F.when(c != "", c)
        if f.name in overrides:
            t = overrides[f.name]
            if t in ("bigint", "long", "int") and isinstance(f.dataType, (T.DoubleType, T.FloatType)):
                c = F.round(c)
            c = c.cast(t)
        out.append(c.alias(f.name))
    return df.select(*out)


def write_warehouse(df: DataFrame, table: str, path: str, overrides: dict[str, str] | None = None) -> DataFrame:
    """Full refresh of a warehouse table (external table at ``path``)."""
    ready = warehouse_ready(df, overrides)
    ready.write.mode("overwrite").option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


PROFILE_COLUMNS = ("user_id", "skills", "target_roles", "headline", "countries")


def read_profiles(spark: SparkSession, jdbc_url: str | None = None, table: str | None = None,
                  path: str | None = None, properties: dict | None = None,
                  columns: tuple[str, ...] = PROFILE_COLUMNS) -> DataFrame:
    """Profiles with only the needed columns.  JDBC when a URL is given (the column list
    is pushed into the query), else a catalog table or a Parquet path.  A failure is raised:
    a match batch must not commit its events against profiles it could not read.  Only the
    ingest, which has default terms, may go on without them (``profiles_or_none``)."""
    if jdbc_url:
        q = f"(select {', '.join(columns)} from {table or 'user_profiles'}) p"
        return spark.read.jdbc(jdbc_url, q, properties=properties or {})
    src = spark.table(table) if table else spark.read.parquet(path)
    have = set(src.columns)
    return src.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns])


def profiles_or_none(spark: SparkSession, **where) -> DataFrame:
    """The profiles, or an empty frame where they cannot be read (the ingest's default terms apply)."""
    try:
        return read_profiles(spark, **where)
    except Exception as exc:  # noqa: BLE001  — a profile outage must not stop the ingest
        log.warning("could not read profiles (%s) — using defaults", type(exc).__name__)
        columns = where.get("columns", PROFILE_COLUMNS)
        return spark.createDataFrame([], ", ".join(f"{c} {'bigint' if c == 'user_id' else 'string'}" for c in columns))


def parquet_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None where there is none; any other failure is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def save_metrics(metrics: DataFrame, path: str) -> None:
    """Metrics are a handful of rows: one JSON file."""
    metrics.coalesce(1).write.mode("overwrite").json(path)
