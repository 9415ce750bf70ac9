"""The batch pipeline as one Spark application: generate → normalize → publish → etl →
model → load → star → dq, with an ``only`` subset and per-step timings.

Every step hands its output to the next through storage under ``base`` (a shared folder) and is
entered in a ledger with the fingerprint of what went into it: the rows of the run's own inputs,
its settings, and the fingerprints of the steps before.  A run that is started again on the same
base skips every step whose entry has the same fingerprint (status ``done``), so it goes on where
the last one ended; changed inputs run their step and all that follow from it.  Row counts are
observed while rows are written.  Curated tables, raw warehouse tables and the star are releases:
readers see a set when all of it is there, and the star only once it has passed its checks.
Publishing the live postings is a service to listeners: should the broker fail, the step reports
``failed`` and the load goes on; the next run tries again.
"""
from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from laborlake.operators import etl, model, quality
from laborlake.operators.star import Star, build_star, stage_postings
from laborlake.sources import feeds, files, releases
from laborlake.sources.synthetic import synth_postings
from laborlake.streaming import events

STEPS = ("generate", "normalize", "publish", "etl", "model", "load", "star", "dq")
#: The steps that each step reads the output of.
READS = {"generate": (), "normalize": (), "publish": ("normalize",), "etl": ("generate", "normalize"), "model": ("etl",),
         "load": ("etl", "model"), "star": ("load",), "dq": ("star",)}
STAR_TABLES = ("stg_postings", "dim_company", "dim_skill", "fact_job_posting", "bridge_posting_skill")
EMPTY_SCORES = "posting_id string, predicted_salary bigint, salary_vs_market bigint, pay_band string"


@dataclass
class PipelineConf:
    base: str                                   # shared folder for all step outputs
    synthetic_ids: DataFrame | None = None      # id source for generated postings
    pages: dict[str, DataFrame] | None = None   # landed feed pages
    terms: list[str] = field(default_factory=list)
    real_only: bool = True
    only: tuple[str, ...] = STEPS
    seed: int = 42
    bootstrap: str | None = None                # broker; without one events go to base/events


def warehouse(conf: PipelineConf) -> str:
    """Where the checked star is published."""
    return f"{conf.base.rstrip('/')}/warehouse"


def _posting_union(conf: PipelineConf) -> DataFrame:
    pg = conf.pages
    return feeds.feeds_union(feeds.adzuna_postings(pg["adzuna"]),
                             feeds.remotive_postings(pg["remotive"], conf.terms),
                             feeds.arbeitnow_postings(pg["arbeitnow"], conf.terms))


def _rows_of(frames: list[DataFrame]) -> str:
    """Fingerprint of the rows of some frames: counts and order-free hashes, an aggregate each."""
    parts = []
    for df in frames:
        h = F.xxhash64(F.to_json(F.struct(*df.columns)))
        parts.append(tuple(df.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.shiftright(h, 20))).first()))
    return json.dumps(parts)


def _observed(df: DataFrame, write: Callable[[DataFrame], None]) -> int:
    """Write ``df`` and count its rows in the same pass."""
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return seen.get["rows"]


class Ledger:
    """One small file per finished step: its fingerprint and row count."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base

    def rows_if_done(self, step: str, fingerprint: str) -> tuple[bool, int | None]:
        text = releases.read_small(self.spark, f"{self.base}/{step}")
        entry = json.loads(text) if text else {}
        return entry.get("fingerprint") == fingerprint, entry.get("rows")

    def enter(self, step: str, fingerprint: str, rows: int | None) -> None:
        self.spark._jvm.org.apache.hadoop.fs.Path(self.base).getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(
            self.spark._jvm.org.apache.hadoop.fs.Path(self.base))
        releases.write_small(self.spark, f"{self.base}/{step}", json.dumps({"fingerprint": fingerprint, "rows": rows}))


def run(spark: SparkSession, conf: PipelineConf) -> DataFrame:
    """Run the selected steps; returns (step, status, seconds, rows) per step.  Status is ok, done
    (finished by an earlier run with the same inputs), skipped, too_few_rows or failed."""
    b = conf.base.rstrip("/")
    landing, curated, raw, wh = f"{b}/landing", f"{b}/curated", f"{b}/raw", warehouse(conf)
    ledger, report, prints = Ledger(spark, f"{b}/ledger"), [], {}

    def fingerprint(name: str) -> str:
        own = {"generate": lambda: [_rows_of([conf.synthetic_ids]), conf.seed],
               "normalize": lambda: [_rows_of([conf.pages[k] for k in sorted(conf.pages)]), conf.terms],
               "publish": lambda: [conf.bootstrap], "model": lambda: [conf.real_only]}.get(name, list)()
        before = [prints[r] for r in READS[name] if r in prints]
        return hashlib.sha256(json.dumps([name, own, before]).encode()).hexdigest()

    def step(name: str, fn: Callable[[], int]) -> None:
        if name not in conf.only:
            report.append((name, "skipped", 0.0, None))
            return
        t0 = time.perf_counter()
        mark = fingerprint(name)
        done, rows = ledger.rows_if_done(name, mark)
        if done:
            status = "done"
        else:
            try:
                rows = fn()
                status = "ok"
                ledger.enter(name, mark, rows)
            except model.TooFewRows:
                rows, status = 0, "too_few_rows"
            except (PySparkException, Py4JError):
                if name != "publish":
                    raise
                rows, status = None, "failed"
        if status in ("ok", "done"):
            prints[name] = mark
        report.append((name, status, round(time.perf_counter() - t0, 3), rows))

    def generate() -> int:
        ids, cores = conf.synthetic_ids, spark.sparkContext.defaultParallelism
        if ids.rdd.getNumPartitions() < cores:   # an id makes a whole posting: a few files' ids are dealt over all cores
            ids = ids.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), cores))
        g = synth_postings(ids, ids.columns[0], seed=conf.seed)
        return _observed(g, lambda df: files.write_jsonl(df, f"{landing}/generated"))

    def normalize() -> int:
        u = feeds.unique_postings(_posting_union(conf))
        return _observed(u, lambda df: files.write_jsonl(df, f"{landing}/live"))

    def publish_live() -> int:
        live = files.read_jsonl(spark, f"{landing}/live")
        return events.publish(live, path=f"{b}/events", bootstrap=conf.bootstrap, mode="overwrite")

    def run_etl() -> int:
        n = _observed(etl.clean_postings(files.read_jsonl(spark, f"{landing}/*"), apart=f"{b}/repeated"), lambda df: files.write_parquet(df, f"{b}/cleaned"))
        cleaned = spark.read.parquet(f"{b}/cleaned")
        c, s = cleaned.drop("required_skills"), etl.posting_skill_rows(cleaned)
        releases.publish(spark, curated, {
            "postings": c, "posting_skills": s, "skill_demand": etl.skill_demand(s), "salary_by_seniority": etl.batch_salary_by_seniority(c),
            "postings_by_month": etl.batch_postings_by_month(c), "salary_by_region": etl.batch_salary_by_region(c)})
        return n

    def run_model() -> int:
        c = model.ml_features(releases.read(spark, curated, "postings"))
        train, test, _ = model.split_guard(c, real_only=conf.real_only)
        trained = model.trained_once(train, test, f"{b}/models")
        files.save_model(trained.gbt, f"{b}/model")
        files.save_metrics(trained.metrics, f"{b}/metrics")
        return _observed(model.score(trained.gbt, c), lambda df: files.write_parquet(df, f"{b}/posting_scores"))

    def load() -> int:
        tables = {n: releases.read(spark, curated, n) for n in files.CURATED_OUTPUTS}
        if "model" in prints:   # an unscored run has no scores: every band is 'unknown'
            tables["posting_scores"] = spark.read.parquet(f"{b}/posting_scores")
        releases.publish(spark, raw, {f"raw_{n}": files.warehouse_ready(df, files.WAREHOUSE_TYPES.get(n)) for n, df in tables.items()})
        return releases.read(spark, raw, "raw_postings").count()

    def star() -> int:
        """Built and checked in one go: a star that fails is written but never seen."""
        scores = (releases.read(spark, raw, "raw_posting_scores") if "model" in prints else spark.createDataFrame([], EMPTY_SCORES))
        s = build_star(stage_postings(releases.read(spark, raw, "raw_postings")), releases.read(spark, raw, "raw_posting_skills"), scores)
        releases.publish(spark, wh, dict(zip(STAR_TABLES, (s.stg, s.dim_company, s.dim_skill, s.fact, s.bridge))),
                         lambda written: quality.quarantine(_star_of(written), f"{b}/quarantine"))
        return releases.read(spark, wh, "fact_job_posting").count()

    def dq() -> int:
        summary = quality.gate_summary(_star_of({n: releases.read(spark, wh, n) for n in STAR_TABLES}))
        return _observed(summary, lambda df: files.write_parquet(df, f"{b}/dq"))

    for name, fn in zip(STEPS, (generate, normalize, publish_live, run_etl, run_model, load, star, dq)):
        step(name, fn)
    return spark.createDataFrame(report, "step string, status string, seconds double, rows long")


def _star_of(t: dict[str, DataFrame]) -> Star:
    return Star(stg=t["stg_postings"], dim_company=t["dim_company"], dim_skill=t["dim_skill"], fact=t["fact_job_posting"],
                bridge=t["bridge_posting_skill"], fact_wide=t["fact_job_posting"])
