"""Releases, the quality gate before them, the pipeline's ledger, the model store, winners by code."""
import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from laborlake.operators import etl, model, quality
from laborlake.operators.star import Star, build_star, stage_postings
from laborlake.session import shared_dir
from laborlake.sources import files, releases


def folder(spark, name):
    return shared_dir(spark, f"{name}-{uuid.uuid4().hex}")


def test_readers_see_whole_releases_only(spark):
    base = folder(spark, "rel")
    assert releases.current(spark, base) is None
    with pytest.raises(FileNotFoundError):
        releases.read(spark, base, "a")
    one = releases.publish(spark, base, {"a": spark.range(3), "b": spark.range(5)})
    assert releases.current(spark, base) == one

    def refuse(written):
        assert written["a"].count() == 7 and releases.read(spark, base, "a").count() == 3  # not seen yet
        raise ValueError("no")
    with pytest.raises(ValueError):
        releases.publish(spark, base, {"a": spark.range(7), "b": spark.range(7)}, refuse)
    with pytest.raises(Exception):  # fails while its second table is written
        releases.publish(spark, base, {"a": spark.range(9), "b": spark.range(9).select(F.raise_error(F.lit("lost")))})
    assert {r["table"]: r["rows"] for r in releases.counts(spark, base, ["a", "b"]).collect()} == {"a": 3, "b": 5}
    releases.publish(spark, base, {"a": spark.range(1), "b": spark.range(2)})
    assert releases.read(spark, base, "b").count() == 2


def test_curated_release_wants_all_tables(spark):
    with pytest.raises(ValueError, match="posting_scores"):
        files.publish_curated(spark, {n: spark.range(1) for n in files.CURATED_OUTPUTS}, folder(spark, "cur"))


RAW = "posting_id string, title string, company string, location string, region string, seniority string, remote boolean, " \
      "salary string, posted_month int, is_real boolean"


def small_star(spark, rows):
    stg = stage_postings(etl.clean_postings(spark.createDataFrame(rows, RAW)))
    skills = spark.createDataFrame([(r[0], s) for r in rows for s in ("SQL", "dbt")], "posting_id string, skill string")
    scores = spark.createDataFrame([], "posting_id string, predicted_salary bigint, salary_vs_market bigint, pay_band string")
    return build_star(stg, skills, scores)


ROWS = [("p1", " Engineer ", "Co", "X", "EU", "senior", True, "$90,000/yr", 3, True), ("p1", " Engineer ", "Co", "X", "EU", "senior", True, "$90,000/yr", 3, True),
        ("p1", "Later title", "Co", "X", "EU", "senior", True, "1", 3, True), ("p2", "Analyst", None, "Y", "US", "junior", False, None, None, False),
        ("p3", None, "Co", "X", "EU", "mid", True, "5", 1, True)]


def test_raw_to_star_with_repeated_ids(spark):
    star = small_star(spark, ROWS)
    assert sorted((r.posting_id, r.title, r.salary) for r in star.fact.collect()) == [("p1", "Engineer", 90000), ("p2", "Analyst", None)]
    assert star.bridge.count() == 4 and quality.quarantine(star, folder(spark, "q")).count() == 0
    assert all(r["failures"] == 0 for r in quality.enforce(quality.gate_summary(star)))


def test_gate_raises_and_keeps_the_offending_rows(spark):
    good = small_star(spark, ROWS)
    twice = good.stg.unionByName(good.stg.where("posting_id = 'p2'").withColumn("seniority", F.lit("guru")))
    fact = good.fact.withColumn("company_id", F.when(F.col("posting_id") == "p1", "nobody")).withColumn("salary", F.lit(3_000_000).cast("bigint"))
    bad = Star(stg=twice, dim_company=good.dim_company, dim_skill=good.dim_skill, fact=fact, bridge=good.bridge, fact_wide=fact)
    path = folder(spark, "q")
    with pytest.raises(quality.DataQualityError, match="accepted_values:stg_postings.seniority=1"):
        quality.quarantine(bad, path)
    rows = sorted((r["check"], r.severity, r.row_key, r.value) for r in spark.read.parquet(path).collect())
    assert rows == [("accepted_range:fact_job_posting.salary", "warn", "p1", "3000000"), ("accepted_range:fact_job_posting.salary", "warn", "p2", "3000000"),
                    ("accepted_values:stg_postings.seniority", "error", "p2", "guru"), ("relationships:fact_job_posting.company_id", "error", "p1", "nobody"),
                    ("unique:stg_postings.posting_id", "error", "p2", "p2"), ("unique:stg_postings.posting_id", "error", "p2", "p2")]
    assert '"guru"' in spark.read.parquet(path).where("value = 'guru'").first()["row"]
    with pytest.raises(quality.DataQualityError, match="relationships:fact_job_posting.company_id=1"):
        quality.enforce(quality.gate_summary(bad))
    warned = Star(stg=good.stg, dim_company=good.dim_company, dim_skill=good.dim_skill, bridge=good.bridge,
                  fact=good.fact.withColumn("salary", F.lit(-5).cast("bigint")), fact_wide=good.fact)
    assert quality.quarantine(warned, folder(spark, "q")).count() == 2      # warnings do not stop the gate


def test_pipeline_goes_on_where_it_ended(spark, small_dir, monkeypatch):
    from laborlake.plans import pipeline
    from laborlake.sources.fixtures import feed_pages
    from laborlake.sources.tables import Tables
    t = Tables(spark, small_dir)
    base = folder(spark, "pipe")

    def run(**kw):
        args = {"terms": ["ring"], "only": ("generate", "normalize", "publish", "etl", "load", "star", "dq"), **kw}
        conf = pipeline.PipelineConf(base=base, synthetic_ids=t.orders.select("o_orderkey"), pages=feed_pages(t), **args)
        return {r.step: (r.status, r.rows) for r in pipeline.run(spark, conf).collect()}

    build = pipeline.build_star

    def broken(*args):
        raise RuntimeError("lost")
    monkeypatch.setattr(pipeline, "build_star", broken)
    with pytest.raises(RuntimeError):
        run()
    monkeypatch.setattr(pipeline, "build_star", build)
    second = run()
    assert [second[s][0] for s in ("generate", "normalize", "publish", "etl", "load")] == ["done"] * 5
    assert second["star"][0] == second["dq"][0] == "ok"
    third = run()
    assert all(third[s] == ("done", second[s][1]) for s in ("generate", "normalize", "publish", "etl", "load", "star", "dq"))
    fourth = run(terms=["rod"])                                              # what it asks for changed: that step and all behind it
    assert fourth["generate"][0] == "done" and {fourth[s][0] for s in ("normalize", "publish", "etl", "load", "star", "dq")} == {"ok"}


def test_metrics_equal_the_evaluators_and_models_are_trained_once(spark, monkeypatch):
    from pyspark.ml.evaluation import RegressionEvaluator
    rng = random.Random(5)
    rows = [(f"p{i}", rng.choice(["senior", "mid", "junior"]), rng.choice(["EU", "US"]), i % 2, rng.randint(1, 9),
             rng.randint(40_000, 200_000), True) for i in range(900)]
    df = spark.createDataFrame(rows, "posting_id string, seniority string, region string, remote_int int, skill_count int, salary_clean bigint, is_real boolean")
    monkeypatch.setattr(model, "GBT_ITERATIONS", 3)
    train, test, _ = model.split_guard(df)
    calls, train_eval = [], model.train_eval
    monkeypatch.setattr(model, "train_eval", lambda *a: calls.append(1) or train_eval(*a))
    base = folder(spark, "models")
    first = model.trained_once(train, test, base)
    again = model.trained_once(train.repartition(3), test, base)
    assert len(calls) == 1 and sorted(map(str, first.metrics.collect())) == sorted(map(str, again.metrics.collect()))
    by_name = {r["model"]: r for r in first.metrics.collect()}
    for name, fitted in ((model.LINEAR_NAME, again.linear), (model.GBT_NAME, again.gbt)):
        scored = fitted.transform(test)
        ev = RegressionEvaluator(labelCol=model.LABEL, predictionCol="prediction")
        for metric, digits in (("rmse", 0), ("mae", 0), ("r2", 4)):
            assert by_name[name][metric] == pytest.approx(round(ev.setMetricName(metric).evaluate(scored), digits))
    model.trained_once(train.where(F.col("posting_id") != train.first()["posting_id"]), test, base)
    assert len(calls) == 2
    with pytest.raises(model.TooFewRows):
        model.split_guard(df.limit(20))


@pytest.mark.parametrize("kind", ["bigint", "double", "string", "date", "timestamp", "timestamp_ntz", "boolean", "array<int>"])
def test_first_rows_equal_the_smallest_struct(spark, kind):
    rng = random.Random(kind)
    make = {"bigint": lambda: rng.choice([-2 ** 63, 2 ** 63 - 1, 0, 5]), "double": lambda: rng.choice([-1e300, 1e300, 0.25, 0.5, float("nan"), -0.75]),
            "string": lambda: rng.choice(["", "a", "abcdefgh", "abcdefgi", "é", "Z"]), "date": lambda: dt.date(2020, 1, rng.randint(1, 3)),
            "timestamp": lambda: dt.datetime(2020, 1, 1, rng.randint(0, 2)), "timestamp_ntz": lambda: dt.datetime(2020, 1, 1, rng.randint(0, 2)),
            "boolean": lambda: rng.random() < 0.5, "array<int>": lambda: [rng.randint(0, 2)]}[kind]
    rows = [(rng.choice(["k", "", None, "x"]), rng.choice([1, None, 0]), None if rng.random() < 0.1 else make(), rng.randint(0, 4)) for _ in range(200)]
    df = spark.createDataFrame(rows, f"a string, b int, v {kind}, w int").repartition(4)
    got = etl.first_rows(df, ["a", "b"], ["v", "w"])
    want = df.groupBy("a", "b").agg(F.min(F.struct("v", "w")).alias("m")).select("a", "b", "m.v", "m.w")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 12


def test_dedupe_plan_hashes(spark):
    df = spark.createDataFrame([("a", "x", 1)], "posting_id string, t string, n int")
    plan = etl.dedupe_postings(df)._jdf.queryExecution().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_equal_features_are_trained_on_together(spark, monkeypatch):
    """The same line and trees from the sums as from the rows, for every combination that was trained on."""
    rows = [(f"p{i}", ("junior", "mid", "senior")[i % 3], ("north", "south", None)[i * 7 % 11 % 3], i % 2 == 0, i % 2, i * 5 % 4,
             50_000 + 9_000 * (i % 3) + 700 * (i * 5 % 4) + i * 31 % 997) for i in range(600)]
    df = spark.createDataFrame(rows, "posting_id string, seniority string, region string, remote boolean, remote_int int, skill_count int, salary_clean long")
    monkeypatch.setattr(model, "GBT_ITERATIONS", 3)
    sums = model.weighted(df)
    assert sums.agg(F.sum("weight")).first()[0] == 600
    assert round(sums.agg(F.sum(F.col("weight") * F.col("salary_clean"))).first()[0]) == sum(r[-1] for r in rows)
    by_rows = model.train_eval(df, df)
    calls, weighted = [], model.weighted
    monkeypatch.setattr(model, "weighted", lambda t: calls.append(1) or weighted(t))
    monkeypatch.setattr(model, "ROW_BY_ROW", 10)
    by_sums = model.train_eval(df, df)
    assert calls == [1]
    for a, b in ((by_rows.linear, by_sums.linear), (by_rows.gbt, by_sums.gbt)):
        got = [{r["posting_id"]: r["prediction"] for r in m.transform(df).select("posting_id", "prediction").collect()} for m in (a, b)]
        assert max(abs(got[0][k] - got[1][k]) for k in got[0]) < 0.05, type(a.stages[-1])  # of about 60,000
