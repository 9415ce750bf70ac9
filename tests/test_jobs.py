"""Batch twins, idempotency, skew-safe ordinals, map-reduce equality, pipeline re-run."""
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from laborlake.operators import etl, tracking
from laborlake.session import shared_dir
from laborlake.sources import releases
from laborlake.streaming import jobs


def test_mapreduce_equals_dataframe_count(spark, small_dir):
    q = entry.queries()
    a = sorted(map(tuple, q["mapreduce_skill_count"](spark, small_dir).collect()))
    b = sorted(map(tuple, q["skill_demand"](spark, small_dir).collect()))
    assert a == b


def test_mapreduce_skips_bad_lines(spark):
    lines = spark.createDataFrame([('{"required_skills": ["A", "B"]}',), ("not json",),
                                   ('{"required_skills": null}',), ('{"required_skills": ["A"]}',)], "value string")
    got = {r.skill: r["count"] for r in etl.mapreduce_skill_count(lines).collect()}
    assert got == {"A": 2, "B": 1}


def test_ordinal_per_key_with_hot_key(spark):
    hot = spark.range(0, 3000).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    cold = spark.range(0, 300).select((F.col("id") % 30 + 2).alias("k"), F.col("id").alias("t"))
    df = hot.unionByName(cold)
    got = tracking.ordinal_per_key(df, "k", ["t"], n_parts=8)
    want = df.withColumn("ordinal", F.row_number().over(Window.partitionBy("k").orderBy("t")).cast("bigint"))
    assert sorted(map(tuple, got.select("k", "t", "ordinal").collect())) == \
        sorted(map(tuple, want.select("k", "t", "ordinal").collect()))


def test_status_merge_rules(spark):
    rows = [(1, "a", "interview_invite", 1), (1, "a", "applied", 2), (1, "a", "rejected", 3), (1, "a", "offer", 4),
            (2, "b", "applied", 1), (2, "b", "recruiter_outreach", 2)]
    df = spark.createDataFrame(rows, "user_id long, company string, status string, seq long") \
        .withColumn("occurred_at", F.timestamp_seconds("seq").cast("timestamp_ntz"))
    got = {r.company: r.status for r in
           tracking.status_merge(df, ["user_id", "company"], ["occurred_at", "seq"]).collect()}
    assert got == {"a": "rejected", "b": "applied"}


def test_once_stream_over_files(spark):
    """A pair is written once over all files; rows without a posting are repeats only by their own id."""
    src, sink = shared_dir(spark, f"in-{uuid.uuid4().hex}"), shared_dir(spark, f"once-{uuid.uuid4().hex}")
    schema = "notification_id long, user_id long, posting_id string"
    for rows in ([(1, 1, "p1"), (2, 1, "p1"), (3, 2, "p1"), (4, 4, None)],
                 [(1, 1, "p1"), (5, 3, "p2"), (4, 4, None), (6, 4, None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(src)
    jobs.run_once_stream(spark, stream, ["user_id", "posting_id"], "notification_id", sink)
    keys = sorted((r.user_id, r.posting_id or "") for r in spark.read.parquet(sink).collect())
    assert keys == [(1, "p1"), (2, "p1"), (3, "p2"), (4, ""), (4, "")]


def test_stream_twins(spark, small_dir):
    q = entry.queries()
    for stream, batch in (("stream_rate", "rate_violations"), ("stream_status_merge", "status_merge")):
        s = q[stream](spark, small_dir)
        b = q[batch](spark, small_dir).select(*s.columns)
        assert sorted(map(tuple, s.collect())) == sorted(map(tuple, b.collect()))


def test_stream_match_equals_batch_notifications(spark, small_dir):
    q = entry.queries()
    s = q["stream_match"](spark, small_dir)
    b = q["notification_text"](spark, small_dir).select(*s.columns)
    from laborlake.plans import catalog_io, catalog_matching
    from laborlake.sources.fixtures import Fixtures
    sp = catalog_io.stream_match_pairs(Fixtures(spark, small_dir))
    bp = catalog_matching.notification_pairs(Fixtures(spark, small_dir)).select(*sp.columns)
    assert sorted(map(tuple, sp.collect())) == sorted(map(tuple, bp.collect()))
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, b.collect()))


def test_pipeline_twice_same_output(spark, small_dir):
    from laborlake.plans.pipeline import PipelineConf, run
    from laborlake.sources.fixtures import feed_pages
    from laborlake.sources.tables import Tables
    t = Tables(spark, small_dir)
    outs = []
    for _ in range(2):
        base = shared_dir(spark, f"pipe-{uuid.uuid4().hex}")
        conf = PipelineConf(base=base, synthetic_ids=t.orders.select("o_orderkey"), pages=feed_pages(t),
                            terms=["ring"], only=("generate", "normalize", "publish", "etl", "load", "star", "dq"))
        rows = {r.step: r for r in run(spark, conf).collect()}
        assert rows["dq"].status == "ok" and rows["model"].status == "skipped"
        live = spark.read.json(f"{base}/landing/live")
        sent = spark.read.json(f"{base}/events")
        assert rows["publish"].rows == live.count() == sent.select("key").distinct().count() > 0
        fact = releases.read(spark, f"{base}/warehouse", "fact_job_posting")
        outs.append(sorted(map(tuple, fact.collect())))
    assert outs[0] == outs[1]


def test_failed_broker_does_not_stop_the_load(spark, small_dir, monkeypatch):
    from laborlake.plans.pipeline import PipelineConf, run
    from laborlake.sources.fixtures import feed_pages
    from laborlake.sources.tables import Tables
    from laborlake.streaming import events
    from pyspark.errors import PySparkException

    def broken(*args, **kwargs):
        raise PySparkException("no broker")
    monkeypatch.setattr(events, "publish", broken)
    conf = PipelineConf(base=shared_dir(spark, f"pipe-{uuid.uuid4().hex}"), pages=feed_pages(Tables(spark, small_dir)),
                        terms=["ring"], only=("normalize", "publish", "etl"))
    assert {r.step: r.status for r in run(spark, conf).collect() if r.status != "skipped"} == {
        "normalize": "ok", "publish": "failed", "etl": "ok"}


def test_profile_match_brute_force_with_hot_pair(spark):
    """A third of the postings share one skill pair; the pair-key / n-gram joins must
    equal the brute-force definition (overlap >= 2 or role substring of title)."""
    from laborlake.operators import matching
    postings, skills = [], []
    for i in range(90):
        pid = f"p{i}"
        postings.append((pid, ["Data Engineer", "Rod Welder", "ring master", "x"][i % 4], "Co", "R", None))
        sk = ["Python", "SQL"] if i % 3 == 0 else [["Java", "Scala", "Kafka"], ["SQL", "dbt"]][i % 2]
        skills += [(pid, s) for s in sk]
    profiles = [(1, "python, sql", ""), (2, "SQL, dbt ,kafka", "rod"), (3, "java,scala", "Ring, engineer"),
                (4, "", "data"), (5, "redis", "x")]
    P = spark.createDataFrame(postings, "posting_id string, title string, company_name string, region string, url string")
    S = spark.createDataFrame(skills, "posting_id string, skill string")
    U = spark.createDataFrame(profiles, "user_id long, skills string, target_roles string")
    got = {(r.user_id, r.posting_id): (list(r.overlap), r.role_match)
           for r in matching.profile_match(P, S, U).collect()}
    want = {}
    psk = {}
    for pid, s in skills:
        psk.setdefault(pid, set()).add(s.lower())
    for uid, sk, roles in profiles:
        if not sk:
            continue
        have = {s.strip().lower() for s in sk.split(",") if s.strip()}
        rl = [r.strip().lower() for r in roles.split(",") if r.strip()]
        for pid, title, *_ in postings:
            ov = sorted(have & psk.get(pid, set()))
            role = any(r in title.lower() for r in rl)
            if len(ov) >= 2 or role:
                want[(uid, pid)] = (ov, role)
    assert got == want


def test_status_merge_keeps_large_ids_apart(spark):
    """Equal rank and time: the smaller message id wins, also above 2^53."""
    rows = [(1, "recruiter_outreach", 2 ** 53 + 1), (1, "applied", 2 ** 53),
            (2, "applied", 2 ** 53 + 1), (2, "recruiter_outreach", 2 ** 53)]
    df = spark.createDataFrame(rows, "user_id long, status string, message_id long") \
        .withColumn("occurred_at", F.timestamp_seconds(F.lit(5)).cast("timestamp_ntz"))
    best = tracking.status_merge(df, ["user_id"], ["occurred_at", "message_id"]).collect()
    assert {r.user_id: r.status for r in best} == {1: "applied", 2: "recruiter_outreach"}


def test_split_is_stable_and_disjoint(spark):
    from laborlake.operators import model
    df = spark.range(0, 2000).select(F.col("id").cast("string").alias("posting_id"), F.lit(True).alias("is_real"))
    train, test, total = model.split_guard(df)
    again, _, _ = model.split_guard(df.repartition(7).orderBy(F.desc("posting_id")))
    ids = lambda d: sorted(r.posting_id for r in d.collect())
    assert ids(train) == ids(again) and total == 2000
    assert not set(ids(train)) & set(ids(test)) and len(ids(train)) + len(ids(test)) == 2000
    assert 0.75 < len(ids(train)) / 2000 < 0.85


def test_dedupe_keeps_the_same_row(spark):
    df = spark.createDataFrame([("a", 3, None), ("a", 1, "x"), ("b", 2, None), ("a", 1, "w"), (None, 1, "n")],
                               "posting_id string, n int, t string")
    want = {("a", 1, "w"), ("b", 2, None), (None, 1, "n")}
    assert {tuple(r) for r in etl.dedupe_postings(df).collect()} == want
    assert {tuple(r) for r in etl.dedupe_postings(df.repartition(5)).collect()} == want


def test_large_pages_are_allowed(spark, small_dir):
    from laborlake.operators import search
    from laborlake.sources.fixtures import Fixtures
    fx = Fixtures(spark, small_dir)
    spec = search.SearchSpec(limit=150)
    narrow = search.search_ranked(fx.fact, fx.bridge, fx.dim_skill, fx.dim_company, spec).collect()
    wide = search.search_ranked(fx.fact_wide, fx.bridge, fx.dim_skill, fx.dim_company, spec).collect()
    assert len(wide) == 150 and list(map(tuple, narrow)) == list(map(tuple, wide))


def _exchanged(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_dedupe_apart_keeps_the_same_rows(spark, tmp_path, monkeypatch):
    """Also of null ids; rows whose id stands once are not shuffled, and with many repeats all are."""
    from laborlake.operators import etl
    rows = [("a", "x", 1), ("a", "w", 2), ("b", "y", 3), (None, "n", 4), (None, "m", 5), ("c", None, 6), ("c", "z", 7), ("d", "q", 8), ("d", "q", 8)]
    raw = spark.createDataFrame(rows, "posting_id string, title string, n int")
    want = sorted(map(str, etl.dedupe_postings(raw).collect()))
    got = etl.dedupe_apart(raw, f"{tmp_path}/few")
    assert sorted(map(str, got.collect())) == want and len(want) == 5
    assert spark.read.parquet(f"{tmp_path}/few/rows").count() == 8
    monkeypatch.setattr(etl, "FEW_IDS", 1)
    assert sorted(map(str, etl.dedupe_apart(raw, f"{tmp_path}/many").collect())) == want
    assert not (tmp_path / "many" / "rows").exists()


def test_landed_lines_are_packed(spark, tmp_path, monkeypatch):
    """Packed JSON lines read back as they were, in files of bounded size."""
    from laborlake.sources import files
    monkeypatch.setattr(files, "LINES_PER_FILE", 40)
    df = spark.range(100).select(F.col("id").cast("string").alias("posting_id"), F.lit("Ring").alias("title"))
    files.write_jsonl(df.coalesce(1), f"{tmp_path}/lines")
    assert len(list((tmp_path / "lines").glob("part-*.json.gz"))) == 3
    assert files.read_jsonl(spark, f"{tmp_path}/lines").where("title = 'Ring'").select("posting_id").distinct().count() == 100


def test_generated_postings_are_made_by_all_tasks(spark):
    """Ids that lie in one file are dealt over the tasks, and each is made once."""
    from laborlake.plans.pipeline import PipelineConf, run
    from laborlake.sources import files
    base = shared_dir(spark, f"generate-{uuid.uuid4().hex}")
    run(spark, PipelineConf(base=base, synthetic_ids=spark.range(400).toDF("n").coalesce(1), only=("generate",)))
    lines = files.read_jsonl(spark, f"{base}/landing/generated")
    assert lines.count() == 400 and len(lines.inputFiles()) > 1


def test_buckets_grow_with_the_rows(spark, tmp_path, monkeypatch):
    """A bucket holds so many line items and orders at most, whatever the session's partitions."""
    from laborlake.sources import fixtures
    from laborlake.sources.tables import Tables
    spark.range(900).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(101).write.parquet(f"{tmp_path}/orders.parquet")
    t = Tables(spark, str(tmp_path))
    assert fixtures.posting_buckets(t) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(fixtures, "ROWS_PER_BUCKET", 50)
    assert fixtures.posting_buckets(t) == 21


def test_postings_stay_in_their_buckets(spark, small_dir):
    """Dedupe and cleaning read the postings by bucket: no row of them is shuffled."""
    from laborlake.operators import etl
    from laborlake.sources.fixtures import Fixtures
    fx = Fixtures(spark, small_dir)
    assert "hashpartitioning(posting_id" not in _exchanged(etl.clean_postings(fx.raw))


def test_feed_pages_read_their_own_feed(spark, small_dir):
    from laborlake.sources import fixtures
    fixtures._PAGES.clear()
    assert list(fixtures.landed_pages(spark, small_dir, ("arbeitnow",))) == ["arbeitnow"]
    assert [k[-1] for k in fixtures._PAGES] == ["arbeitnow"]
