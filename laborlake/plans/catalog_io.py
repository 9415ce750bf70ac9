"""Query catalog, part 5: model, streaming, sources / sinks, mail helpers, pipeline run.

Jobs with side effects (streams, sinks) write under a fresh folder of the shared
checkpoint location and return what they wrote, read back as a batch frame.
"""
from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlake.functions import messages
from laborlake.functions.lists import skill_count
from laborlake.operators import etl, model
from laborlake.plans.catalog_tracking import COMPANY_MERGE_SQL, classified_messages
from laborlake.plans.registry import register
from laborlake.session import shared_dir
from laborlake.sources import files, releases
from laborlake.sources.fixtures import Fixtures, landed_pages
from laborlake.streaming import events, jobs
from laborlake.streaming.profile_index import ProfileIndex


def _scratch(fx: Fixtures, name: str) -> str:
    return shared_dir(fx.spark, f"{name}-{uuid.uuid4().hex}")


def _cleaned_with_skills(fx: Fixtures) -> DataFrame:
    from laborlake.plans.catalog import cleaned_postings
    arr = fx.posting_skill.groupBy("posting_id").agg(F.collect_list("skill").alias("required_skills"))
    return cleaned_postings(fx).join(arr, "posting_id", "left").withColumn("skill_count", skill_count("required_skills"))


# ---------------------------------------------------------------- model
_MODEL_INPUT: dict[tuple[str, str], DataFrame] = {}


def _model_input(fx: Fixtures) -> DataFrame:
    """The model's rows, written once per session: split, fit and score pass over them many times."""
    key = (fx.spark.sparkContext.applicationId, os.path.abspath(fx.sf_dir))
    if key not in _MODEL_INPUT:
        rows = model.ml_features(_cleaned_with_skills(fx)).select(
            "posting_id", "seniority", "region", "remote", "remote_int", "skill_count", model.LABEL, "is_real")
        path = _scratch(fx, "model-input")
        rows.write.parquet(path)
        _MODEL_INPUT[key] = fx.spark.read.schema(rows.schema).parquet(path)
    return _MODEL_INPUT[key]


def _trained(fx: Fixtures) -> tuple[model.Trained, DataFrame]:
    """(the models of these postings, trained once for all queries, their input)."""
    df = _model_input(fx)
    train, test, _ = model.split_guard(df, real_only=True)
    return model.trained_once(train, test, shared_dir(fx.spark, "models")), df


@register("ml_features", """
with m as (select c.*, coalesce(s.n, 0) skill_count from fx_clean c
           left join (select posting_id, count(*) n from fx_posting_skill group by 1) s on s.posting_id = c.posting_id
           where c.salary_clean is not null),
si as (select seniority, row_number() over (order by count(*) desc, seniority) - 1 i from m where seniority is not null group by seniority),
ri as (select region, row_number() over (order by count(*) desc, region) - 1 i from m where region is not null group by region)
select m.posting_id, cast(coalesce(si.i, (select count(*) from si)) as double) seniority_idx,
       cast(coalesce(ri.i, (select count(*) from ri)) as double) region_idx,
       cast(cast(m.remote as integer) as double) remote_int, cast(m.skill_count as double) skill_count
from m left join si on si.seniority = m.seniority left join ri on ri.region = m.region where m.remote is not null""")
def q_ml_features(fx: Fixtures) -> DataFrame:
    return model.features_table(_model_input(fx))


@register("ml_split_guard", f"""
select count(*) filter (where substr(md5(posting_id), 1, 8) < '{model.TRAIN_BELOW}') train_rows,
       count(*) filter (where substr(md5(posting_id), 1, 8) >= '{model.TRAIN_BELOW}') test_rows, count(*) eligible_rows
from fx_clean where salary_clean is not null and is_real""")
def q_ml_split_guard(fx: Fixtures) -> DataFrame:
    train, test, total = model.split_guard(_model_input(fx), real_only=True)
    return train.agg(F.count(F.lit(1)).alias("train_rows")).select(
        "train_rows", test.agg(F.count(F.lit(1))).scalar().alias("test_rows"), F.lit(total).cast("bigint").alias("eligible_rows"))


@register("ml_train_eval")
def q_ml_train_eval(fx: Fixtures) -> DataFrame:
    return _trained(fx)[0].metrics


@register("ml_score")
def q_ml_score(fx: Fixtures) -> DataFrame:
    trained, df = _trained(fx)
    return model.score(trained.gbt, df)


# ---------------------------------------------------------------- streaming
def _with_skills(fx: Fixtures) -> DataFrame:
    skills = (fx.bridge.join(fx.dim_skill, "skill_id").groupBy("posting_id")
              .agg(F.array_sort(F.collect_list("skill_name")).alias("required_skills")))
    return fx.fact_wide.join(skills, "posting_id", "left")


def _events_dir(fx: Fixtures, copies: int = 1) -> str:
    """Publish one event per fact posting (skills sorted) into a fresh folder."""
    path = _scratch(fx, "events")
    for _ in range(copies):
        events.publish(_with_skills(fx), path=path)
    return path


@register("stream_publish", """
select f.posting_id, f.title, c.company_name company, f.region,
       coalesce((select string_agg(s.skill_name, ',' order by s.skill_name) from fx_bridge b
                 join fx_dim_skill s on s.skill_id = b.skill_id where b.posting_id = f.posting_id), '') skills
from fx_fact f left join fx_dim_company c on c.company_id = f.company_id""")
def q_stream_publish(fx: Fixtures) -> DataFrame:
    path = _events_dir(fx)
    ev = events.decode_events(fx.spark.read.schema(events.RECORD_SCHEMA).json(path))
    return ev.select("posting_id", "title", "company", "region",
                     F.array_join(F.coalesce("required_skills", F.array().cast("array<string>")), ",").alias("skills"))


@register("src_kafka_events", """
select f.posting_id, f.title, c.company_name company, f.region from fx_fact f
left join fx_dim_company c on c.company_id = f.company_id""")
def q_src_kafka_events(fx: Fixtures) -> DataFrame:
    path, sink = _events_dir(fx), _scratch(fx, "events-copy")
    src = events.subscribe(fx.spark, path=path)
    q = (src.writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", _scratch(fx, "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    return events.decode_events(fx.spark.read.parquet(sink)).select("posting_id", "title", "company", "region")


@register("sink_kafka_events", """
select f.posting_id "key",
       '{"posting_id":"' || f.posting_id || '","title":"' || f.title || '","company":"' || c.company_name
       || '","region":"' || f.region || '"}' "value",
       (select count(*) from fx_fact) published
from fx_fact f left join fx_dim_company c on c.company_id = f.company_id""")
def q_sink_kafka_events(fx: Fixtures) -> DataFrame:
    path = _scratch(fx, "events")
    n = events.publish(fx.fact_wide, path=path)
    return fx.spark.read.schema(events.RECORD_SCHEMA).json(path).select(
        "key", "value", F.lit(n).cast("bigint").alias("published"))


def _profile_rows(fx: Fixtures) -> DataFrame:
    return fx.profiles.join(fx.users, "user_id").select("user_id", "email", "skills", "target_roles")


def _match_stream(fx: Fixtures, copies: int) -> str:
    """Runs the stream to its end; returns its sink."""
    src = events.subscribe(fx.spark, path=_events_dir(fx, copies), files_per_trigger=4)
    sink = _scratch(fx, "notifications")
    index = ProfileIndex(fx.spark, _scratch(fx, "profile-index"))
    index.commit(_profile_rows(fx))
    jobs.run_match_stream(fx.spark, src, index, sink)
    return sink


def _notify_sql() -> str:
    from laborlake.plans import catalog_matching as cm
    return cm.per_user_sql(cm.PAIR_SQL["notification_text"], cm.NOTIFY_INTS, cm.NOTIFY_TEXTS)


def stream_match_pairs(fx: Fixtures) -> DataFrame:
    return jobs.read_notifications(fx.spark, _match_stream(fx, copies=2)).drop("batch_id", "profile_version")


@register("stream_match", _notify_sql())
def q_stream_match(fx: Fixtures) -> DataFrame:
    """Notifications written by the stream (events published twice: replays must not
    duplicate), summarised per user like ``notification_text``: summed per group of users that
    were told the same, then over the groups of each user."""
    from laborlake.plans import catalog_matching as cm
    rows, members = jobs.told(fx.spark, _match_stream(fx, copies=2))
    sums = cm.summed(rows, cm.NOTIFY_INTS, cm.NOTIFY_TEXTS, "group_id").join(members, "group_id")
    over = {"min_": F.min, "max_": F.max}
    return sums.groupBy("user_id").agg(*[over.get(c[:4], F.sum)(c).alias(c) for c in sums.columns if c not in ("group_id", "user_id")])


def changed_profiles(fx: Fixtures) -> DataFrame:
    """The edits between the two halves of ``profile_refresh``: every tenth user looks for
    something else, and every seventh of the rest takes the profile out."""
    k = F.col("user_id")
    return _profile_rows(fx).where((k % 10 == 0) | (k % 7 == 0)).select(
        "user_id", "email", F.when(k % 10 == 0, F.concat(F.lit("Brand#"), (k % 23 + 3).cast("string"), F.lit(", brand#"), (k % 5 + 1).cast("string")))
        .otherwise("").alias("skills"), F.when(k % 20 == 0, "steel").otherwise("").alias("target_roles"))


def _refresh_sql() -> str:
    from laborlake.plans import catalog_matching as cm
    after = (cm.PAIR_SQL["notification_text"].replace("from fx_profile p", "from fx_profile_edited p")
             .replace("where p.skills is not null", "where p.skills is not null and true"))
    return f"""
with v1 as ({cm.PAIR_SQL["notification_text"]}),
v2 as ({after}),
both_halves as (select 1 profile_version, * from v1 where cast(posting_id as bigint) % 2 = 0
                union all select 2, * from v2 where cast(posting_id as bigint) % 2 = 1)
select cast(profile_version as bigint) profile_version, user_id, count(*) pairs, cast(sum(length(title)) as bigint) len_title,
       cast(sum(length(body)) as bigint) len_body, min(posting_id) min_posting_id, max(body) max_body
from both_halves group by all"""


@register("profile_refresh", _refresh_sql())
def q_profile_refresh(fx: Fixtures) -> DataFrame:
    """The stream sees half of the postings, then profiles change, then it goes on with the other
    half: what each user was told, by the profile version that the batch used."""
    sink, path, checkpoint = _scratch(fx, "notifications"), _scratch(fx, "events"), _scratch(fx, "ckpt")
    index = ProfileIndex(fx.spark, _scratch(fx, "profile-index"))
    halves = [(_profile_rows(fx), 0), (changed_profiles(fx), 1)]
    for changes, half in halves:
        index.commit(changes)
        events.publish(_with_skills(fx).where(F.col("posting_id").cast("bigint") % 2 == half), path=path)
        jobs.run_match_stream(fx.spark, events.subscribe(fx.spark, path=path), index, sink, checkpoint)
    rows, members = jobs.told(fx.spark, sink)
    sums = rows.groupBy("profile_version", "group_id").agg(
        F.count(F.lit(1)).alias("pairs"), F.sum(F.length("title")).cast("bigint").alias("len_title"),
        F.sum(F.length("body")).cast("bigint").alias("len_body"), F.min("posting_id").alias("min_posting_id"), F.max("body").alias("max_body"))
    return sums.join(members, "group_id").groupBy("profile_version", "user_id").agg(
        F.sum("pairs").alias("pairs"), F.sum("len_title").alias("len_title"), F.sum("len_body").alias("len_body"),
        F.min("min_posting_id").alias("min_posting_id"), F.max("max_body").alias("max_body"))


NOTIFICATION_ROWS = "notification_id long, user_id long, posting_id string, is_read boolean, created_at timestamp_ntz"


@register("stream_notify_once", """
select notification_id, user_id, posting_id, is_read, created_at from (
  select *, row_number() over (partition by user_id, posting_id order by created_at, notification_id) rn
  from fx_notification) q where rn = 1""")
def q_stream_notify_once(fx: Fixtures) -> DataFrame:
    """The notifications arrive in files whose order is not that of their times."""
    src_dir, sink = _scratch(fx, "notif-in"), _scratch(fx, "notif-out")
    fx.notifications.repartition(8).write.parquet(src_dir)
    src = fx.spark.readStream.schema(NOTIFICATION_ROWS).option("maxFilesPerTrigger", 2).parquet(src_dir)
    order = ["created_at", "notification_id"]
    jobs.run_once_stream(fx.spark, src, ["user_id", "posting_id"], "notification_id", sink, order=order)
    return jobs.read_once(fx.spark, sink, ["user_id", "posting_id"], order, NOTIFICATION_ROWS, "notification_id").drop("batch_id")


@register("stream_rate", """
select user_id identity, time_bucket(interval 1 hour, ts) window_start,
       time_bucket(interval 1 hour, ts) + interval 1 hour window_end, count(*) requests
from events group by 1, 2, 3 having count(*) > 2""")
def q_stream_rate(fx: Fixtures) -> DataFrame:
    src_dir, sink = _scratch(fx, "requests"), _scratch(fx, "rate")
    fx.tables.events.select("user_id", "ts").repartition(8).write.parquet(src_dir)
    src = fx.spark.readStream.schema("user_id long, ts timestamp_ntz").option("maxFilesPerTrigger", 2).parquet(src_dir)
    jobs.run_rate_stream(fx.spark, src, sink, ts="ts", identity=F.col("user_id"), window_seconds=3600,
                         watermark="31 days")
    out = jobs.read_rate_violations(fx.spark, sink, limit=2)
    return out.select("identity", F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                      F.col("window_end").cast("timestamp_ntz").alias("window_end"), "requests")


@register("stream_status_merge", COMPANY_MERGE_SQL)
def q_stream_status_merge(fx: Fixtures) -> DataFrame:
    """The messages arrive in files whose order is not that of their times."""
    src_dir, sink = _scratch(fx, "classified"), _scratch(fx, "status")
    classified_messages(fx).repartition(6, "message_id").write.parquet(src_dir)
    src = fx.spark.readStream.schema(fx.spark.read.parquet(src_dir).schema).option("maxFilesPerTrigger", 2).parquet(src_dir)
    jobs.run_status_stream(fx.spark, src, sink)
    return jobs.read_status(fx.spark, sink).select("user_id", "company_key", "status", "rank", "first_seen",
                                                   "status_at", "messages")


# ---------------------------------------------------------------- sources / sinks
@register("src_jsonl", """
with bad as (select count(*) n from fx_raw where cast(posting_id as bigint) % 97 = 0)
select posting_id, title, company, location, region, seniority, remote, salary, cast(null as varchar) salary_currency_original,
       cast(null as varchar) required_skills, cast(null as varchar) description, cast(null as varchar) source, is_real,
       cast(null as varchar) url, posted_month from fx_raw
union all
select null, null, null, null, null, null, null, null, null, null, null, null, null, null, null
from generate_series(1, (select n from bad))""")
def q_src_jsonl(fx: Fixtures) -> DataFrame:
    """Raw postings landed as JSON lines (plus one unparseable line per 97 postings),
    read back with the explicit landing schema: bad lines become all-NULL rows."""
    path = _scratch(fx, "landing")
    from laborlake.plans.catalog import raw_postings
    good = raw_postings(fx).select(F.to_json(F.struct("*")).alias("value"))
    bad = raw_postings(fx).filter(F.col("posting_id").cast("bigint") % 97 == 0) \
        .select(F.concat(F.lit("{broken "), F.col("posting_id")).alias("value"))
    good.unionByName(bad).write.text(path)
    return files.read_jsonl(fx.spark, path).withColumn("required_skills", F.array_join("required_skills", ","))


@register("src_parquet", """
select posting_id, company_id, title, location, region, seniority, remote, salary, posted_month, is_real,
       predicted_salary, salary_vs_market, pay_band from fx_fact""")
def q_src_parquet(fx: Fixtures) -> DataFrame:
    path = _scratch(fx, "curated")
    files.write_parquet(fx.fact.drop("source", "url"), path)
    return files.read_parquet(fx.spark, path)


def _curated_outputs(fx: Fixtures) -> dict[str, DataFrame]:
    """The seven curated outputs; some locations are empty, as feeds deliver them."""
    from laborlake.plans.catalog import cleaned_postings
    no_place = F.col("posting_id").cast("bigint") % 10 == 3
    c = cleaned_postings(fx).withColumn("location", F.when(no_place, F.lit("")).otherwise(F.col("location")))
    skills = fx.posting_skill.join(c.select("posting_id"), "posting_id", "left_semi")
    return {"postings": c, "posting_skills": skills, "skill_demand": etl.skill_demand(skills),
            "salary_by_seniority": etl.batch_salary_by_seniority(c), "postings_by_month": etl.batch_postings_by_month(c),
            "salary_by_region": etl.batch_salary_by_region(c), "posting_scores": fx.scores}


@register("sink_parquet", """
select 'postings' "table", count(*) "rows" from fx_clean
union all select 'posting_skills', count(*) from fx_clean_skill
union all select 'skill_demand', count(distinct skill) from fx_clean_skill
union all select 'salary_by_seniority', (select count(*) from (select distinct seniority from fx_clean))
union all select 'postings_by_month', (select count(*) from (select distinct posted_month from fx_clean))
union all select 'salary_by_region', (select count(*) from (select distinct region from fx_clean))
union all select 'posting_scores', count(*) from fx_score""")
def q_sink_parquet(fx: Fixtures) -> DataFrame:
    """All curated directories as one release, counted as readers see them."""
    return files.publish_curated(fx.spark, _curated_outputs(fx), _scratch(fx, "curated"))


@register("sink_warehouse", """
with c as (select * replace (case when cast(posting_id as bigint) % 10 = 3 then '' else location end as location) from fx_clean),
s as (select seniority, cast(round(avg(salary_clean)) as bigint) a, quantile_disc(salary_clean, 0.5) m from c group by 1),
r as (select region, cast(round(avg(salary_clean)) as bigint) a from c group by 1),
k as (select skill, count(*) n from fx_clean_skill group by 1),
p as (select posted_month, count(*) n from c group by 1)
select 'raw_postings' "table", count(*) "rows", count(*) filter (where nullif(location, '') is null) empty_text,
       cast(sum(salary_clean) as bigint) total, 'bigint' total_type from c
union all select 'raw_posting_skills', count(*), count(*) filter (where nullif(skill, '') is null), null, null from fx_clean_skill
union all select 'raw_skill_demand', count(*), count(*) filter (where nullif(skill, '') is null), cast(sum(n) as bigint), 'bigint' from k
union all select 'raw_salary_by_seniority', count(*), count(*) filter (where nullif(seniority, '') is null), cast(sum(a) + sum(m) as bigint), 'bigint' from s
union all select 'raw_postings_by_month', count(*), 0, cast(sum(n) as bigint), 'bigint' from p
union all select 'raw_salary_by_region', count(*), count(*) filter (where nullif(region, '') is null), cast(sum(a) as bigint), 'bigint' from r
union all select 'raw_posting_scores', count(*), count(*) filter (where nullif(pay_band, '') is null), cast(sum(predicted_salary) as bigint), 'bigint' from fx_score""")
def q_sink_warehouse(fx: Fixtures) -> DataFrame:
    """The warehouse's seven raw tables after a refresh: rows, texts loaded as NULL, and the total
    of the typed numbers with the type that they got."""
    curated, base = _scratch(fx, "curated"), _scratch(fx, "warehouse")
    files.publish_curated(fx.spark, _curated_outputs(fx), curated)
    files.publish_warehouse(fx.spark, curated, base)
    shown = {"postings": ("location", ["salary_clean"]), "posting_skills": ("skill", []), "skill_demand": ("skill", ["count"]),
             "salary_by_seniority": ("seniority", ["avg_salary", "median_salary"]), "postings_by_month": (None, ["count"]),
             "salary_by_region": ("region", ["avg_salary"]), "posting_scores": ("pay_band", ["predicted_salary"])}
    out = None
    for name, (text, numbers) in shown.items():
        t = releases.read(fx.spark, base, f"raw_{name}")
        total = sum((F.sum(c) for c in numbers[1:]), F.sum(numbers[0])) if numbers else F.lit(None)
        one = t.agg(F.count(F.lit(1)).alias("rows"), (F.count_if(F.col(text).isNull()) if text else F.lit(0)).cast("bigint").alias("empty_text"),
                    total.cast("bigint").alias("total")).select(
            F.lit(f"raw_{name}").alias("table"), "*", F.lit(t.schema[numbers[0]].dataType.simpleString() if numbers else None).alias("total_type"))
        out = one if out is None else out.unionByName(one)
    return out


@register("src_profiles_jdbc", """
select user_id, skills, target_roles, cast(null as varchar) headline, countries from fx_profile""")
def q_src_profiles_jdbc(fx: Fixtures) -> DataFrame:
    """Profile reader with pruned columns.  No database is started here, so the catalog
    / Parquet path of the reader is exercised; the JDBC path takes the same column list."""
    path = _scratch(fx, "profiles")
    files.write_parquet(fx.profiles, path)
    return files.read_profiles(fx.spark, path=path)


@register("sink_model")
def q_sink_model(fx: Fixtures) -> DataFrame:
    """The stored model, saved, loaded again and applied."""
    from pyspark.ml import PipelineModel
    base = _scratch(fx, "model")
    trained, df = _trained(fx)
    files.save_model(trained.gbt, f"{base}/gbt")
    return model.score(PipelineModel.load(f"{base}/gbt"), df)


@register("sink_metrics")
def q_sink_metrics(fx: Fixtures) -> DataFrame:
    base = _scratch(fx, "metrics")
    files.save_metrics(_trained(fx)[0].metrics, base)
    return fx.spark.read.schema(model.METRICS).json(base)


@register("event_codec", """
select f.posting_id, f.title, c.company_name company, f.region from fx_fact f
left join fx_dim_company c on c.company_id = f.company_id""")
def q_event_codec(fx: Fixtures) -> DataFrame:
    return events.decode_events(events.encode_events(fx.fact_wide)).select("posting_id", "title", "company", "region")


# ---------------------------------------------------------------- mail helpers
@register("header_map", """
select message_id, sender, case when message_id % 2 = 0 then 'Re: ' || subject else subject end subject
from fx_message""")
def q_header_map(fx: Fixtures) -> DataFrame:
    m = fx.messages
    hdr = F.array(F.struct(F.lit("From").alias("name"), F.col("sender").alias("value")),
                  F.struct(F.lit("Subject").alias("name"), F.col("subject").alias("value")),
                  F.struct(F.lit("subject").alias("name"),
                           F.when(F.col("message_id") % 2 == 0, F.concat(F.lit("Re: "), F.col("subject")))
                            .otherwise(F.col("subject")).alias("value")))
    h = messages.header_map(hdr)
    return m.select("message_id", h["from"].alias("sender"), h["subject"].alias("subject"))


def _b64url(col) -> F.Column:
    b = F.regexp_replace(F.base64(F.encode(col, "UTF-8")), r"\s", "")
    return F.regexp_replace(F.translate(b, "+/", "-_"), "=+$", "")


@register("mime_body", """
select page_id message_id, case when page_id % 2 = 0 then url else html end body from pages""")
def q_mime_body(fx: Fixtures) -> DataFrame:
    p = fx.tables.pages
    parts = p.select(F.col("page_id").alias("message_id"), F.explode(F.array(
        F.struct(F.lit(0).alias("ord"), F.lit("multipart/alternative").alias("mime_type"),
                 F.lit(None).cast("string").alias("data")),
        F.struct(F.lit(1).alias("ord"),
                 F.when(F.col("page_id") % 2 == 0, "text/plain").otherwise("image/png").alias("mime_type"),
                 _b64url(F.col("url")).alias("data")),
        F.struct(F.lit(2).alias("ord"), F.lit("text/html").alias("mime_type"),
                 _b64url(F.col("html")).alias("data")))).alias("p")).select("message_id", "p.*")
    return messages.mime_body(parts)


@register("parse_labelled_json", """
select event_id, case when event_id % 3 = 2 then null else cast(json_extract(props, '$.k') as integer) end k
from events""")
def q_parse_labelled_json(fx: Fixtures) -> DataFrame:
    e = fx.tables.events
    labelled = (F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")))
                 .when(F.col("event_id") % 3 == 1, F.col("props"))
                 .otherwise(F.concat(F.lit("junk "), F.col("props"))))
    return e.select("event_id", messages.parse_labelled_json(labelled, "k int")["k"].alias("k"))


_EXT_SQL = ("case page_id % 6 when 0 then '.pdf' when 1 then '.tex' when 2 then '.docx' when 3 then '.TXT' "
            "when 4 then '.doc' else '.pages' end")

# Some uploads are empty and some too large, besides those of the pages' own sizes.
_SIZE_SQL = "case page_id % 11 when 0 then 0 when 1 then 6000000 when 2 then 5242880 else {size} end"


@register("intake_format", f"""
with f as (select page_id, 'page' || cast(page_id as varchar) || {_EXT_SQL} name, {_SIZE_SQL.format(size="octet_length(encode(html))")} size from pages)
select page_id, name,
       case when lower(name) like '%.pdf' then 'pdf' when lower(name) like '%.tex' or lower(name) like '%.latex' then 'tex'
            when lower(name) like '%.docx' then 'docx'
            when lower(name) like '%.txt' or lower(name) like '%.md' or lower(name) like '%.markdown' then 'txt' end format,
       case when size > 5242880 then 'File larger than 5 MB' when size < 1 then 'Empty file'
            when lower(name) like '%.pdf' or lower(name) like '%.tex' or lower(name) like '%.latex'
              or lower(name) like '%.docx' or lower(name) like '%.txt' or lower(name) like '%.md'
              or lower(name) like '%.markdown' then null
            when lower(name) like '%.doc' then 'Legacy .doc isn''t supported. Save as .docx or .pdf and upload again.'
            else 'Unsupported file type: ' || name || '. Use .tex, .pdf, .docx, or .txt' end error
from f""")
def q_intake_format(fx: Fixtures) -> DataFrame:
    p = fx.tables.pages.select("page_id", F.concat(F.lit("page"), F.col("page_id").cast("string"),
                                                   F.expr(_EXT_SQL)).alias("name"),
                               F.expr(_SIZE_SQL.format(size="octet_length(html)")).alias("size"))
    fmt, err = messages.intake_format("name", "size")
    return p.select("page_id", "name", fmt.alias("format"), err.alias("error"))


# ---------------------------------------------------------------- pipeline
def _pipeline_sql() -> str:
    from laborlake.plans import catalog_text as ct
    remotive = ct._match_terms_sql(PROFILE_TERMS)
    arbeitnow = " or ".join(f"instr(lower(coalesce(title, '')), '{t.lower()}') > 0" for t in PROFILE_TERMS)
    jobs_sql = ct._JOBS_CTE.replace(ct._match_terms_sql(ct.REMOTIVE_TERMS), remotive).replace(
        " or ".join(f"instr(lower(coalesce(title, '')), '{t}') > 0" for t in ct.ARBEITNOW_TERMS), arbeitnow)
    return f"""
with live as ({jobs_sql} where nullif(trim(title), '') is not null)
select posting_id, md5(company) company_id, title, location, region, seniority, remote,
       try_cast(regexp_extract(regexp_replace(cast(salary as varchar), '[^0-9.]', '', 'g'), '^([0-9]+)', 1) as bigint) salary,
       posted_month, source, url, 'ok' publish_step
from live"""


#: What the profiles look for, and the ingest's own terms behind it.
PROFILE_TERMS = ("Ring", "plate", "rod", "Bolt Blue")


@register("pipeline_run", _pipeline_sql())
def q_pipeline_run(fx: Fixtures) -> DataFrame:
    """The whole run, from the landed pages and the profiles' search terms to the gate; returns the
    live part of the fact that it published, with the outcome of the publish step."""
    from laborlake.operators.matching import search_terms
    from laborlake.plans.pipeline import PipelineConf, run, warehouse
    found = search_terms(fx.profiles, ["ring", "Bolt Blue"]).orderBy("src", "user_id", "pos").select("term")
    conf = PipelineConf(base=_scratch(fx, "pipeline"), synthetic_ids=fx.tables.orders.select("o_orderkey"),
                        pages=landed_pages(fx.spark, fx.sf_dir), terms=[r["term"] for r in found.collect()])
    status = {r["step"]: r["status"] for r in run(fx.spark, conf).collect()}
    return releases.read(fx.spark, warehouse(conf), "fact_job_posting").where("is_real").select(
        "posting_id", "company_id", "title", "location", "region", "seniority", "remote", "salary", "posted_month", "source", "url",
        F.lit(status["publish"]).alias("publish_step"))


@register("bench_summary", """
select skill, count(*) mapreduce_count, count(*) dataframe_count, true same_result from fx_clean_skill group by skill""")
def q_bench_summary(fx: Fixtures) -> DataFrame:
    """The two formulations of the skill count side by side, and whether they agree; ``bench.py``
    holds the stopwatch."""
    from laborlake.plans.catalog import cleaned_postings
    clean_ids = cleaned_postings(fx).select("posting_id")
    skills = fx.posting_skill.join(clean_ids, "posting_id", "left_semi")
    lines = (skills.groupBy("posting_id").agg(F.collect_list("skill").alias("required_skills"))
             .select(F.to_json(F.struct("posting_id", "required_skills")).alias("value")))
    a = etl.mapreduce_skill_count(lines).select("skill", F.col("count").alias("mapreduce_count"))
    b = etl.skill_demand(skills).select("skill", F.col("count").alias("dataframe_count"))
    return a.join(b, "skill", "full_outer").withColumn(
        "same_result", F.col("mapreduce_count").eqNullSafe(F.col("dataframe_count")))
