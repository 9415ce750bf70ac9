"""Query catalog, part 3: application tracking, inbox, notifications, resume versions,
gateway rate limits, de-duplication."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlake.operators import etl, tracking
from laborlake.plans.registry import register
from laborlake.sources.fixtures import Fixtures

# The "earlier snapshot" of the application state: everything before this instant.
SNAPSHOT_CUTOFF = "2024-01-15 00:00:00"
_RANK_SQL = ("case status when 'applied' then 0 when 'recruiter_outreach' then 0 when 'interview_invite' then 1 "
             "when 'offer' then 2 when 'rejected' then 3 else 0 end")


def classified_messages(fx: Fixtures) -> DataFrame:
    """Messages with a company written in either case; every 13th one names none."""
    mid, app = F.col("message_id"), F.col("application_id").cast("string")
    name = F.when(mid % 13 == 0, F.lit("  ")).when(mid % 2 == 0, F.concat(F.lit("App-"), app)) \
        .otherwise(F.concat(F.lit(" app-"), app))
    return fx.application_events.withColumn("company", name)


def _tracked(fx: Fixtures) -> DataFrame:
    return tracking.tracked_filter(classified_messages(fx))


def _merged(events: DataFrame) -> DataFrame:
    return tracking.status_merge(events, ["user_id", "application_id"], ["occurred_at", "message_id"])


def _cut(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col) < F.lit(SNAPSHOT_CUTOFF).cast("timestamp_ntz"))


_MERGE_SQL = f"""
select user_id, application_id,
       first(status order by {_RANK_SQL} desc, occurred_at, message_id) status,
       max({_RANK_SQL}) rank, min(occurred_at) first_seen,
       first(occurred_at order by {_RANK_SQL} desc, occurred_at, message_id) status_at, count(*) messages
from fx_application_event
where status in ('applied', 'rejected', 'interview_invite', 'offer') and message_id % 13 <> 0 {{extra}}
group by user_id, application_id"""
COMPANY_MERGE_SQL = f"""
select user_id, 'app-' || cast(application_id as varchar) company_key,
       first(status order by {_RANK_SQL} desc, occurred_at, message_id) status,
       cast(max({_RANK_SQL}) as integer) rank, min(occurred_at) first_seen,
       first(occurred_at order by {_RANK_SQL} desc, occurred_at, message_id) status_at, count(*) messages
from fx_application_event
where status in ('applied', 'rejected', 'interview_invite', 'offer') and message_id % 13 <> 0
group by all"""


@register("application_funnel", """
with r as (select a.user_id,
                  count(distinct case when e.status = 'applied' then e.application_id end) r_applied,
                  count(distinct case when e.status = 'interview_invite' then e.application_id end) r_interview,
                  count(distinct case when e.status = 'offer' then e.application_id end) r_offer,
                  count(distinct case when e.status = 'rejected' then e.application_id end) r_rejected
           from fx_application_event e join fx_application a on a.application_id = e.application_id group by a.user_id),
t as (select user_id, count(*) total from fx_application group by user_id),
j as (select t.user_id, t.total, coalesce(r_applied, 0) ra, coalesce(r_interview, 0) ri, coalesce(r_offer, 0) ro,
             coalesce(r_rejected, 0) rr, greatest(coalesce(r_applied, 0), t.total) b
      from t left join r on r.user_id = t.user_id)
select user_id, total total_applications, rr rejected, greatest(total - rr - ro, 0) awaiting_response,
       b applied_count,
       case when b > 0 then (case when 2 * ((b * 1000) % b) > b or (2 * ((b * 1000) % b) = b and (b * 1000 // b) % 2 = 1)
            then b * 1000 // b + 1 else b * 1000 // b end) / 10.0 else 0.0 end applied_percent,
       ri interview_count,
       case when b > 0 then (case when 2 * ((ri * 1000) % b) > b or (2 * ((ri * 1000) % b) = b and (ri * 1000 // b) % 2 = 1)
            then ri * 1000 // b + 1 else ri * 1000 // b end) / 10.0 else 0.0 end interview_percent,
       ro offer_count,
       case when b > 0 then (case when 2 * ((ro * 1000) % b) > b or (2 * ((ro * 1000) % b) = b and (ro * 1000 // b) % 2 = 1)
            then ro * 1000 // b + 1 else ro * 1000 // b end) / 10.0 else 0.0 end offer_percent
from j""")
def q_application_funnel(fx: Fixtures) -> DataFrame:
    return tracking.application_funnel(fx.application_events, fx.applications)


@register("resume_performance", """
with t as (select user_id, resume_version, count(*) n from fx_application group by 1, 2),
p as (select a.user_id, a.resume_version, count(distinct e.application_id) pos
      from fx_application_event e join fx_application a on a.application_id = e.application_id
      where e.status in ('interview_invite', 'offer') group by 1, 2),
j as (select t.user_id, t.resume_version, t.n, coalesce(p.pos, 0) pos from t
      left join p on p.user_id = t.user_id and p.resume_version is not distinct from t.resume_version)
select user_id, coalesce(resume_version, '(unversioned)') resume_version, n applications, pos positive_responses,
       case when n > 0 then (case when 2 * ((pos * 1000) % n) > n or (2 * ((pos * 1000) % n) = n and (pos * 1000 // n) % 2 = 1)
            then pos * 1000 // n + 1 else pos * 1000 // n end) / 10.0 else 0.0 end response_rate_percent,
       case when n < 10 then 'too few applications to be meaningful' end sample_warning
from j""")
def q_resume_performance(fx: Fixtures) -> DataFrame:
    return tracking.resume_performance(fx.application_events, fx.applications)


@register("events_apps", """
select e.application_id, e.user_id, e.message_id, e.status, e.occurred_at, a.resume_version
from fx_application_event e join fx_application a on a.application_id = e.application_id and a.user_id = e.user_id""")
def q_events_apps(fx: Fixtures) -> DataFrame:
    return tracking.events_apps(fx.application_events, fx.applications).select(
        "application_id", "user_id", "message_id", "status", "occurred_at", "resume_version")


@register("tracked_filter", """
select message_id, application_id, status from fx_application_event
where status in ('applied', 'rejected', 'interview_invite', 'offer') and message_id % 13 <> 0""")
def q_tracked_filter(fx: Fixtures) -> DataFrame:
    return _tracked(fx).select("message_id", "application_id", "status")


@register("tracked_counts", """
select user_id, count(*) filter (where tracked) tracked, count(*) filter (where not tracked) skipped
from (select user_id, status in ('applied', 'rejected', 'interview_invite', 'offer') and message_id % 13 <> 0 tracked
      from fx_application_event) q group by user_id""")
def q_tracked_counts(fx: Fixtures) -> DataFrame:
    return tracking.tracked_counts(classified_messages(fx))


@register("status_merge", COMPANY_MERGE_SQL)
def q_status_merge(fx: Fixtures) -> DataFrame:
    return tracking.company_status(classified_messages(fx))


@register("status_change_events", f"""
with o as ({_MERGE_SQL.format(extra=f"and occurred_at < timestamp '{SNAPSHOT_CUTOFF}'")}),
n as ({_MERGE_SQL.format(extra="")})
select n.application_id, n.status,
       case when o.status is null then 'created manually' else 'changed from ' || o.status end detail
from n left join o on o.application_id = n.application_id
where o.status is null or o.status <> n.status""")
def q_status_change_events(fx: Fixtures) -> DataFrame:
    t = _tracked(fx)
    return tracking.status_change_events(_merged(_cut(t, "occurred_at")), _merged(t))


@register("applications_by_status", f"""
with s as ({_MERGE_SQL.format(extra="")})
select a.application_id, a.user_id, s.status, a.updated_at from fx_application a
join s on s.application_id = a.application_id where s.status = 'interview_invite'""")
def q_applications_by_status(fx: Fixtures) -> DataFrame:
    cur = _merged(_tracked(fx)).select("application_id", "status")
    return (fx.applications.join(cur, "application_id").filter(F.col("status") == "interview_invite")
            .select("application_id", "user_id", "status", "updated_at").orderBy(F.desc("updated_at")))


@register("new_messages", f"""
select m.message_id, m.user_id, m.ts, m.sender, m.subject from fx_message m
where not exists (select 1 from fx_application_event e where e.message_id = m.message_id
                  and e.occurred_at < timestamp '{SNAPSHOT_CUTOFF}')""")
def q_new_messages(fx: Fixtures) -> DataFrame:
    history = _cut(fx.application_events, "occurred_at")
    return tracking.new_messages(fx.messages, history)


@register("event_once", f"""
select message_id, application_id, user_id,
       case when occurred_at < timestamp '{SNAPSHOT_CUTOFF}' then 'recruiter_outreach' else status end status, occurred_at
from fx_application_event""")
def q_event_once(fx: Fixtures) -> DataFrame:
    """Known ids keep their stored status; of a new id's two deliveries the earlier stays."""
    ev = fx.application_events
    known = _cut(ev, "occurred_at").withColumn("status", F.lit("recruiter_outreach"))
    again = ev.withColumn("status", F.lit("rejected")).withColumn("occurred_at", F.expr("occurred_at + interval 1 hour"))
    return tracking.event_once(known, ev.unionByName(again)).select(
        "message_id", "application_id", "user_id", "status", "occurred_at")


@register("job_mail_filter", """
select message_id, user_id, ts, sender, subject from fx_message
where ts >= (select max(ts) from fx_message) - interval 7 day
  and (regexp_matches(lower(sender), '[@.](greenhouse\\.io|lever\\.co|myworkday\\.com|workday\\.com|ashbyhq\\.com|smartrecruiters\\.com|icims\\.com|taleo\\.net|successfactors\\.com|jobvite\\.com|breezy\\.hr|workable\\.com|bamboohr\\.com|hire\\.google\\.com)\\b')
       or contains(lower(subject), 'thank you for applying') or contains(lower(subject), 'application received')
       or contains(lower(subject), 'application status') or contains(lower(subject), 'we received your application')
       or contains(lower(subject), 'your application') or contains(lower(subject), 'interview invitation')
       or contains(lower(subject), 'schedule an interview') or contains(lower(subject), 'interview request')
       or contains(lower(subject), 'offer letter') or contains(lower(subject), 'application update')
       or contains(lower(subject), 'regarding your application'))""")
def q_job_mail_filter(fx: Fixtures) -> DataFrame:
    return tracking.job_mail_filter(fx.messages, lookback_days=7)


@register("unread_count", """
select user_id, count(*) filter (where not is_read) unread from fx_notification group by user_id""")
def q_unread_count(fx: Fixtures) -> DataFrame:
    return tracking.unread_count(fx.notifications)


@register("unread_notifications", """
select notification_id, user_id, posting_id, is_read, created_at, rn from (
  select *, row_number() over (partition by user_id order by created_at desc, notification_id desc) rn
  from fx_notification where not is_read) q where rn <= 30""")
def q_unread_notifications(fx: Fixtures) -> DataFrame:
    return tracking.unread_notifications(fx.notifications).select(
        "notification_id", "user_id", "posting_id", "is_read", "created_at", F.col("rn").cast("bigint").alias("rn"))


@register("latest_n", """
select application_id, user_id, updated_at, rn from (
  select *, row_number() over (partition by user_id order by updated_at desc, application_id desc) rn
  from fx_application) q where rn <= 5""")
def q_latest_n(fx: Fixtures) -> DataFrame:
    return tracking.latest_n(fx.applications, "user_id", "updated_at", "application_id", 5).select(
        "application_id", "user_id", "updated_at", F.col("rn").cast("bigint").alias("rn"))


@register("active_resume", """
select version_id, user_id, activated_at, origin,
       version_id = first(version_id order by activated_at desc, version_id desc) over (partition by user_id) is_active
from fx_resume_version""")
def q_active_resume(fx: Fixtures) -> DataFrame:
    return tracking.active_resume(fx.resume_versions).select("version_id", "user_id", "activated_at", "origin",
                                                             "is_active")


@register("edit_label", """
select version_id, user_id,
       'edit-' || cast(row_number() over (partition by user_id order by activated_at, version_id) as varchar) label
from fx_resume_version""")
def q_edit_label(fx: Fixtures) -> DataFrame:
    return tracking.edit_labels(fx.resume_versions).select("version_id", "user_id", "label")


@register("dedupe_keep_last", """
select user_id, version_id, activated_at, origin from (
  select *, row_number() over (partition by user_id order by activated_at desc, version_id desc) rn
  from fx_resume_version where origin is not null) q where rn = 1""")
def q_dedupe_keep_last(fx: Fixtures) -> DataFrame:
    rows = fx.resume_versions.withColumnRenamed("origin", "title")
    out = etl.dedupe_keep_last(rows, "user_id", ["activated_at", "version_id"])
    return out.select("user_id", "version_id", "activated_at", F.col("title").alias("origin"))


_LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
               "l_linestatus", "l_shipdate")


@register("dedupe_postings", f"""
select l_orderkey, {", ".join(_LINE_ORDER)} from (
  select *, row_number() over (partition by l_orderkey order by {", ".join(f"{c} nulls first" for c in _LINE_ORDER)}) rn
  from lineitem) q where rn = 1""")
def q_dedupe_postings(fx: Fixtures) -> DataFrame:
    """Orders repeat in ``lineitem``: one differing row of each stays, whole."""
    return etl.dedupe_postings(fx.tables.lineitem.select("l_orderkey", *_LINE_ORDER), "l_orderkey")


@register("resume_versions", """
select v.version_id, v.user_id, v.activated_at, v.origin, substring(coalesce(d.text, ''), 1, 200) preview,
       coalesce(v.origin = 'signup' and d.text is not null and d.text <> '', false) has_latex,
       v.origin = 'view' has_original
from fx_resume_version v left join documents d on d.doc_id = v.version_id""")
def q_resume_versions(fx: Fixtures) -> DataFrame:
    docs = fx.tables.documents.select(F.col("doc_id").alias("version_id"), F.col("text").alias("content_text"))
    v = (fx.resume_versions.join(docs, "version_id", "left")
         .withColumn("content_latex", F.when(F.col("origin") == "signup", F.col("content_text")))
         .withColumn("has_original_file", F.col("origin") == "view"))
    return tracking.resume_version_rows(v)


@register("rate_violations", """
select user_id identity, time_bucket(interval 1 hour, ts) window_start,
       time_bucket(interval 1 hour, ts) + interval 1 hour window_end, count(*) requests
from events group by 1, 2, 3 having count(*) > 2""")
def q_rate_violations(fx: Fixtures) -> DataFrame:
    return tracking.rate_violations(fx.tables.events, identity=F.col("user_id"), window_seconds=3600, limit=2)
