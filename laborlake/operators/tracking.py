"""Application tracking: funnel, response rate per resume version, monotone status
merge, snapshot diffs, inbox filters, notifications and resume-version bookkeeping.

Per-user work never relies on a whole user's rows landing in one task: counts are
two-phase aggregates, "latest row" is an aggregate of a struct, per-user top-k uses
``row_number() <= k`` (Spark inserts a map-side group limit, so a hot user contributes
at most k rows per task to the shuffle), and per-user ordinals are computed with a
range-partitioned offset scheme (``ordinal_per_key``).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laborlake.session import cut_lineage

# --- fixed values (must equal the reference for identical results) -------------------
FUNNEL_STAGES = ("applied", "interview_invite", "offer")
TRACKED = ("applied", "rejected", "interview_invite", "offer")
STATUS_RANK = {"applied": 0, "recruiter_outreach": 0, "interview_invite": 1, "offer": 2, "rejected": 3}
POSITIVE_STATUSES = ("interview_invite", "offer")
SMALL_SAMPLE = 10
SAMPLE_WARNING = "too few applications to be meaningful"
UNVERSIONED = "(unversioned)"
CREATED_DETAIL = "created manually"
CHANGED_DETAIL = "changed from {old}"
ATS_DOMAINS = ("greenhouse.io", "lever.co", "myworkday.com", "workday.com", "ashbyhq.com",
               "smartrecruiters.com", "icims.com", "taleo.net", "successfactors.com",
               "jobvite.com", "breezy.hr", "workable.com", "bamboohr.com", "hire.google.com")
JOB_PHRASES = ("thank you for applying", "application received", "application status",
               "we received your application", "your application", "interview invitation",
               "schedule an interview", "interview request", "offer letter",
               "application update", "regarding your application")
DEFAULT_LOOKBACK_DAYS = 30
RATE_LIMIT_REQUESTS = 300
RATE_LIMIT_WINDOW_SECONDS = 60
NOTIFICATION_PAGE = 30
PREVIEW_CHARS = 200
# ---------------------------------------------------------------------------------------


def pct_tenths(num: Column, den: Column) -> Column:
    """round(100·num/den, 1) on the exact ratio, half to even; 0.0 when den = 0.
    Integer arithmetic, so every engine gives the same value."""
    n, d = num.cast("bigint") * 1000, den.cast("bigint")
    q = F.floor(n / d).cast("bigint")
    r2 = (n - q * d) * 2
    t = F.when(r2 > d, q + 1).when((r2 == d) & (q % 2 == 1), q + 1).otherwise(q)
    return F.when(d > 0, t / 10.0).otherwise(F.lit(0.0))


def rank_of(status) -> Column:
    m = F.create_map(*[x for k, v in STATUS_RANK.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[status if isinstance(status, Column) else F.col(status)], F.lit(0))


# ---------------------------------------------------------------- funnel / response rate
def events_apps(events: DataFrame, apps: DataFrame) -> DataFrame:
    """application event ⋈ application (inner, on application_id)."""
    return events.join(apps.select("application_id", "user_id", "resume_version"),
                       ["application_id", "user_id"] if "user_id" in events.columns else ["application_id"])


FUNNEL_STATUSES = ("applied", "interview_invite", "offer", "rejected")


def reached_statuses(events: DataFrame, apps: DataFrame) -> DataFrame:
    """The applications with ``mask``: bit i is set if an event gave them status i of
    ``FUNNEL_STATUSES``.  Masks combine before the shuffle, and what follows are plain sums."""
    bit = F.lit(0).cast("bigint")
    for i, s in enumerate(FUNNEL_STATUSES):
        bit = F.when(F.col("status") == s, 1 << i).otherwise(bit)
    masks = events.groupBy("application_id").agg(F.bit_or(bit.cast("bigint")).alias("mask"))
    return apps.join(masks, "application_id", "left").withColumn("mask", F.coalesce("mask", F.lit(0)))


def _reached(*statuses: str) -> Column:
    bits = sum(1 << FUNNEL_STATUSES.index(s) for s in statuses)
    return F.sum((F.col("mask").bitwiseAND(F.lit(bits)) != 0).cast("bigint"))


def application_funnel(events: DataFrame, apps: DataFrame) -> DataFrame:
    """Per user: applied → interview → offer counts (applications that reached each status)
    as % of max(applied, total applications)."""
    j = reached_statuses(events, apps).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_applications"), *[_reached(s).alias(f"r_{s}") for s in FUNNEL_STATUSES])
    base = F.greatest("r_applied", "total_applications")
    return j.select(
        "user_id", "total_applications",
        F.col("r_rejected").alias("rejected"),
        F.greatest(F.col("total_applications") - F.col("r_rejected") - F.col("r_offer"), F.lit(0))
         .alias("awaiting_response"),
        base.alias("applied_count"), pct_tenths(base, base).alias("applied_percent"),
        F.col("r_interview_invite").alias("interview_count"),
        pct_tenths(F.col("r_interview_invite"), base).alias("interview_percent"),
        F.col("r_offer").alias("offer_count"), pct_tenths(F.col("r_offer"), base).alias("offer_percent"))


def resume_performance(events: DataFrame, apps: DataFrame) -> DataFrame:
    """Per user and resume version: applications, applications that ever got an interview or
    offer, response rate, small-sample warning."""
    j = reached_statuses(events, apps).groupBy("user_id", "resume_version").agg(
        F.count(F.lit(1)).alias("applications"), _reached(*POSITIVE_STATUSES).alias("positive_responses"))
    return j.select(
        "user_id", F.coalesce("resume_version", F.lit(UNVERSIONED)).alias("resume_version"),
        "applications", "positive_responses",
        pct_tenths(F.col("positive_responses"), F.col("applications")).alias("response_rate_percent"),
        F.when(F.col("applications") < SMALL_SAMPLE, F.lit(SAMPLE_WARNING)).alias("sample_warning"))


# ---------------------------------------------------------------- status merge
def tracked_filter(classified: DataFrame, category: str = "status", company: str = "company") -> DataFrame:
    """Classified messages that count as applications (tracked category, non-blank company)."""
    return classified.filter(F.col(category).isin(*TRACKED)
                             & (F.trim(F.coalesce(F.col(company), F.lit(""))) != ""))


def tracked_counts(classified: DataFrame, category: str = "status", company: str = "company") -> DataFrame:
    """Per user: messages that count as applications, and those skipped."""
    known = F.coalesce(F.col(category).isin(*TRACKED), F.lit(False)) & (F.trim(F.coalesce(F.col(company), F.lit(""))) != "")
    return classified.groupBy("user_id").agg(F.count_if(known).alias("tracked"), F.count_if(~known).alias("skipped"))


def company_status(classified: DataFrame) -> DataFrame:
    """Status per (user, company in lower case) over the tracked messages; the frame may be a stream."""
    keyed = tracked_filter(classified).withColumn("company_key", F.lower(F.trim("company")))
    return status_merge(keyed, ["user_id", "company_key"], ["occurred_at", "message_id"])


def status_merge(messages: DataFrame, key_cols: list[str], order_cols: list[str],
                 status: str = "status") -> DataFrame:
    """Current application status per key: status never moves down the rank and an
    equal rank keeps the older status ⇒ the earliest message of the highest rank.
    One aggregate of a struct per key (partial aggregation keeps one candidate per task)."""
    first_at = order_cols[0]
    neg = [-F.col(c) if c != first_at else -F.unix_micros(F.col(c).cast("timestamp"))
           for c in order_cols]
    best = F.max(F.struct(rank_of(status).alias("rank"), *[n.alias(f"o{i}") for i, n in enumerate(neg)],
                          F.col(status).alias("status"), F.col(first_at).alias("at")))
    return (messages.groupBy(*key_cols)
            .agg(best.alias("b"), F.min(first_at).alias("first_seen"), F.count(F.lit(1)).alias("messages"))
            .select(*key_cols, F.col("b.status").alias("status"), F.col("b.rank").alias("rank"),
                    "first_seen", F.col("b.at").alias("status_at"), "messages"))


def status_change_events(old: DataFrame, new: DataFrame, key: str = "application_id") -> DataFrame:
    """Snapshot diff: keys absent from ``old`` → 'created manually'; a different status →
    'changed from <old>'; unchanged → no event."""
    o = old.select(key, F.col("status").alias("old_status"))
    j = new.select(key, "status").join(o, key, "left")
    return (j.filter(F.col("old_status").isNull() | ~F.col("status").eqNullSafe(F.col("old_status")))
             .select(key, "status",
                     F.when(F.col("old_status").isNull(), F.lit(CREATED_DETAIL))
                      .otherwise(F.concat(F.lit("changed from "), F.col("old_status"))).alias("detail")))


def new_messages(messages: DataFrame, history: DataFrame, key: str = "message_id") -> DataFrame:
    """Messages not already in the event history (left anti join on the message id)."""
    return messages.join(history.select(key).filter(F.col(key).isNotNull()), key, "left_anti")


def event_once(history: DataFrame, incoming: DataFrame, key: str = "message_id",
               order_col: str = "occurred_at") -> DataFrame:
    """Insert-or-ignore by message id: existing events win, and within the incoming batch
    the first row per id is kept."""
    fresh = new_messages(incoming, history, key)
    others = [c for c in fresh.columns if c != key]
    first = F.min(F.struct(F.col(order_col).alias("__o"), *[F.col(c).alias(f"__v_{c}") for c in others]))
    fresh = fresh.groupBy(key).agg(first.alias("__f")).select(key, *[F.col(f"__f.__v_{c}").alias(c) for c in others])
    return history.select(*fresh.columns).unionByName(fresh)


def job_mail_filter(messages: DataFrame, lookback_days: int = DEFAULT_LOOKBACK_DAYS,
                    now: Column | None = None) -> DataFrame:
    """Candidate job mails: newer than N days AND (sender on an ATS domain OR the subject
    holds one of the job phrases, case-insensitive).  ``now`` defaults to the newest
    message time (a scalar subquery), so the filter is reproducible."""
    if now is None:
        now = messages.agg(F.max("ts")).scalar()
    domains = "|".join(d.replace(".", r"\.") for d in ATS_DOMAINS)
    sender_hit = F.lower(F.col("sender")).rlike(rf"[@.]({domains})\b")
    subj = F.lower(F.coalesce(F.col("subject"), F.lit("")))
    phrase_hit = F.lit(False)
    for p in JOB_PHRASES:
        phrase_hit = phrase_hit | (F.instr(subj, p) > 0)
    recent = F.col("ts") >= now - F.make_dt_interval(F.lit(lookback_days))
    return messages.filter(recent & (sender_hit | phrase_hit))


# ---------------------------------------------------------------- notifications
def unread_count(notifications: DataFrame) -> DataFrame:
    return notifications.groupBy("user_id").agg(F.count_if(~F.col("is_read")).alias("unread"))


def latest_n(df: DataFrame, key: str, order_col: str, tie: str, n: int) -> DataFrame:
    """Newest ``n`` rows per key (``row_number() <= n``: map-side group limit)."""
    w = Window.partitionBy(key).orderBy(F.desc(order_col), F.desc(tie))
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def unread_notifications(notifications: DataFrame, unread_only: bool = True,
                         limit: int = NOTIFICATION_PAGE) -> DataFrame:
    src = notifications.filter(~F.col("is_read")) if unread_only else notifications
    return latest_n(src, "user_id", "created_at", "notification_id", limit)


# ---------------------------------------------------------------- resume versions
def active_resume(versions: DataFrame, key: str = "user_id", order_col: str = "activated_at",
                  id_col: str = "version_id") -> DataFrame:
    """Exactly one active version per user: the last activated (ties: highest id)."""
    last = versions.groupBy(key).agg(F.max(F.struct(order_col, id_col)).alias("__m")) \
                   .select(key, F.col(f"__m.{id_col}").alias("__active_id"))
    return versions.join(last, key).withColumn("is_active", F.col(id_col) == F.col("__active_id")) \
                   .drop("__active_id")


def ordinal_per_key(df: DataFrame, key: str, order_cols: list[str], n_parts: int | None = None) -> DataFrame:
    """1-based position of each row within its key by ``order_cols`` (a per-key
    ``row_number``) without routing a whole key to one task.

    Rows are range-partitioned on (key, order) — a hot key spans several partitions —
    numbered within (key, partition), and shifted by the row counts of the same key in
    earlier partitions (a per-key prefix sum over at most ``n_parts`` rows)."""
    spark = df.sparkSession
    n_parts = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The partition id is materialised once (reliable checkpoint in spark.checkpoint.dir):
    # both the numbering and the offsets read the same assignment, whatever the input order.
    ranged = cut_lineage(df.repartitionByRange(n_parts, key, *order_cols)
                           .withColumn("__pid", F.spark_partition_id()))
    local = Window.partitionBy(key, "__pid").orderBy(*order_cols)
    ranged = ranged.withColumn("__local", F.row_number().over(local))
    counts = ranged.groupBy(key, "__pid").agg(F.count(F.lit(1)).alias("__n"))
    prefix = Window.partitionBy(key).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__n").over(prefix), F.lit(0))).drop("__n")
    return (ranged.join(offsets, [key, "__pid"])
                  .withColumn("ordinal", (F.col("__off") + F.col("__local")).cast("bigint"))
                  .drop("__pid", "__local", "__off"))


def edit_labels(versions: DataFrame, key: str = "user_id",
                order_cols: tuple[str, ...] = ("activated_at", "version_id")) -> DataFrame:
    """Default label of each saved version: ``edit-{n+1}`` with n = versions the user
    already had."""
    o = ordinal_per_key(versions, key, list(order_cols))
    return o.withColumn("label", F.concat(F.lit("edit-"), F.col("ordinal").cast("string")))


def resume_version_rows(versions: DataFrame) -> DataFrame:
    """List projection: 200-character preview, has_latex / has_original flags."""
    nonblank = lambda c: F.coalesce(F.col(c).isNotNull() & (F.col(c) != ""), F.lit(False))
    return versions.select(
        "version_id", "user_id", "activated_at", "origin",
        F.substring(F.coalesce("content_text", F.lit("")), 1, PREVIEW_CHARS).alias("preview"),
        nonblank("content_latex").alias("has_latex"),
        F.col("has_original_file").alias("has_original"))


# ---------------------------------------------------------------- gateway traffic
def rate_violations(requests: DataFrame, ts: str = "ts", identity: Column | None = None,
                    window_seconds: int = RATE_LIMIT_WINDOW_SECONDS,
                    limit: int = RATE_LIMIT_REQUESTS) -> DataFrame:
    """Fixed (tumbling) windows per identity whose request count exceeds the limit."""
    ident = identity if identity is not None else F.col("identity")
    w = F.window(F.col(ts), f"{window_seconds} seconds")
    return (requests.groupBy(ident.alias("identity"), w.alias("w"))
                    .agg(F.count(F.lit(1)).alias("requests"))
                    .filter(F.col("requests") > limit)
                    .select("identity", F.col("w.start").alias("window_start"),
                            F.col("w.end").alias("window_end"), "requests"))
