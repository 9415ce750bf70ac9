"""Query catalog, part 2: posting ↔ profile matching, profiles, notifications."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlake.functions.lists import csv_list, list_to_csv
from laborlake.operators import matching
from laborlake.plans.registry import register
from laborlake.sources.fixtures import Fixtures

_MATCH_CTE = """
with pk as (select distinct b.posting_id, lower(trim(s.skill_name)) skill
            from fx_bridge b join fx_dim_skill s on s.skill_id = b.skill_id),
prof as (select p.user_id, u.c_name email, p.skills, p.target_roles from fx_profile p
         join customer u on u.c_custkey = p.user_id where p.skills is not null and p.skills <> ''),
uk as (select distinct user_id, lower(trim(x)) skill from prof, unnest(string_split(skills, ',')) t(x)
       where trim(x) <> ''),
ur as (select distinct user_id, lower(trim(x)) role
       from prof, unnest(string_split(coalesce(target_roles, ''), ',')) t(x) where trim(x) <> ''),
sk as (select uk.user_id, pk.posting_id, count(*) n from uk join pk on uk.skill = pk.skill group by 1, 2),
rl as (select distinct ur.user_id, f.posting_id from ur join fx_fact f on instr(lower(f.title), ur.role) > 0),
pairs as (select user_id, posting_id from sk where n >= 2 union select user_id, posting_id from rl),
ov as (select p.user_id, p.posting_id, string_agg(pk.skill, ', ' order by pk.skill) overlap_skills
       from pairs p join pk on pk.posting_id = p.posting_id join uk on uk.user_id = p.user_id and uk.skill = pk.skill
       group by 1, 2),
ms as (select p.user_id, p.posting_id, string_agg(pk.skill, ', ' order by pk.skill) missing_skills
       from pairs p join pk on pk.posting_id = p.posting_id
       left join uk on uk.user_id = p.user_id and uk.skill = pk.skill where uk.skill is null group by 1, 2),
nr as (select posting_id, count(*) n_required from pk group by 1),
rm as (select distinct p.user_id, p.posting_id from pairs p join fx_fact f on f.posting_id = p.posting_id
       join ur on ur.user_id = p.user_id and instr(lower(f.title), ur.role) > 0),
m as (select p.user_id, prof.email, p.posting_id, f.title, c.company_name, f.region, f.url,
             coalesce(ov.overlap_skills, '') overlap_skills, cast(coalesce(sk.n, 0) as integer) n_overlap,
             rm.user_id is not null role_match, coalesce(nr.n_required, 0) n_required,
             coalesce(ms.missing_skills, '') missing_skills
      from pairs p join fx_fact f on f.posting_id = p.posting_id join prof on prof.user_id = p.user_id
           left join fx_dim_company c on c.company_id = f.company_id
           left join sk on sk.user_id = p.user_id and sk.posting_id = p.posting_id
           left join ov on ov.user_id = p.user_id and ov.posting_id = p.posting_id
           left join ms on ms.user_id = p.user_id and ms.posting_id = p.posting_id
           left join nr on nr.posting_id = p.posting_id
           left join rm on rm.user_id = p.user_id and rm.posting_id = p.posting_id)
"""

_SCORE = ("case when n_required > 0 then cast(round_even(n_overlap::double / n_required * 100, 0) as integer) "
          "else 0 end")


# Every pair of a user and a posting would be millions of rows at sf 0.01; the registered
# queries summarise *all* pairs per user (counts, total text length, first / last text).
# The sums are taken once per signature and handed to its users, so the work grows with
# postings and signatures.  The full pair tables are compared with PAIR_SQL in the tests.
PAIR_SQL: dict[str, str] = {}


def summed(df: DataFrame, ints: list[str], texts: list[str], key: str = "user_id") -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("pairs")]
    for c in ints:
        aggs.append(F.sum(F.col(c).cast("bigint")).alias(f"sum_{c}"))
    for c in texts:
        aggs += [F.sum(F.length(c)).cast("bigint").alias(f"len_{c}"), F.min(c).alias(f"min_{c}"),
                 F.max(c).alias(f"max_{c}")]
    return df.groupBy(key).agg(*aggs)


def per_user(pairs: DataFrame, members: DataFrame, ints: list[str], texts: list[str]) -> DataFrame:
    """Sums over a signature's pairs, for each of its users."""
    return matching.for_users(summed(pairs, ints, texts, "sig_id"), members.select("user_id", "sig_id"))


def per_user_sql(pairs_sql: str, ints: list[str], texts: list[str]) -> str:
    cols = ["count(*) pairs"] + [f"cast(sum({c}) as bigint) sum_{c}" for c in ints]
    for c in texts:
        cols += [f"cast(sum(length({c})) as bigint) len_{c}", f"min({c}) min_{c}", f"max({c}) max_{c}"]
    return f"select user_id, {', '.join(cols)} from ({pairs_sql.strip()}) pairs group by user_id"


def _matches(fx: Fixtures) -> tuple[DataFrame, DataFrame]:
    """(matches of the signatures, their users), both written once per session."""
    return fx.matches["matches"], fx.matches["members"]


PAIR_SQL["profile_match"] = _MATCH_CTE + """
select user_id, email, posting_id, title, n_overlap, overlap_skills, role_match from m"""


def _match_columns(m: DataFrame) -> DataFrame:
    return m.select("sig_id", "posting_id", "title", F.size("overlap").alias("n_overlap"),
                    F.array_join("overlap", ", ").alias("overlap_skills"), "role_match")


def profile_match_pairs(fx: Fixtures) -> DataFrame:
    m, members = _matches(fx)
    return matching.for_users(_match_columns(m), members)


@register("profile_match", _MATCH_CTE + """
select user_id, count(*) pairs, cast(sum(n_overlap) as bigint) sum_n_overlap,
       count(*) filter (where n_overlap >= 2) skill_pairs, count(*) filter (where role_match) role_pairs,
       cast(sum(length(overlap_skills)) as bigint) len_overlap_skills, min(posting_id) min_posting_id,
       max(posting_id) max_posting_id, min(email) email
from m group by user_id""")
def q_profile_match(fx: Fixtures) -> DataFrame:
    m, members = _matches(fx)
    return matching.for_users(_match_columns(m).groupBy("sig_id").agg(
        F.count(F.lit(1)).alias("pairs"), F.sum(F.col("n_overlap").cast("bigint")).alias("sum_n_overlap"),
        F.count_if(F.col("n_overlap") >= 2).alias("skill_pairs"), F.count_if("role_match").alias("role_pairs"),
        F.sum(F.length("overlap_skills")).cast("bigint").alias("len_overlap_skills"),
        F.min("posting_id").alias("min_posting_id"), F.max("posting_id").alias("max_posting_id")), members)


PAIR_SQL["match_score"] = _MATCH_CTE + f"""
select user_id, posting_id, overlap_skills matched_skills, missing_skills, {_SCORE} match_score from m"""


def _score_columns(m: DataFrame) -> DataFrame:
    return matching.match_score(m).select(
        "sig_id", "posting_id", F.array_join("matched_skills", ", ").alias("matched_skills"),
        F.array_join("missing_skills", ", ").alias("missing_skills"), "match_score")


def match_score_pairs(fx: Fixtures) -> DataFrame:
    m, members = _matches(fx)
    return matching.for_users(_score_columns(m), members.select("user_id", "sig_id"))


@register("match_score", per_user_sql(PAIR_SQL["match_score"], ["match_score"], ["matched_skills", "missing_skills"]))
def q_match_score(fx: Fixtures) -> DataFrame:
    m, members = _matches(fx)
    return per_user(_score_columns(m), members, ["match_score"], ["matched_skills", "missing_skills"])


PAIR_SQL["match_report"] = _MATCH_CTE + f"""
select user_id, posting_id,
       'Match score: ' || cast({_SCORE} as varchar)
       || '% for ''' || coalesce(title, 'None') || ''' at ' || coalesce(company_name, 'None') || '.' || chr(10)
       || 'You have: ' || case when overlap_skills = '' then 'none of the listed skills' else overlap_skills end
       || '.' || chr(10) || 'Gaps: '
       || case when missing_skills = '' then 'none — strong match' else missing_skills end || '.' report
from m"""


def match_report_pairs(fx: Fixtures) -> DataFrame:
    m, members = _matches(fx)
    return matching.for_users(matching.match_report(matching.match_score(m)), members.select("user_id", "sig_id"))


@register("match_report", per_user_sql(PAIR_SQL["match_report"], [], ["report"]))
def q_match_report(fx: Fixtures) -> DataFrame:
    m, members = _matches(fx)
    return per_user(matching.match_report(matching.match_score(m)), members, [], ["report"])


PAIR_SQL["notification_text"] = _MATCH_CTE + """
select user_id, posting_id, 'New match: ' || coalesce(title, 'None') title,
       coalesce(title, 'None') || ' at ' || coalesce(company_name, 'None') || ' · ' || coalesce(region, 'None')
       || ' · Matching skills: ' || case when overlap_skills = '' then '(matched on role title)' else overlap_skills end body,
       url link, 'job_match' kind
from m"""
NOTIFY_INTS: list[str] = []
NOTIFY_TEXTS = ["title", "body", "kind"]


def notification_pairs(fx: Fixtures) -> DataFrame:
    m, members = _matches(fx)
    return matching.for_users(matching.notification_rows(m), members.select("user_id", "sig_id"))


@register("notification_text", per_user_sql(PAIR_SQL["notification_text"], NOTIFY_INTS, NOTIFY_TEXTS))
def q_notification_text(fx: Fixtures) -> DataFrame:
    m, members = _matches(fx)
    return per_user(matching.notification_rows(m), members, NOTIFY_INTS, NOTIFY_TEXTS)


@register("pending_profiles", """
select user_id, skills, target_roles, countries from fx_profile where skills is not null and skills <> ''""")
def q_pending_profiles(fx: Fixtures) -> DataFrame:
    return matching.pending_profiles(fx.profiles)


@register("profile_users", """
select p.user_id, p.skills, p.target_roles, p.countries, c.c_name email from fx_profile p
join customer c on c.c_custkey = p.user_id where p.skills is not null and p.skills <> ''""")
def q_profile_users(fx: Fixtures) -> DataFrame:
    return matching.profile_users(fx.profiles, fx.users)


@register("csv_list", """
select user_id,
       array_to_string(list_filter(list_transform(string_split(coalesce(skills, ''), ','), lambda x: lower(trim(x))),
                                   lambda x: x <> ''), '|') skills_list
from fx_profile""")
def q_csv_list(fx: Fixtures) -> DataFrame:
    return fx.profiles.select("user_id", F.array_join(csv_list("skills"), "|").alias("skills_list"))


@register("list_to_csv", """
select user_id,
       nullif(array_to_string(list_filter(list_transform(string_split(skills, ','), lambda x: trim(x)), lambda x: x <> ''), ', '), '')
         skills_csv,
       nullif(array_to_string(list_filter(list_transform(string_split(countries, ','), lambda x: lower(trim(x))), lambda x: x <> ''), ','), '')
         countries_csv
from fx_profile""")
def q_list_to_csv(fx: Fixtures) -> DataFrame:
    lowered = F.transform(F.split("countries", ","), lambda x: F.lower(x))
    return fx.profiles.select("user_id", list_to_csv(F.split("skills", ",")).alias("skills_csv"),
                              list_to_csv(lowered, ",").alias("countries_csv"))


@register("search_terms", """
with t as (select 0 src, user_id, cast(i - 1 as integer) pos, trim(x) term
           from fx_profile, unnest(string_split(coalesce(target_roles, '') || ',', ',')) with ordinality as u(x, i)
           union all select 1, null, 0, 'Data Engineer' union all select 1, null, 1, 'ring'),
f as (select src, coalesce(user_id, 0) u, pos, term from t where length(term) between 3 and 40)
select arg_min(term, (src, u, pos)) term, min(src) src, arg_min(u, (src, u, pos)) user_id,
       arg_min(pos, (src, u, pos)) pos
from f group by lower(term)""")
def q_search_terms(fx: Fixtures) -> DataFrame:
    return matching.search_terms(fx.profiles, ["Data Engineer", "ring"])


@register("country_codes", """
select distinct code from (select lower(trim(x)) code from fx_profile, unnest(string_split(coalesce(countries, ''), ',')) t(x)
                           union all select 'de') q where length(code) = 2 order by code""")
def q_country_codes(fx: Fixtures) -> DataFrame:
    return matching.country_codes(fx.profiles, ["DE"])


NOTIFIED_BEFORE = "2024-01-15 00:00:00"


@register("notify_once", f"""
select user_id, posting_id, notification_id, is_read, created_at from (
  select *, row_number() over (partition by user_id, posting_id order by created_at, notification_id) rn
  from fx_notification n
  where not exists (select 1 from fx_notification h where h.created_at < timestamp '{NOTIFIED_BEFORE}'
                    and h.user_id = n.user_id and h.posting_id = n.posting_id)) q where rn = 1""")
def q_notify_once(fx: Fixtures) -> DataFrame:
    """Pairs notified before the instant are the history; all notifications arrive (again)."""
    known = fx.notifications.where(F.col("created_at") < F.lit(NOTIFIED_BEFORE).cast("timestamp_ntz"))
    return matching.notify_once(fx.notifications, known).select("user_id", "posting_id", "notification_id",
                                                          "is_read", "created_at")
