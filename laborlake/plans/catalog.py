"""Query catalog, part 1: analytics, ETL, star schema, search, data quality.

Every query reads the whole driver tables (through ``Fixtures``) so its work grows with
the data.  Column names are aliased identically in the DataFrame code and the SQL.
"""
from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlake.operators import analytics, etl, quality, search
from laborlake.operators.star import Star
from laborlake.plans.registry import REGISTRY, QueryFn, register  # noqa: F401
from laborlake.sources.fixtures import Fixtures


def raw_postings(fx: Fixtures) -> DataFrame:
    """Postings in the raw landing shape: mixed salary text, repeated ids."""
    return fx.raw


def cleaned_postings(fx: Fixtures) -> DataFrame:
    return etl.clean_postings(raw_postings(fx))


# ---------------------------------------------------------------- serving analytics
@register("skill_premium", """
select skill_name, postings, avg_salary, premium_vs_average from (
  select d.skill_name, count(x.salary) postings, round(avg(x.salary)) avg_salary,
         round(avg(x.salary) - any_value(m.level)) premium_vs_average
  from fx_dim_skill d
  inner join fx_bridge l using (skill_id)
  inner join (select posting_id, salary from fx_fact where is_real and salary is not null) x using (posting_id)
  cross join (select avg(salary) as level from fx_fact
              where is_real and salary is not null and posting_id in (select posting_id from fx_bridge)) m
  group by d.skill_name) t
where postings >= 15 order by avg_salary desc, skill_name limit 15""")
def q_skill_premium(fx: Fixtures) -> DataFrame:
    return analytics.skill_premium(fx.fact, fx.bridge, fx.dim_skill)


@register("market_overview", """
with live as (select * from fx_fact where is_real),
     known as (select distinct skill_id from fx_bridge semi join live using (posting_id))
select (select count(*) from live) total_postings, (select count(distinct company_id) from live) total_companies,
       (select round(avg(salary)) from live) avg_salary,
       (select round(100.0 * avg(coalesce(remote, false)::int), 1) from live) remote_percent,
       (select count(*) from known) total_skills""")
def q_market_overview(fx: Fixtures) -> DataFrame:
    return analytics.market_overview(fx.fact, fx.bridge)


@register("top_skills", """
with per_skill as (select skill_id, count(*) posting_count from fx_bridge
                   where posting_id in (select posting_id from fx_fact where is_real) group by skill_id)
select skill_name, posting_count from per_skill natural join (select skill_id, skill_name from fx_dim_skill)
order by posting_count desc, skill_name limit 15""")
def q_top_skills(fx: Fixtures) -> DataFrame:
    return analytics.top_skills(fx.fact, fx.bridge, fx.dim_skill)


@register("salary_by_seniority", """
select seniority, round(avg(salary)) avg_salary, count(*) postings from fx_fact
where salary is not null and is_real group by seniority order by avg_salary, seniority""")
def q_salary_by_seniority(fx: Fixtures) -> DataFrame:
    return analytics.salary_by_seniority(fx.fact)


@register("salary_by_region", """
select region, round(avg(salary)) avg_salary, count(*) postings from fx_fact
where salary is not null and is_real group by region order by avg_salary desc, region""")
def q_salary_by_region(fx: Fixtures) -> DataFrame:
    return analytics.salary_by_region(fx.fact)


@register("postings_by_month", """
select posted_month, count(*) postings from fx_fact
where posted_month is not null and is_real group by posted_month order by posted_month""")
def q_postings_by_month(fx: Fixtures) -> DataFrame:
    return analytics.postings_by_month(fx.fact)


@register("salary_distribution", """
select case when salary < 0 then -25000 when salary >= 250000 then 250000
            else cast(floor(salary / 25000) as bigint) * 25000 end bucket_start,
       count(*) postings
from fx_fact where salary is not null and is_real group by 1 order by 1""")
def q_salary_distribution(fx: Fixtures) -> DataFrame:
    return analytics.salary_distribution(fx.fact)


@register("source_counts", """
select case when is_real then 'real' else 'synthetic' end kind, count(*) n from fx_fact group by 1 order by 1""")
def q_source_counts(fx: Fixtures) -> DataFrame:
    return analytics.source_counts(fx.fact)


@register("pay_band_distribution", """
select pay_band, count(*) "count" from fx_score group by pay_band order by "count" desc, pay_band""")
def q_pay_band_distribution(fx: Fixtures) -> DataFrame:
    return analytics.pay_band_distribution(fx.scores)


@register("pay_band", """
select p.posting_id, p.salary - 250000 salary_vs_market,
       case when p.salary is null then 'unknown' when p.salary - 250000 > 10000 then 'above_market'
            when p.salary - 250000 < -10000 then 'below_market' else 'at_market' end pay_band
from fx_posting p""")
def q_pay_band(fx: Fixtures) -> DataFrame:
    from laborlake.functions.salary import pay_band
    vs = F.col("salary") - F.lit(250000)
    return fx.posting.select("posting_id", vs.alias("salary_vs_market"),
                             F.when(F.col("salary").isNull(), F.lit("unknown")).otherwise(pay_band(vs)).alias("pay_band"))


# ---------------------------------------------------------------- batch ETL
@register("skill_demand", """
select skill, count(*) "count" from fx_clean_skill group by skill order by "count" desc, skill""")
def q_skill_demand(fx: Fixtures) -> DataFrame:
    clean_ids = cleaned_postings(fx).select("posting_id")
    return etl.skill_demand(fx.posting_skill.join(clean_ids, "posting_id", "left_semi"))


@register("batch_salary_by_seniority", """
select seniority, round(avg(salary_clean)) avg_salary, quantile_disc(salary_clean, 0.5) median_salary,
       count(*) postings from fx_clean group by seniority order by seniority""")
def q_batch_salary_by_seniority(fx: Fixtures) -> DataFrame:
    return etl.batch_salary_by_seniority(cleaned_postings(fx))


@register("batch_postings_by_month", """
select posted_month, count(*) "count" from fx_clean group by posted_month order by posted_month nulls first""")
def q_batch_postings_by_month(fx: Fixtures) -> DataFrame:
    return etl.batch_postings_by_month(cleaned_postings(fx))


@register("batch_salary_by_region", """
select region, round(avg(salary_clean)) avg_salary, count(*) postings from fx_clean
group by region order by avg_salary desc, region""")
def q_batch_salary_by_region(fx: Fixtures) -> DataFrame:
    return etl.batch_salary_by_region(cleaned_postings(fx))


@register("clean_salary", """
select posting_id, salary_raw,
       case when regexp_extract(regexp_replace(salary_raw, '[^0-9.]', '', 'g'), '^([0-9]+)', 1) = '' then null
            else try_cast(regexp_extract(regexp_replace(salary_raw, '[^0-9.]', '', 'g'), '^([0-9]+)', 1) as bigint)
       end salary_clean
from fx_posting""")
def q_clean_salary(fx: Fixtures) -> DataFrame:
    from laborlake.functions.salary import clean_salary
    return fx.posting.select("posting_id", "salary_raw", clean_salary("salary_raw").alias("salary_clean"))


@register("etl_audit", """
select (select count(*) from fx_raw) raw_rows, (select count(*) from fx_clean) clean_rows,
       (select count(*) from fx_raw) - (select count(*) from fx_clean) removed_rows""")
def q_etl_audit(fx: Fixtures) -> DataFrame:
    raw = raw_postings(fx)
    return etl.etl_audit(raw, etl.clean_postings(raw))


# ---------------------------------------------------------------- star schema
@register("dim_company", "select company_id, company_name from fx_dim_company")
def q_dim_company(fx: Fixtures) -> DataFrame:
    return fx.dim_company


@register("dim_skill", "select skill_id, skill_name, posting_count from fx_dim_skill")
def q_dim_skill(fx: Fixtures) -> DataFrame:
    return fx.dim_skill


@register("bridge_build", "select posting_id, skill_id from fx_bridge")
def q_bridge_build(fx: Fixtures) -> DataFrame:
    return fx.bridge


@register("fact_scores", """
select posting_id, company_id, title, location, region, seniority, remote, salary, posted_month, is_real,
       predicted_salary, salary_vs_market, pay_band from fx_fact""")
def q_fact_scores(fx: Fixtures) -> DataFrame:
    return fx.fact.drop("source", "url")


@register("stg_postings", """
select posting_id, title, company company_name, location, region, seniority, remote, salary_clean salary,
       posted_month, coalesce(lower(cast(is_real as varchar)) in ('true', 't', '1'), false) is_real,
       cast(null as varchar) source, cast(null as varchar) url
from fx_clean where posting_id is not null""")
def q_stg_postings(fx: Fixtures) -> DataFrame:
    from laborlake.operators.star import stage_postings
    return stage_postings(cleaned_postings(fx))


@register("fact_company", """
select f.posting_id, c.company_id from fx_posting f left join fx_dim_company c on c.company_name = f.company_name
where f.title is not null""")
def q_fact_company(fx: Fixtures) -> DataFrame:
    return fx.fact.select("posting_id", "company_id")


@register("star_join", """
select b.posting_id, s.skill_name, f.salary, f.is_real
from fx_bridge b join fx_dim_skill s on s.skill_id = b.skill_id join fx_fact f on f.posting_id = b.posting_id""")
def q_star_join(fx: Fixtures) -> DataFrame:
    from laborlake.operators.star import bridge_skill_names
    return (bridge_skill_names(fx.bridge, fx.dim_skill)
            .join(fx.fact.select("posting_id", "salary", "is_real"), "posting_id")
            .select("posting_id", "skill_name", "salary", "is_real"))


@register("scalar_baseline", """
select round(avg(salary), 4) baseline from (select distinct f.posting_id, f.salary from fx_fact f
  join fx_bridge b on b.posting_id = f.posting_id where f.salary is not null and f.is_real) q""")
def q_scalar_baseline(fx: Fixtures) -> DataFrame:
    scoped = analytics.real_salaried(fx.fact).select("posting_id", "salary") \
        .join(fx.bridge.select("posting_id"), "posting_id", "left_semi")
    return scoped.agg(F.round(F.avg("salary"), 4).alias("baseline"))


# ---------------------------------------------------------------- search family
FILTER_SPEC = search.SearchSpec(q="ring", remote_only=True, min_salary=150000, source_type="real",
                                skill="Brand#13")
RANK_SPEC = search.SearchSpec(seniority="senior", prioritize_regions="ASIA, EUROPE",
                              prioritize_skills="Brand#1,Brand#7", limit=25)
RELAX_SPEC = search.SearchSpec(q="no-such-title-xyz", seniority="senior", limit=10)

_FILTER_SQL = """f.title ilike '%ring%' and f.remote = true and f.salary >= 150000 and f.is_real = true
  and exists (select 1 from fx_bridge b join fx_dim_skill s on s.skill_id = b.skill_id
              where b.posting_id = f.posting_id and s.skill_name = 'Brand#13')"""
_RANK_SQL = """
with m as (select b.posting_id, count(*) n from fx_bridge b join fx_dim_skill s on s.skill_id = b.skill_id
           where s.skill_name in ('Brand#1', 'Brand#7') group by b.posting_id),
r as (select f.*, case when f.region in ('ASIA', 'EUROPE') then 1 else 0 end region_match,
             coalesce(m.n, 0) skill_matches
      from fx_fact f left join m on m.posting_id = f.posting_id where f.seniority = 'senior')
select r.posting_id, r.title, c.company_name, r.location, r.region, r.seniority, r.remote, r.salary,
       r.posted_month, r.predicted_salary, r.salary_vs_market, r.pay_band, r.is_real, r.source, r.url,
       r.region_match, r.skill_matches
from r left join fx_dim_company c on c.company_id = r.company_id
order by r.is_real desc, r.region_match desc, r.skill_matches desc, r.salary desc nulls last, r.posting_id
limit 25 offset {offset}"""


def _star(fx: Fixtures):
    return fx.fact, fx.bridge, fx.dim_skill


@register("search_filter", f"""
select f.posting_id, f.title, f.region, f.seniority, f.remote, f.salary, f.pay_band, f.is_real
from fx_fact f where {_FILTER_SQL}""")
def q_search_filter(fx: Fixtures) -> DataFrame:
    return search.search_filter(*_star(fx), FILTER_SPEC).select(
        "posting_id", "title", "region", "seniority", "remote", "salary", "pay_band", "is_real")


@register("search_total", f"select count(*) total from fx_fact f where {_FILTER_SQL}")
def q_search_total(fx: Fixtures) -> DataFrame:
    return search.search_total(*_star(fx), FILTER_SPEC)


@register("search_ranked", _RANK_SQL.format(offset=0))
def q_search_ranked(fx: Fixtures) -> DataFrame:
    return search.search_ranked(fx.fact_wide, fx.bridge, fx.dim_skill, fx.dim_company, RANK_SPEC)


@register("search_page", _RANK_SQL.format(offset=50))
def q_search_page(fx: Fixtures) -> DataFrame:
    return search.search_ranked(fx.fact_wide, fx.bridge, fx.dim_skill, fx.dim_company,
                                replace(RANK_SPEC, offset=50))


@register("search_after", _RANK_SQL.format(offset=25))
def q_search_after(fx: Fixtures) -> DataFrame:
    """The second page, from the last row of the first."""
    star = (fx.fact_wide, fx.bridge, fx.dim_skill, fx.dim_company)
    cursor = search.page_cursor(search.search_ranked(*star, RANK_SPEC), RANK_SPEC)
    return search.search_after(*star, RANK_SPEC, cursor) if cursor else search.search_ranked(*star, replace(RANK_SPEC, offset=25))


@register("search_seek", """
select f.posting_id, f.title, c.company_name, f.location, f.region, f.seniority, f.remote, f.salary,
       f.posted_month, f.predicted_salary, f.salary_vs_market, f.pay_band, f.is_real, f.source, f.url,
       cast(null as integer) region_match, cast(null as bigint) skill_matches
from fx_fact f left join fx_dim_company c on c.company_id = f.company_id
order by f.is_real desc, f.salary desc nulls last, f.posting_id limit 25 offset 1200""")
def q_search_seek(fx: Fixtures) -> DataFrame:
    """A page far down the list of all postings."""
    return search.search_seek(fx.fact_wide, fx.bridge, fx.dim_skill, fx.dim_company, search.SearchSpec(offset=1200))


@register("search_relaxed", """
select f.posting_id, f.title, c.company_name, f.location, f.region, f.seniority, f.remote, f.salary,
       f.posted_month, f.predicted_salary, f.salary_vs_market, f.pay_band, f.is_real, f.source, f.url,
       cast(null as integer) region_match, cast(null as bigint) skill_matches,
       'No job TITLE matched ''no-such-title-xyz'', so the title filter was dropped and the remaining filters '
       || 'kept. These are the closest available postings — use them rather than searching again with '
       || 'different wording.' note
from fx_fact f left join fx_dim_company c on c.company_id = f.company_id
where f.seniority = 'senior' and f.is_real = true
  and not exists (select 1 from fx_fact g where g.title ilike '%no-such-title-xyz%' and g.seniority = 'senior'
                  and g.is_real = true)
order by f.is_real desc, f.salary desc nulls last, f.posting_id limit 10""")
def q_search_relaxed(fx: Fixtures) -> DataFrame:
    return search.search_relaxed(fx.fact_wide, fx.bridge, fx.dim_skill, fx.dim_company, RELAX_SPEC)


@register("search_relaxed_strict", """
select f.posting_id, f.title, c.company_name, f.location, f.region, f.seniority, f.remote, f.salary,
       f.posted_month, f.predicted_salary, f.salary_vs_market, f.pay_band, f.is_real, f.source, f.url,
       cast(null as integer) region_match, cast(null as bigint) skill_matches, cast(null as varchar) note
from fx_fact f left join fx_dim_company c on c.company_id = f.company_id
where f.seniority = 'senior' and f.is_real = true and f.title ilike '%ring%'
order by f.is_real desc, f.salary desc nulls last, f.posting_id limit 10""")
def q_search_relaxed_strict(fx: Fixtures) -> DataFrame:
    """A title that matches: the strict page, and no row of the relaxed one."""
    return search.search_relaxed(fx.fact_wide, fx.bridge, fx.dim_skill, fx.dim_company, replace(RELAX_SPEC, q="ring"))


@register("has_skill", """
select f.posting_id, f.title from fx_fact f
where exists (select 1 from fx_bridge b join fx_dim_skill s on s.skill_id = b.skill_id
              where b.posting_id = f.posting_id and s.skill_name = 'Brand#7')""")
def q_has_skill(fx: Fixtures) -> DataFrame:
    return search.search_filter(*_star(fx), search.SearchSpec(skill="Brand#7")).select("posting_id", "title")


@register("skill_matches", """
select f.posting_id, coalesce(m.n, 0) skill_matches from fx_fact f
left join (select b.posting_id, count(*) n from fx_bridge b join fx_dim_skill s on s.skill_id = b.skill_id
           where s.skill_name in ('Brand#1', 'Brand#7', 'Brand#13') group by b.posting_id) m
  on m.posting_id = f.posting_id""")
def q_skill_matches(fx: Fixtures) -> DataFrame:
    spec = search.SearchSpec(prioritize_skills="Brand#1, Brand#7, Brand#13")
    ranked, _ = search.with_rank_keys(fx.fact, fx.bridge, fx.dim_skill, spec)
    return ranked.select("posting_id", "skill_matches")


@register("any_membership", """
select posting_id, case when region in ('ASIA', 'AMERICA') then 1 else 0 end region_match from fx_fact""")
def q_any_membership(fx: Fixtures) -> DataFrame:
    return fx.fact.select("posting_id", search.region_match(["ASIA", "AMERICA"]).alias("region_match"))


@register("search_company", """
select f.posting_id, c.company_name from fx_fact f left join fx_dim_company c on c.company_id = f.company_id""")
def q_search_company(fx: Fixtures) -> DataFrame:
    return (fx.fact.join(fx.dim_company, "company_id", "left").select("posting_id", "company_name"))


@register("job_lookup", """
select f.posting_id, f.title, c.company_name, f.region, f.salary, f.pay_band,
       coalesce((select string_agg(s.skill_name, ',' order by s.skill_name) from fx_bridge b
                 join fx_dim_skill s on s.skill_id = b.skill_id where b.posting_id = f.posting_id), '') required_skills
from fx_fact f left join fx_dim_company c on c.company_id = f.company_id""")
def q_job_lookup(fx: Fixtures) -> DataFrame:
    d = search.job_details(fx.fact, fx.bridge, fx.dim_skill, fx.dim_company)
    return d.select("posting_id", "title", "company_name", "region", "salary", "pay_band",
                    F.array_join("required_skills", ",").alias("required_skills"))


@register("job_lookup_one", """
select f.posting_id, f.title, c.company_name, f.region, f.salary, f.pay_band,
       coalesce((select string_agg(s.skill_name, ',' order by s.skill_name) from fx_bridge b
                 join fx_dim_skill s on s.skill_id = b.skill_id where b.posting_id = f.posting_id), '') required_skills
from fx_fact f left join fx_dim_company c on c.company_id = f.company_id
where f.posting_id = (select max(posting_id) from fx_fact)""")
def q_job_lookup_one(fx: Fixtures) -> DataFrame:
    newest = fx.fact.agg(F.max("posting_id")).scalar()
    d = search.job_lookup(fx.fact_wide, fx.bridge, fx.dim_skill, fx.dim_company, newest)
    return d.select("posting_id", "title", "company_name", "region", "salary", "pay_band",
                    F.array_join("required_skills", ",").alias("required_skills"))


@register("filter_options", """
select 'skill' option, skill_name value, posting_count n from fx_dim_skill
union all select distinct 'region', region, cast(null as bigint) from fx_fact where region is not null
union all select distinct 'seniority', seniority, cast(null as bigint) from fx_fact where seniority is not null
union all select 'pay_band', v, cast(null as bigint) from (values ('above_market'), ('at_market'), ('below_market')) t(v)
union all select 'source', case when is_real then 'real' else 'synthetic' end, count(*) from fx_fact group by 2""")
def q_filter_options(fx: Fixtures) -> DataFrame:
    return search.filter_options(fx.fact, fx.dim_skill)


@register("distinct_values", """
select distinct 'region' option, region value from fx_fact where region is not null
union all select distinct 'seniority', seniority from fx_fact where seniority is not null""")
def q_distinct_values(fx: Fixtures) -> DataFrame:
    return search.filter_options(fx.fact, fx.dim_skill).filter(
        F.col("option").isin("region", "seniority")).select("option", "value")


@register("provenance_label", """
select posting_id, case when is_real then 'real' else 'synthetic' end kind from fx_fact""")
def q_provenance_label(fx: Fixtures) -> DataFrame:
    from laborlake.functions.lists import provenance_label
    return fx.fact.select("posting_id", provenance_label("is_real").alias("kind"))


@register("topk_skills", """
select skill_name, posting_count from fx_dim_skill order by posting_count desc, skill_name limit 10""")
def q_topk_skills(fx: Fixtures) -> DataFrame:
    return search.topk_skills(fx.dim_skill, 10)


# ---------------------------------------------------------------- data quality
_DQ = {
    "not_null": """
select 'not_null:stg_postings.posting_id' "check", 'not_null' kind, 'error' severity,
       count(*) filter (where posting_id is null) failures from fx_clean
union all select 'not_null:stg_postings.title', 'not_null', 'error', count(*) filter (where title is null) from fx_clean
union all select 'not_null:dim_company.company_id', 'not_null', 'error', count(*) filter (where company_id is null) from fx_dim_company
union all select 'not_null:dim_company.company_name', 'not_null', 'error', count(*) filter (where company_name is null) from fx_dim_company
union all select 'not_null:dim_skill.skill_id', 'not_null', 'error', count(*) filter (where skill_id is null) from fx_dim_skill
union all select 'not_null:dim_skill.skill_name', 'not_null', 'error', count(*) filter (where skill_name is null) from fx_dim_skill
union all select 'not_null:fact_job_posting.posting_id', 'not_null', 'error', count(*) filter (where posting_id is null) from fx_fact""",
    "unique": """
select 'unique:stg_postings.posting_id' "check", 'unique' kind, 'error' severity,
       (select count(*) from (select posting_id from fx_clean where posting_id is not null group by 1 having count(*) > 1)) failures
union all select 'unique:dim_company.company_id', 'unique', 'error',
       (select count(*) from (select company_id from fx_dim_company where company_id is not null group by 1 having count(*) > 1))
union all select 'unique:dim_skill.skill_id', 'unique', 'error',
       (select count(*) from (select skill_id from fx_dim_skill where skill_id is not null group by 1 having count(*) > 1))
union all select 'unique:dim_skill.skill_name', 'unique', 'error',
       (select count(*) from (select skill_name from fx_dim_skill where skill_name is not null group by 1 having count(*) > 1))
union all select 'unique:fact_job_posting.posting_id', 'unique', 'error',
       (select count(*) from (select posting_id from fx_fact where posting_id is not null group by 1 having count(*) > 1))""",
    "accepted_values": """
select 'accepted_values:stg_postings.seniority' "check", 'accepted_values' kind, 'error' severity,
       count(distinct case when seniority not in ('junior', 'mid', 'senior', 'unknown') then seniority end) failures
from fx_clean""",
    "relationships": """
select 'relationships:fact_job_posting.company_id' "check", 'relationships' kind, 'error' severity,
       (select count(*) from fx_fact f where f.company_id is not null
          and not exists (select 1 from fx_dim_company c where c.company_id = f.company_id)) failures
union all select 'relationships:bridge_posting_skill.posting_id', 'relationships', 'error',
       (select count(*) from fx_bridge b where b.posting_id is not null
          and not exists (select 1 from fx_fact f where f.posting_id = b.posting_id))
union all select 'relationships:bridge_posting_skill.skill_id', 'relationships', 'error',
       (select count(*) from fx_bridge b where b.skill_id is not null
          and not exists (select 1 from fx_dim_skill s where s.skill_id = b.skill_id))""",
    "accepted_range": """
select 'accepted_range:fact_job_posting.salary' "check", 'accepted_range' kind, 'warn' severity,
       count(*) filter (where salary is not null and (salary < 0 or salary > 2000000)) failures from fx_fact""",
}


def _dq(kind: str):
    def fn(fx: Fixtures) -> DataFrame:
        return quality.run_checks(fx.star, (kind,))
    return fn


for _kind, _sql in _DQ.items():
    register(f"dq_{_kind}", _sql)(_dq(_kind))


@register("dq_gate", "select *, case when failures = 0 then 'pass' when severity = 'warn' then 'warn' else 'fail' end status from ("
          + " union all ".join(f"({v.strip()})" for v in _DQ.values()) + ") t")
def q_dq_gate(fx: Fixtures) -> DataFrame:
    return quality.gate_summary(fx.star)


def planted_star(fx: Fixtures) -> Star:
    """The star with faults put into the rows of some postings: each kind of check meets some."""
    n = F.col("posting_id").cast("bigint")
    at = lambda k: n % 400 == k
    stg = fx.star.stg.withColumns({
        "title": F.when(~at(1), F.col("title")), "seniority": F.when(at(2), "guru").otherwise(F.col("seniority"))})
    fact = fx.fact.withColumns({
        "salary": F.when(at(3), F.lit(2500000)).when(at(4), F.lit(-1)).otherwise(F.col("salary")),
        "company_id": F.when(at(5), F.lit("nobody")).otherwise(F.col("company_id"))})
    fact = fact.where(~at(6)).unionByName(fact.where(at(7)))
    bridge = fx.bridge.withColumn("skill_id", F.when(at(8), F.lit("unheard of")).otherwise(F.col("skill_id")))
    return Star(stg=stg, dim_company=fx.dim_company, dim_skill=fx.dim_skill, fact=fact, bridge=bridge, fact_wide=fact)


@register("dq_quarantine", """
with f0 as (select posting_id, cast(posting_id as bigint) % 400 k, salary, company_id from fx_fact),
f1 as (select * from f0 where k <> 6 union all select * from f0 where k = 7),
b as (select posting_id, case when cast(posting_id as bigint) % 400 = 8 then 'unheard of' else skill_id end skill_id from fx_bridge)
select 'not_null:stg_postings.title' "check", 'error' severity, 'stg_postings' model, posting_id row_key, cast(null as varchar) "value"
from fx_clean where cast(posting_id as bigint) % 400 = 1
union all select 'accepted_values:stg_postings.seniority', 'error', 'stg_postings', posting_id, 'guru'
from fx_clean where cast(posting_id as bigint) % 400 = 2
union all select 'accepted_range:fact_job_posting.salary', 'warn', 'fact_job_posting', posting_id, case when k = 3 then '2500000' else '-1' end
from f1 where k in (3, 4)
union all select 'relationships:fact_job_posting.company_id', 'error', 'fact_job_posting', posting_id, 'nobody' from f1 where k = 5
union all select 'unique:fact_job_posting.posting_id', 'error', 'fact_job_posting', posting_id, posting_id from f1 where k = 7
union all select 'relationships:bridge_posting_skill.posting_id', 'error', 'bridge_posting_skill', posting_id || '|' || skill_id, posting_id
from b where cast(posting_id as bigint) % 400 = 6
union all select 'relationships:bridge_posting_skill.skill_id', 'error', 'bridge_posting_skill', posting_id || '|' || skill_id, skill_id
from b where cast(posting_id as bigint) % 400 = 8""")
def q_dq_quarantine(fx: Fixtures) -> DataFrame:
    """The rows that the gate would hold back, with the check that each fails."""
    return quality.offending_rows(planted_star(fx)).drop("row")


def queries() -> dict[str, QueryFn]:
    from laborlake.plans import load_all
    load_all()
    return {name: q.fn for name, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    from laborlake.plans import load_all
    load_all()
    return {name: q.sql for name, q in REGISTRY.items() if q.sql}
