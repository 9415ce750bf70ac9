"""Ranked, filtered, paginated job search over the star schema.

A ``SearchSpec`` becomes a conjunction of ``Column`` predicates on the fact table (pushed
into the scan by Catalyst), an EXISTS on the bridge expressed as a left-semi join, and
optional rank keys.  The per-posting skill-match count is pre-aggregated on the bridge
(one row per posting) and left-joined, instead of a correlated subquery per row.

Top-k: ``orderBy(...).limit(k)`` plans as ``TakeOrderedAndProject`` (each task keeps its
own k best, the driver merges k × tasks rows) — never a global sort.  The company-name
join runs *after* the top-k, on at most ``offset + limit`` rows.

Paging: ``search_after`` takes the rank keys of the last row seen and filters for the rows
behind them, so page 1,000 costs what page 1 does.  ``search_seek`` serves a plain offset far
down: counts per rank key, level by level, tell on which key the page starts; rows before it
are filtered out and only the small rest of the offset is skipped in the top-k.
"""
from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laborlake.functions.lists import provenance_label

# --- fixed values (must equal the reference for identical results) -------------------
DEFAULT_LIMIT = 25
AGENT_LIMIT_CAP = 25
PAY_BAND_OPTIONS = ("above_market", "at_market", "below_market")
RELAXED_NOTE = ("No job TITLE matched '{q}', so the title filter was dropped and the "
                "remaining filters kept. These are the closest available postings — use them "
                "rather than searching again with different wording.")
# ---------------------------------------------------------------------------------------

#: Rows that a top-k may skip; an offset beyond is sought by counts first.
NEAR_OFFSET = 1_000
#: Width of the first salary steps of a seek, and characters of an id that one level looks at.
SALARY_STEP = 4_096
ID_STEP = 2

RESULT_COLUMNS = ["posting_id", "title", "company_name", "location", "region", "seniority",
                  "remote", "salary", "posted_month", "predicted_salary", "salary_vs_market",
                  "pay_band", "is_real", "source", "url", "region_match", "skill_matches"]


@dataclass(frozen=True)
class SearchSpec:
    q: str | None = None
    skill: str | None = None
    region: str | None = None
    seniority: str | None = None
    remote_only: bool = False
    min_salary: int | None = None
    pay_band: str | None = None
    source_type: str | None = None          # "real" | "synthetic" | None
    prioritize_regions: str | None = None   # comma list, ranks only
    prioritize_skills: str | None = None    # comma list, ranks only
    limit: int = DEFAULT_LIMIT
    offset: int = 0


def _items(text: str | None) -> list[str]:
    return [s.strip() for s in (text or "").split(",") if s.strip()]


def skill_postings(bridge: DataFrame, dim_skill: DataFrame, names: list[str]) -> DataFrame:
    """(posting_id, skill_id) rows of the bridge whose skill name is in ``names``.
    A skill's key is the hash of its name, so the names become key literals: the filter is
    pushed to the bridge's scan and its bucketing stays, without a join on a hot skill."""
    return bridge.where(F.col("skill_id").isin([hashlib.md5(n.encode()).hexdigest() for n in names]))


def predicates(spec: SearchSpec) -> list[Column]:
    """Column predicates of the spec (empty / falsy values are 'off')."""
    p: list[Column] = []
    if spec.q:
        p.append(F.col("title").ilike(f"%{spec.q}%"))
    if spec.region:
        p.append(F.col("region") == spec.region)
    if spec.seniority:
        p.append(F.col("seniority") == spec.seniority)
    if spec.remote_only:
        p.append(F.col("remote") == F.lit(True))
    if spec.min_salary:
        p.append(F.col("salary") >= spec.min_salary)
    if spec.pay_band:
        p.append(F.col("pay_band") == spec.pay_band)
    if spec.source_type == "real":
        p.append(F.col("is_real") == F.lit(True))
    elif spec.source_type == "synthetic":
        p.append(F.col("is_real") == F.lit(False))
    return p


def search_filter(fact: DataFrame, bridge: DataFrame, dim_skill: DataFrame, spec: SearchSpec) -> DataFrame:
    out = fact
    for cond in predicates(spec):
        out = out.filter(cond)
    if spec.skill:
        out = out.join(skill_postings(bridge, dim_skill, [spec.skill]).select("posting_id"),
                       "posting_id", "left_semi")
    return out


def search_total(fact: DataFrame, bridge: DataFrame, dim_skill: DataFrame, spec: SearchSpec) -> DataFrame:
    return search_filter(fact, bridge, dim_skill, spec).agg(F.count(F.lit(1)).alias("total"))


def region_match(regions: list[str]) -> Column:
    """``region = ANY(list)`` as 1/0 (NULL region → 0)."""
    return F.when(F.col("region").isin(regions), 1).otherwise(0)


def skill_match_counts(bridge: DataFrame, dim_skill: DataFrame, skills: list[str]) -> DataFrame:
    """(posting_id, skill_matches) for postings wanting at least one of ``skills``."""
    return (skill_postings(bridge, dim_skill, skills)
            .groupBy("posting_id").agg(F.count(F.lit(1)).alias("skill_matches")))


def with_rank_keys(filtered: DataFrame, bridge: DataFrame, dim_skill: DataFrame, spec: SearchSpec):
    """Add region_match / skill_matches (NULL when not requested) and the order keys."""
    order = [F.desc("is_real")]
    regions = _items(spec.prioritize_regions)
    if regions:
        filtered = filtered.withColumn("region_match", region_match(regions))
        order.append(F.desc("region_match"))
    else:
        filtered = filtered.withColumn("region_match", F.lit(None).cast("int"))
    skills = _items(spec.prioritize_skills)
    if skills:
        counts = skill_match_counts(bridge, dim_skill, skills)
        filtered = (filtered.join(counts, "posting_id", "left")
                            .withColumn("skill_matches", F.coalesce("skill_matches", F.lit(0)).cast("bigint")))
        order.append(F.desc("skill_matches"))
    else:
        filtered = filtered.withColumn("skill_matches", F.lit(None).cast("bigint"))
    order += [F.desc_nulls_last("salary"), F.asc("posting_id")]
    return filtered, order


def search_ranked(fact: DataFrame, bridge: DataFrame, dim_skill: DataFrame, dim_company: DataFrame,
                  spec: SearchSpec) -> DataFrame:
    """One page of results: filter → rank keys → top-(offset+limit) → company names."""
    filtered = search_filter(fact, bridge, dim_skill, spec)
    ranked, order = with_rank_keys(filtered, bridge, dim_skill, spec)
    page = ranked.orderBy(*order)
    if spec.offset:
        page = page.offset(spec.offset)
    page = page.limit(spec.limit)
    return with_company_names(page, dim_company).select(*RESULT_COLUMNS).orderBy(*order)


def rank_keys(spec: SearchSpec) -> list[tuple[str, bool]]:
    """(column, descending) of the spec's order; a descending key has its NULLs last."""
    return [("is_real", True), *[("region_match", True)] * bool(_items(spec.prioritize_regions)),
            *[("skill_matches", True)] * bool(_items(spec.prioritize_skills)), ("salary", True), ("posting_id", False)]


def behind(levels: list[tuple[Column, bool, object]], last: bool = False) -> Column:
    """Rows that come after the values of ``levels`` (key, descending, value) in their order, or
    at them where ``last``.  Nested, so that a row is compared on its first differing key."""
    if not levels:
        return F.lit(last)
    (key, descending, value), rest = levels[0], levels[1:]
    if value is None:
        after = F.lit(False) if descending else key.isNotNull()
    elif descending:
        after = (key < F.lit(value)) | key.isNull()
    else:
        after = key > F.lit(value)
    return after | (key.eqNullSafe(F.lit(value)) & behind(rest, last))


def page_cursor(page: DataFrame, spec: SearchSpec) -> dict | None:
    """The rank keys of a page's last row, None for an empty page (a page has ``limit`` rows at most)."""
    rows = page.select(*[k for k, _ in rank_keys(spec)]).collect()
    return rows[-1].asDict() if rows else None


def search_after(fact: DataFrame, bridge: DataFrame, dim_skill: DataFrame, dim_company: DataFrame,
                 spec: SearchSpec, cursor: dict) -> DataFrame:
    """The page behind ``cursor``: the rows after it, then the top-k; nothing is skipped or counted."""
    ranked, order = with_rank_keys(search_filter(fact, bridge, dim_skill, spec), bridge, dim_skill, spec)
    rest = ranked.where(behind([(F.col(k), desc, cursor[k]) for k, desc in rank_keys(spec)]))
    return with_company_names(rest.orderBy(*order).limit(spec.limit), dim_company).select(*RESULT_COLUMNS).orderBy(*order)


def _seek_levels(spec: SearchSpec, id_length: int) -> list[tuple[Column, bool]]:
    """The rank keys cut into steps with few values each: a salary by its thousands, then itself,
    and an id by two characters at a time."""
    levels = [(F.col(k), desc) for k, desc in rank_keys(spec) if k not in ("salary", "posting_id")]
    levels += [(F.floor(F.col("salary") / SALARY_STEP), True), (F.col("salary"), True)]
    return levels + [(F.substring("posting_id", at, ID_STEP), False) for at in range(1, id_length + 1, ID_STEP)]


def seek(ranked: DataFrame, levels: list[tuple[Column, bool]], offset: int, near: int) -> tuple[Column, int]:
    """(rows from the start of the page's key on, how many of them the offset still skips).

    Each level counts the rows of the key found so far by its next part, in one aggregate with
    partial counts; only these counts reach the driver.  The search ends as soon as what is left
    to skip is small, mostly after one or two levels."""
    found: list[tuple[Column, bool, object]] = []
    inside = F.lit(True)
    for key, descending in levels:
        if offset <= near:
            break
        counts = ranked.where(inside).groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()
        counts.sort(key=lambda r: (r["k"] is not None, r["k"]) if r["k"] is not None else (False,), reverse=descending)
        for r in counts:
            if offset < r["n"]:
                break
            offset -= r["n"]
        else:
            return F.lit(False), 0
        found.append((key, descending, r["k"]))
        inside = inside & key.eqNullSafe(F.lit(r["k"]))
    return behind(found, last=True), offset


def search_seek(fact: DataFrame, bridge: DataFrame, dim_skill: DataFrame, dim_company: DataFrame,
                spec: SearchSpec, near: int = NEAR_OFFSET) -> DataFrame:
    """The page at a plain offset, however far down: equal to ``search_ranked``, but no task and
    no driver keeps more than ``near + limit`` rows for it."""
    if spec.offset <= near:
        return search_ranked(fact, bridge, dim_skill, dim_company, spec)
    ranked, order = with_rank_keys(search_filter(fact, bridge, dim_skill, spec), bridge, dim_skill, spec)
    id_length = ranked.agg(F.max(F.length("posting_id"))).first()[0] or 0
    rest, skip = seek(ranked, _seek_levels(spec, id_length), spec.offset, near)
    page = ranked.where(rest).orderBy(*order).offset(skip).limit(spec.limit)
    return with_company_names(page, dim_company).select(*RESULT_COLUMNS).orderBy(*order)


def with_company_names(page: DataFrame, dim_company: DataFrame) -> DataFrame:
    """Company names for a result page.  The wide fact already carries the name; for a
    narrow fact, the dimension is first cut to the page's ids with a semi join; the page's
    measured size decides whether either join broadcasts."""
    if "company_name" in page.columns:
        return page
    ids = page.select("company_id").filter(F.col("company_id").isNotNull())
    names = dim_company.select("company_id", "company_name").join(ids, "company_id", "left_semi")
    return page.join(names, "company_id", "left")


def search_relaxed(fact: DataFrame, bridge: DataFrame, dim_skill: DataFrame, dim_company: DataFrame,
                   spec: SearchSpec, include_sample_postings: bool = False) -> DataFrame:
    """Agent search: real postings unless asked, at most 25 rows; when the strict search
    is empty and ``q`` was given, drop ``q`` only and attach a note.

    strict ∪ (relaxed where NOT EXISTS strict): both branches are lazy plans and the
    emptiness test is an EXISTS subquery, not a driver-side count."""
    spec = replace(spec, limit=min(spec.limit, AGENT_LIMIT_CAP),
                   source_type=spec.source_type if include_sample_postings else "real")
    strict = search_ranked(fact, bridge, dim_skill, dim_company, spec) \
        .withColumn("note", F.lit(None).cast("string"))
    if not spec.q:
        return strict
    strict_any = search_filter(fact, bridge, dim_skill, spec).select("posting_id")
    relaxed = (search_ranked(fact, bridge, dim_skill, dim_company, replace(spec, q=None))
               .filter(~strict_any.exists())
               .withColumn("note", F.lit(RELAXED_NOTE.format(q=spec.q))))
    order = [F.desc("is_real"), F.desc("region_match"), F.desc("skill_matches"), F.desc_nulls_last("salary"), "posting_id"]
    return strict.unionByName(relaxed).orderBy(*order)


def job_details(fact: DataFrame, bridge: DataFrame, dim_skill: DataFrame, dim_company: DataFrame) -> DataFrame:
    """Every posting with company name and its sorted skill list (one row per posting;
    the skill list is bounded by the posting's own tags)."""
    skills = (bridge.join(dim_skill.select("skill_id", "skill_name"), "skill_id")
                    .groupBy("posting_id")
                    .agg(F.sort_array(F.collect_list("skill_name")).alias("required_skills")))
    if "company_name" not in fact.columns:
        fact = fact.join(dim_company.select("company_id", "company_name"), "company_id", "left")
    return (fact.join(skills, "posting_id", "left")
                .withColumn("required_skills",
                            F.coalesce("required_skills", F.array().cast("array<string>"))))


def job_lookup(fact, bridge, dim_skill, dim_company, posting_id: str | Column) -> DataFrame:
    """One posting (filter pushed to the scan); empty frame = not found."""
    one = fact.filter(F.col("posting_id") == posting_id)
    return job_details(one, bridge.filter(F.col("posting_id") == posting_id), dim_skill, dim_company)


def filter_options(fact: DataFrame, dim_skill: DataFrame) -> DataFrame:
    """The filter choices as rows (option, value, n): skills with their popularity,
    distinct non-NULL regions and seniorities, the fixed pay bands and the real /
    synthetic counts.  Consumers order by (option, n desc, value)."""
    spark = fact.sparkSession
    skills = dim_skill.select(F.lit("skill").alias("option"), F.col("skill_name").alias("value"),
                              F.col("posting_count").alias("n"))
    regions = (fact.filter(F.col("region").isNotNull()).select("region").distinct()
                   .select(F.lit("region").alias("option"), F.col("region").alias("value"),
                           F.lit(None).cast("bigint").alias("n")))
    seniorities = (fact.filter(F.col("seniority").isNotNull()).select("seniority").distinct()
                       .select(F.lit("seniority").alias("option"), F.col("seniority").alias("value"),
                               F.lit(None).cast("bigint").alias("n")))
    bands = spark.createDataFrame([(b,) for b in PAY_BAND_OPTIONS], "value string") \
        .select(F.lit("pay_band").alias("option"), "value", F.lit(None).cast("bigint").alias("n"))
    sources = (fact.groupBy(provenance_label("is_real").alias("value"))
                   .agg(F.count(F.lit(1)).alias("n"))
                   .select(F.lit("source").alias("option"), "value", "n"))
    return skills.unionByName(regions).unionByName(seniorities).unionByName(bands).unionByName(sources)


def topk_skills(dim_skill: DataFrame, limit: int) -> DataFrame:
    return (dim_skill.select("skill_name", "posting_count")
                     .orderBy(F.desc("posting_count"), F.asc("skill_name")).limit(limit))
