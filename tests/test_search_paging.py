"""Pages by cursor and by sought offset against the whole sorted list; the exact median."""
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from laborlake.operators import etl, search


def _id(name):
    return hashlib.md5(name.encode()).hexdigest()


@pytest.fixture(scope="module")
def star(spark):
    """Many ties: a third of the rows without a salary, few salaries, skewed ranks, ids of unlike length."""
    rng = random.Random(11)
    skills = ["Brand#1", "Brand#7", "Brand#9"]
    facts, bridge = [], []
    for n in range(420):
        pid = f"{rng.choice('abB')}{n * 7919 % 1000:0{rng.choice([3, 4])}d}{n}"
        salary = None if n % 3 == 0 else rng.choice([50_000, 50_001, 54_000, 90_000, rng.randint(1, 300_000)])
        facts.append((pid, f"title {n}", _id(f"c{n % 5}") if n % 11 else None, f"c{n % 5}" if n % 11 else None, "here",
                      rng.choice(["ASIA", "EUROPE", None, "AFRICA"]), "senior", n % 2 == 0, salary, "2026-01", 1.0, 0.0,
                      "at_market", n % 5 != 0, "feed", None))
        bridge += [(pid, _id(s)) for s in skills if rng.random() < 0.3]
    fact = spark.createDataFrame(facts, "posting_id string, title string, company_id string, company_name string, location string, "
                                 "region string, seniority string, remote boolean, salary long, posted_month string, "
                                 "predicted_salary double, salary_vs_market double, pay_band string, is_real boolean, "
                                 "source string, url string")
    dim_skill = spark.createDataFrame([(_id(s), s, 1) for s in skills], "skill_id string, skill_name string, posting_count long")
    dim_company = spark.createDataFrame([(_id(f"c{i}"), f"c{i}") for i in range(5)], "company_id string, company_name string")
    return fact.cache(), spark.createDataFrame(bridge, "posting_id string, skill_id string").cache(), dim_skill, dim_company


SPECS = [search.SearchSpec(limit=70), search.SearchSpec(limit=90, prioritize_regions="ASIA, EUROPE", prioritize_skills="Brand#1,Brand#7")]


def whole(star, spec):
    """The full order by plain Python."""
    fact, bridge = star[:2]
    regions = search._items(spec.prioritize_regions)
    wanted = {_id(s) for s in search._items(spec.prioritize_skills)}
    hits = {}
    for r in bridge.collect():
        hits[r.posting_id] = hits.get(r.posting_id, 0) + (r.skill_id in wanted)
    return [r.posting_id for r in sorted(fact.collect(), key=lambda r: (
        not r.is_real, -(r.region in regions), -hits.get(r.posting_id, 0), r.salary is None, -(r.salary or 0), r.posting_id))]


@pytest.mark.parametrize("spec", SPECS)
def test_pages_by_cursor_are_the_whole_list(star, spec):
    page, seen = search.search_ranked(*star, spec), []
    while (rows := [r.posting_id for r in page.collect()]):
        seen += rows
        page = search.search_after(*star, spec, search.page_cursor(page, spec))
    assert seen == whole(star, spec)
    assert search.page_cursor(page, spec) is None


@pytest.mark.parametrize("spec", SPECS)
def test_sought_offsets_equal_the_sorted_list(star, spec):
    from dataclasses import replace
    order = whole(star, spec)
    for offset, near in ((0, 0), (3, 0), (100, 5), (283, 0), (395, 1), (419, 0), (420, 0), (5000, 10)):
        page = search.search_seek(*star, replace(spec, offset=offset, limit=25), near=near)
        assert [r.posting_id for r in page.collect()] == order[offset:offset + 25], offset


def test_a_seek_skips_no_more_than_near(star):
    spec = SPECS[0]
    ranked, _ = search.with_rank_keys(search.search_filter(*star[:3], spec), *star[1:3], spec)
    rest, skip = search.seek(ranked, search._seek_levels(spec, 12), 300, 4)
    assert skip <= 4 and ranked.where(rest).count() == 420 - 300 + skip


def test_pages_of_nothing(star):
    spec = search.SearchSpec(q="no such title", offset=50)
    assert search.search_seek(*star, spec, near=0).count() == 0


def test_a_page_is_one_top_k_over_two_scans(spark, small_dir):
    from dataclasses import replace

    from laborlake.plans.catalog import RANK_SPEC
    from laborlake.sources.fixtures import Fixtures
    fx = Fixtures(spark, small_dir)
    page = search.search_ranked(fx.fact_wide, fx.bridge, fx.dim_skill, fx.dim_company, replace(RANK_SPEC, offset=50))
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 2


def test_median_is_exact_and_one_aggregate(spark):
    rng = random.Random(2)
    rows = [(s, rng.choice([None, 1, 2, 5, 10 ** 12, rng.randint(0, 50)])) for s in ("senior", "junior", None) for _ in range(101)]
    df = spark.createDataFrame([*rows, ("none", None)], "seniority string, salary_clean long")
    got = {r.seniority: (r.avg_salary, r.median_salary, r.postings) for r in etl.batch_salary_by_seniority(df).collect()}
    for s in ("senior", "junior", None):
        known = sorted(v for k, v in rows if k == s and v is not None)
        assert got[s][1:] == (known[(len(known) - 1) // 2], 101)
        assert got[s][0] == pytest.approx(sum(known) / len(known), abs=0.51)
    assert got["none"] == (None, None, 1)
    plan = etl.batch_salary_by_seniority(df)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and df.select(F.col("seniority")).distinct().count() == 4
