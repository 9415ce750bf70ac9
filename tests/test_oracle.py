"""Every registered query with an oracle must equal DuckDB's result on the small tables
(row count, column names, values — order-insensitive)."""
import math

import duckdb
import pytest

import __spark_entry__ as entry
from laborlake.sources.tables import TABLE_NAMES

SQL = entry.oracle_sql()


def _norm(v):
    if isinstance(v, float):
        return round(v, 6) if not math.isnan(v) else "nan"
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(small_dir):
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"create view {t} as select * from read_parquet('{small_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck, small_dir, name):
    sdf = entry.queries()[name](spark, small_dir)
    srows = [tuple(r) for r in sdf.collect()]
    cur = duck.execute(SQL[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert _rows(sdf.columns, srows) == _rows(dcols, drows)


def test_every_query_runs_and_entry(spark):
    df = entry.entry(spark)
    assert df.count() >= 0
    assert df.columns == ["skill_name", "postings", "avg_salary", "premium_vs_average"]


@pytest.mark.parametrize("name", ["profile_match", "match_score", "match_report", "notification_text"])
def test_pair_tables_match_oracle(spark, duck, small_dir, name):
    """The registered matching queries are per-user summaries; the full pair tables are
    compared here (small tables) against the per-pair SQL."""
    from laborlake.plans import catalog_matching as cm
    from laborlake.plans.oracle import with_fx
    from laborlake.sources.fixtures import Fixtures
    fn = {"profile_match": cm.profile_match_pairs, "match_score": cm.match_score_pairs,
          "match_report": cm.match_report_pairs, "notification_text": cm.notification_pairs}[name]
    sdf = fn(Fixtures(spark, small_dir))
    cur = duck.execute(with_fx(cm.PAIR_SQL[name]))
    dcols = [d[0] for d in cur.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert _rows(sdf.columns, [tuple(r) for r in sdf.collect()]) == _rows(dcols, cur.fetchall())
