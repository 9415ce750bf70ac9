"""Hard negatives against a plain loop over all pairs, the Hilbert curve, and the zone maps' pruning."""
import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from laborlake.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, block long, grp long, at int, score long, q double, v binary, chunk int"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows):
    rows = [(i, label, [math.floor(256 * x) for x in e]) for i, e, label in rows
            if label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]

    def score(a, b):
        return min(max(sum(x * y for x, y in zip(a[2], b[2])), hn.LEAST), hn.MOST)

    def order(r):
        return -r[0], r[1] is None, r[1] or 0
    out = Counter()
    for n, a in enumerate(rows):
        if a[0] is None or a[0] % 100:
            continue
        alike = sorted(((score(a, r), r[0]) for m, r in enumerate(rows) if m != n and r[1] == a[1]), key=order)[:5]
        others = sorted(((score(a, r), r[0]) for r in rows if r[1] != a[1]), key=order)
        for p, pid in alike:
            hits = [x for x in others if 30 * p <= 100 * x[0] <= 90 * p][:10]
            for k, (s, i) in enumerate(hits, 1):
                out[a[0], pid, k, i, p, s] += 1
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, *(None,) * 7) for r in rows], SCHEMA).repartition(3)
    return Counter(tuple(r[c] for c in COLUMNS) for r in hn.mine(df, **kw).collect())


def cloud(rng, n, dims=6, labels=4, close=0.5):
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(labels)]
    out = []
    for i in range(n):
        label = rng.randrange(labels)
        out.append((i, [close * c + rng.gauss(0, 0.6) for c in centres[label]], label))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    out = cloud(rng, 1200)
    out += [(2000, None, 1), (2100, [0.1, None, 1.0, 0.0, 0.0, 0.0], 1), (2200, [float("nan")] + [0.0] * 5, 2), (2300, [0.5] * 6, None),
            (2400, [float("inf")] + [0.0] * 5, 2), (None, [0.9] * 6, 1), (None, [0.4] * 6, 0), (2500, [], 1), (2600, [1.0, 0.5], 3),
            (2700, [-3.0] * 6, 7), (2701, [-0.001] * 6, 7), (2800, [0.0] * 6, 8), (2801, [0.0] * 6, 8)]
    out += [(3000 + i, [0.7, 0.2, 0.4, 0.1, 0.3, 0.6], i % 2) for i in range(300)]          # one vector, very often
    return out + [(100, out[100][1], out[100][2])] * 2 + [out[0]]                             # repeated anchors


def test_against_plain_loop(spark, rows):
    want = brute(rows)
    assert sum(want.values()) > 500
    assert run(spark, rows) == want
    assert run(spark, rows, block=16, group=3, page=2, chunk=4) == want


def test_numbers_that_no_double_holds(spark):
    rng = random.Random(8)
    rows = [(i * 50, [rng.uniform(-1, 1) * 10.0 ** rng.randint(0, 14) for _ in range(3)], i % 2) for i in range(40)]
    assert run(spark, rows, block=4) == brute(rows)
    rows = [(i * 50, [1e30 * (i + 1), -1.0], i % 2) for i in range(6)]
    assert run(spark, rows) == brute(rows)


def test_empty_and_lonely(spark):
    assert run(spark, []) == Counter() and run(spark, [(100, [1.0], 1)]) == Counter() and run(spark, [(100, None, 1)]) == Counter()
    assert run(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == Counter()


@pytest.mark.parametrize("dims,bits", [(2, 1), (2, 3), (3, 3), (4, 2), (5, 2)])
def test_curve_visits_neighbours(dims, bits):
    points = np.array(list(itertools.product(range(1 << bits), repeat=dims)), np.uint64)
    place = hn.hilbert(points, bits).astype(np.int64)
    assert sorted(place) == list(range(len(points)))
    steps = np.abs(np.diff(points[np.argsort(place)].astype(np.int64), axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_bounds_hold_and_are_reached():
    rng = np.random.default_rng(1)
    v, a = rng.integers(-300, 300, (50, 7)).astype(float), rng.integers(-300, 300, (20, 7)).astype(float)
    worst, best = hn.bounds(a, v.min(axis=0)[None], v.max(axis=0)[None])
    got = a @ v.T
    assert (got.min(axis=1) >= worst[:, 0]).all() and (got.max(axis=1) <= best[:, 0]).all()
    worst, best = hn.bounds(a, v, v)
    assert (worst == got).all() and (best == got).all()


def test_zone_maps_leave_blocks_unread(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(3 * math.cos(label), 0.05), rng.gauss(3 * math.sin(label), 0.05), rng.gauss(0.5, 0.05)], label)
            for i in range(2000) for label in [i % 5]]
    plans, settled = [], hn.settled

    def spy(df, name):
        out = settled(df, name)
        if name == "plan":
            plans.append(out)
        if name == "blocks":
            plans.append(out)
        return out
    monkeypatch.setattr(hn, "settled", spy)
    assert run(spark, rows, block=32) == brute(rows)
    blocks, first, second = plans
    assert blocks.count() >= 60
    chunks = first.select("chunk").distinct().count()
    assert first.count() < 0.7 * blocks.count() * chunks and second.count() < 0.7 * blocks.count() * chunks


def test_zones_are_read_without_vectors(spark, rows):
    df = spark.createDataFrame([(*r, *(None,) * 7) for r in rows], SCHEMA)
    given = hn.usable(df, "vec_id", "embedding", "label")
    blocks = hn.write_blocks(given, hn.shape_of(given), 64, 4, 2)
    plan = blocks.select("grp", "block", "label", "low", "high")._jdf.queryExecution().toString()
    assert "v#" not in plan.split("== Physical Plan ==")[1]
    assert blocks.agg(F.max(F.size("ids"))).first()[0] == 64
