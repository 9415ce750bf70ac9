"""Line dedup against a plain loop, and on nulls, repeated rows, hot lines and clashing columns."""
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from laborlake.llm import line_dedup

SCHEMA = "doc_id long, text string, key string, pos int, line string, d1 long, h1 long, docs long, part int, gone string"


def key(line):
    return re.sub(r"[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\f\r"))


def brute(rows, min_docs, min_chars=1):
    seen = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                seen[key(line)].add((i, t or ""))
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or len(seen[key(x)]) < min_docs]
        out[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, *(None,) * 8) for r in rows], SCHEMA).repartition(3)
    return Counter(tuple(r) for r in line_dedup.drop_common_lines(df, **kw).collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    pool = ["Share this", " share THIS\t", "ÄRGER", "ärger", " Share this", "(c) All rights", "x", "", "  ", "\x0bx\r", "Next page"]
    out = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.5 else f"line {rng.random()}" for _ in range(rng.randint(1, 9))))
           for i in range(60)]
    out += [(100, None), (101, ""), (102, "\n\n"), (103, "Share this"), (104, "Share this\n" * 3000 + "end")]
    return out + [out[0], out[0], (None, out[3][1]), (None, out[3][1]), (None, "Share this\nalone"), (5, "Next page\nused id")]


def test_against_plain_loop(spark, rows):
    for kw in ({"min_docs": 10}, {"min_docs": 2, "min_chars": 4}, {"min_docs": 1}, {"min_docs": 10, "hot": 1, "salt": 3},
               {"min_docs": 3, "hot": 100_000, "salt": 2}):
        assert run(spark, rows, **kw) == brute(rows, kw["min_docs"], kw.get("min_chars", 1))


def test_copies_of_a_row_are_one_document(spark):
    copies = [(1, "same line")] * 12
    assert run(spark, copies) == Counter({(1, 1, 0, "same line"): 12})
    assert run(spark, [(i, "same line") for i in range(10)]) == Counter({(i, 1, 1, ""): 1 for i in range(10)})


def test_empty_table(spark):
    assert run(spark, []) == Counter()


def test_hot_lines_are_a_bounded_broadcast(spark):
    rows = [(i, "\n".join(["every", *(f"g{k}" for k in range(i % 7))])) for i in range(400)]
    lines = line_dedup.exploded_lines(spark.createDataFrame(rows, "doc_id long, text string").select(
        F.col("doc_id").alias("d1"), F.col("doc_id").alias("d2"), "text"))
    common = line_dedup.common_lines(lines)
    total = sum(r["lines"] for r in common.collect())
    assert common.where(F.col("lines") * 4 > total).count() <= 4
    assert run(spark, rows, hot=4, salt=5) == brute(rows, 10)
