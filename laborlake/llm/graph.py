"""Connected components of a graph of long ids, as alternating star joins."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlake.llm.common import settled


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b), component being the
    smallest id that can be reached.

    Large stars hang a node's larger neighbours on its smallest neighbour, small stars its
    smaller ones, until nothing moves; the rounds grow with the logarithm of the longest path.
    Minima are combined before they are shuffled, and each round ends in a written table.
    """
    flat = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    flat = settled(flat, "edges-0")
    state, turn = _state(flat), 0
    while state[0]:
        both = flat.unionByName(flat.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct())
        turn += 1
        flat = settled(small, f"edges-{turn}")
        was, state = state, _state(flat)
        if was == state:
            break
    return flat.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        flat.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
    return r["n"], r["x"]
