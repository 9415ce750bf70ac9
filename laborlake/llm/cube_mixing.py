"""Mixing sources to target weights by cube-method balanced sampling.

Every document of a source has the same expected number of copies p = target / source size,
between 0 and 2.  The whole part of p is taken for sure; the fraction is a probability that
the cube method rounds to 0 or 1.  The flight phase moves the fractions of three documents at
a time along the one direction that keeps both the number of documents and the number of
words, until one of the three is decided.  It runs in blocks of a source; a block leaves at
most two documents undecided, and those form the blocks of the next level.  When a source has
one block left, a dozen of its documents, its longest and others of half the size each, stay
out of the flight.  The landing tries every rounding of these and of the undecided ones: of
those that keep the number of documents, but for four, it picks the one that misses the words least.

Defined results: a null text has size 0; a null source is a source of its own, ordered last;
a source without words has target 0 and gives nothing.  Repeated rows are sampled one by one:
rows alike in id, text and source are counted and numbered, and dealt to blocks by number, so
many copies of a row do not meet in one block.  An empty table gives an empty result.  Ids may be null.  Random numbers come from the seed,
the source and the block alone, so reruns agree whatever the partitioning.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlake.llm.common import n_words_of, settled

WEIGHTS = (5.0, 2.0, 1.0)
BLOCK = 4096
#: Documents that the last block of a source keeps for its landing.
HELD = 12
#: Copies of a row that are numbered at a time.
NUMBERED = 65_536


def water_fill(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Targets that share ``share`` times all sizes by weight, none above ``most`` times its size."""
    target = [0.0] * len(sizes)
    left, open_ = share * sum(sizes), [i for i, s in enumerate(sizes) if s > 0]
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        if not over:
            for i in open_:
                target[i] = unit * weights[i]
            break
        for i in over:
            target[i] = most * sizes[i]
            left -= target[i]
        open_ = [i for i in open_ if i not in set(over)]
    return target


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, eps: float = 1e-9) -> np.ndarray:
    """Decide all but at most two of the probabilities, keeping their sum and their sum of words."""
    out = p.astype(float).copy()
    active: list[int] = []
    coming = iter(np.flatnonzero((out > eps) & (out < 1 - eps)).tolist())
    draws = iter(rng.random(len(out) + 8).tolist())
    while True:
        while len(active) < 3 and (nxt := next(coming, None)) is not None:
            active.append(nxt)
        if len(active) == 3:
            a, b, c = (float(size[i]) for i in active)
            u = [b - c, c - a, a - b]
            if not any(u):
                u = [1.0, -1.0, 0.0]
        elif len(active) == 2 and size[active[0]] == size[active[1]]:
            u = [1.0, -1.0]
        else:
            return out
        x = [out[i] for i in active]
        up = min((1 - v) / d if d > 0 else -v / d for v, d in zip(x, u, strict=True) if d)
        down = min(v / d if d > 0 else (v - 1) / d for v, d in zip(x, u, strict=True) if d)
        step = up if next(draws) * (up + down) < down else -down
        for i, v, d in zip(active, x, u, strict=True):
            v += step * d
            out[i] = 0.0 if v < eps else 1.0 if v > 1 - eps else v
        active = [i for i in active if 0 < out[i] < 1]


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Round the last fractions so that the words come nearest to what was expected, among the
    roundings whose number of documents is less than four and a half off."""
    out = p.astype(float).copy()
    open_ = np.flatnonzero((out > 0) & (out < 1))
    masks = np.arange(1 << len(open_))
    taken = (masks[:, None] >> np.arange(len(open_))) & 1
    words = np.abs(taken @ size[open_].astype(np.int64) - float((out[open_] * size[open_]).sum()))
    count = np.abs(taken.sum(axis=1) - float(out[open_].sum()))
    best = np.lexsort((masks, count, words, count >= 4.5))[0]
    out[open_] = taken[best]
    return out


def ladder(size: np.ndarray, rungs: int = HELD) -> list[int]:
    """Places of up to ``rungs`` of the ascending sizes: the largest, then each nearest below half
    of the one before, so that sums of a choice of them come near any number of words.  Sizes too
    much alike for that are filled up from the smallest."""
    picked: list[int] = []
    at = len(size) - 1
    while at >= 0 and len(picked) < rungs:
        picked.append(at)
        at = min(at, int(np.searchsorted(size, size[at] / 2, "right"))) - 1
    others = [i for i in range(min(len(size), 2 * rungs)) if i not in picked]
    return picked + others[:rungs - len(picked)]


def fly_and_land(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, eps: float = 1e-9) -> np.ndarray:
    """The last block of a source, its rows in ascending size: decide every probability."""
    out = p.astype(float).copy()
    open_ = np.flatnonzero((out > eps) & (out < 1 - eps))
    moving = np.ones(len(out), dtype=bool)
    moving[open_[ladder(size[open_])]] = False
    out[moving] = flight(out[moving], size[moving], rng, eps)
    return land(out, size)


def _level(level: int, seed: int):
    def decide(key: tuple, t: pa.Table) -> pa.Table:
        source, block = key[0].as_py(), key[1].as_py()
        order = np.lexsort((t["copy"].to_numpy(), t["th"].to_numpy(), t["id"].fill_null(-1).to_numpy(), t["size"].to_numpy()))
        t = t.take(pa.array(order))
        last = t["blocks"][0].as_py() == 1
        p = (fly_and_land if last else flight)(
            t["p"].to_numpy(), t["size"].to_numpy(), np.random.default_rng([seed, level, source, block]))
        return t.set_column(t.schema.get_field_index("p"), "p", pa.array(p))
    return decide


def numbered(rows: DataFrame) -> DataFrame:
    """Equal rows numbered from 0 in a column ``copy``: they are counted first, and the numbers
    of a row with many copies are made by many tasks."""
    keys = rows.columns
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(NUMBERED).cast("long")))
    return (rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
            .select(*keys, "__n", first.alias("__first")).repartition(*keys, "__first")
            .select(*keys, F.explode(F.sequence("__first", F.least(F.col("__n"), F.col("__first") + NUMBERED) - 1)).alias("copy")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 42) -> DataFrame:
    """One row per document: id, text hash, size, source_size, target, copies and taken."""
    spark = docs.sparkSession
    sizes = settled(docs.select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"),
        F.col(source_col).cast("string").alias("src"), n_words_of(F.col(text_col)).alias("size")), "mix-sizes")
    # One row for each source: the sources are a dimension, not the data.
    by = sizes.groupBy("src").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    by.sort(key=lambda r: (r["src"] is None, r["src"] or ""))
    target = water_fill([r["s"] for r in by], [weights[i % len(weights)] for i in range(len(by))], share, most)
    rows = [(r["src"], i, int(r["s"]), float(t), -(-r["n"] // BLOCK)) for i, (r, t) in enumerate(zip(by, target, strict=True))]
    plan = spark.createDataFrame(rows, "src string, source int, source_size long, target double, blocks int")
    if len(rows) <= 100_000:
        plan = F.broadcast(plan)
    expected = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))
                      ).otherwise(F.lit(0.0))
    left = (numbered(sizes).alias("a").join(plan.alias("b"), F.col("a.src").eqNullSafe(F.col("b.src")))
            .select("id", "th", "copy", "size", "source", "source_size", "target", "blocks", expected.alias("e"))
            .select("*", F.floor(F.col("e") + 1e-12).cast("int").alias("sure"))
            .select("*", F.greatest(F.lit(0.0), F.col("e") - F.col("sure")).alias("p")).drop("e"))
    done, level, most_blocks = None, 0, max((r[4] for r in rows), default=1)
    schema = ("id long, th long, copy long, size long, source int, source_size long, target double, blocks int, "
              "sure int, p double, block int")
    while True:
        dealt = left.withColumn("block", F.pmod(F.xxhash64("id", "th", "copy", F.lit(level)), F.col("blocks")).cast("int"))
        dealt = dealt.select(*(c.split()[0] for c in schema.split(", ")))
        out = settled(dealt.groupBy("source", "block").applyInArrow(_level(level, seed), schema), f"mix-level-{level}")
        decided = out.where((F.col("p") == 0) | (F.col("p") == 1))
        done = decided if done is None else done.unionByName(decided)
        if most_blocks == 1:
            break
        # A block leaves two documents at most.
        most_blocks = -(-2 * most_blocks // BLOCK)
        left = (out.where((F.col("p") > 0) & (F.col("p") < 1)).drop("block")
                .withColumn("blocks", F.ceil(F.col("blocks") * 2 / BLOCK).cast("int")))
        level += 1
    copies = F.col("sure") + F.col("p").cast("int")
    return done.select(F.col("id").alias("doc_id"), "th", "size", "source_size", "target", copies.alias("copies"),
                       (F.col("size") * copies).alias("taken"))
