"""Hard negatives: for an anchor and one of its positives, the best rows of another label whose
score lies between 30 % and 90 % of the positive's.

Components become integers, floor(256 x).  Rows are range-partitioned by label and place on a
Hilbert curve (of the ``CURVE_DIMS`` dimensions with the largest variance) and written to a
Parquet table with one row for each block of ``BLOCK`` vectors of a label; a block's zone map
holds the smallest and largest value of every dimension.  For an anchor a, interval arithmetic
bounds the scores in a block: at most sum(max(a lo, a hi)), at least sum(min(a lo, a hi)).

Two searches run.  The first finds the positives: it reads the blocks of the anchor's label whose
upper bound reaches the fifth best score of the anchor's own block.  Their scores are the windows
of the second: it reads the blocks of other labels whose bounds meet one of the windows.  Each
search is planned on the zone maps alone, read as columns without the vectors; then chunks of
anchors meet the groups of blocks that they need, a chunk and a group at a time, so a task holds
at most one of each.  Every task returns its best rows per window, and the best of those are kept.

Defined results: rows with a null label, a null vector or a null or non-finite component take no
part; a null vec_id comes after all others and is no anchor.  Shorter vectors count as filled up
with zeros.  Repeated rows are rows of their own: a copy of an anchor is an anchor too, and may be
its positive.  Scores outside a long count as its limits.  A positive with a negative score has no
window.  An empty table gives an empty result.  Other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laborlake.llm.common import release, settled

SCALE = 256
BLOCK = 256
GROUP = 64
PAGE = 64
CHUNK = 16_384
CURVE_DIMS = 16
CURVE_BITS = 4
POSITIVES = 5
NEGATIVES = 10
LOW, HIGH, OF = 30, 90, 100
SLICE = 256
LEAST, MOST = -2 ** 63, 2 ** 63 - 1
SINGLE_OPS = 2 ** 53  # integers below this are exact as doubles


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of ``points`` (unsigned, under 2**bits) on the Hilbert curve.

    The curve's rotations are undone from the highest bit down, then the Gray code is read off.
    """
    axes = [points[:, i].astype(np.uint64) for i in range(points.shape[1])]
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        bit, low = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for i in range(len(axes)):
            swap = np.where(axes[i] & bit, np.uint64(0), (axes[0] ^ axes[i]) & low)
            turn = np.where(axes[i] & bit, low, swap)
            axes[i] = axes[i] ^ swap if i else axes[i]
            axes[0] = axes[0] ^ turn
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    flip = np.zeros(len(points), np.uint64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(axes[-1] & np.uint64(1 << level), np.uint64((1 << level) - 1), np.uint64(0))
    place = np.zeros(len(points), np.uint64)
    for level in range(bits - 1, -1, -1):
        for a in axes:
            place = (place << one) | (((a ^ flip) >> np.uint64(level)) & one)
    return place


def usable(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, q): the rows that take part, their components as whole doubles."""
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    q = F.transform(vector, lambda x: SCALE * x)
    return (rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), vector_col)
            .where(F.col("label").isNotNull() & F.col(vector_col).isNotNull() & finite).select("vec_id", "label", q.alias("q")))


class Shape:
    """What the tasks have to know of all rows: sizes that follow the dimensions, not the rows."""

    def __init__(self, stats: list):
        self.dims = max((r["pos"] for r in stats), default=0) + 1
        most = max((max(abs(np.floor(r["low"])), abs(np.floor(r["high"]))) for r in stats), default=0.0)
        self.exact = self.dims * most * most < SINGLE_OPS
        self.dtype = "<i2" if most < 2 ** 15 else "<i4" if most < 2 ** 31 else "<f8"
        spread = sorted(stats, key=lambda r: (-(r["spread"] or 0.0), r["pos"]))[:CURVE_DIMS]
        self.curve = [r["pos"] for r in spread] or [0]
        self.low = np.array([r["low"] for r in spread] or [0.0])
        with np.errstate(over="ignore"):
            width = np.array([r["high"] for r in spread] or [0.0]) - self.low
        self.width = np.where(width > 0, width, 1.0)

    def vectors(self, payload: bytes) -> np.ndarray:
        return np.frombuffer(payload, self.dtype).reshape(-1, self.dims).astype(np.float64)

    def places(self, v: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            at = np.nan_to_num((v[:, self.curve] - self.low) / self.width * (1 << CURVE_BITS))
        return hilbert(np.clip(at, 0, (1 << CURVE_BITS) - 1).astype(np.uint64), CURVE_BITS)


def shape_of(rows: DataFrame) -> Shape:
    stats = rows.select(F.posexplode("q").alias("pos", "x")).groupBy("pos").agg(
        F.min("x").alias("low"), F.max("x").alias("high"), F.var_pop("x").alias("spread"))
    return Shape(stats.collect())  # one row per dimension


def scores(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of the rows of ``a`` and ``b`` as longs."""
    if exact:
        return (a @ b.T).astype(np.int64)
    a, b = (np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape) for m in (a, b))
    return np.array([[min(max(int(x), LEAST), MOST) for x in row] for row in a @ b.T], np.int64).reshape(len(a), len(b))


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score that each row of ``a`` can have in each zone."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


def _encode(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            q = b.column(2)
            lengths = np.diff(q.offsets.to_numpy())
            v = np.zeros((b.num_rows, shape.dims))
            v[np.arange(shape.dims) < lengths[:, None]] = np.floor(q.flatten().to_numpy(zero_copy_only=False))
            place = (shape.places(v) ^ np.uint64(1 << 63)).view(np.int64)
            packed = v.astype(shape.dtype)
            ends = np.arange(b.num_rows + 1, dtype=np.int32) * packed.itemsize * shape.dims
            column = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(packed.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(place), column], ["vec_id", "label", "place", "v"])
    return run


_BLOCK_SQL = "block long, grp long, page long, label long, ids array<bigint>, v binary, low binary, high binary"
_BLOCK = pa.schema([("block", pa.int64()), ("grp", pa.int64()), ("page", pa.int64()), ("label", pa.int64()), ("ids", pa.list_(pa.int64())),
                    ("v", pa.binary()), ("low", pa.binary()), ("high", pa.binary())])


def _blocks(shape: Shape, size: int, group: int, page: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, done = TaskContext.get().partitionId() << 32, 0
        label, ids, vectors = None, [], []

        def cut():
            v = shape.vectors(b"".join(vectors))
            at = [part | done, part | done // group, part | done // (group * page)]
            return pa.RecordBatch.from_arrays(
                [pa.array([x], f.type) for x, f in zip(
                    [*at, label, ids, b"".join(vectors), v.min(axis=0).tobytes(), v.max(axis=0).tobytes()], _BLOCK)], schema=_BLOCK)

        for b in batches:
            for i, of, v in zip(*(c.to_pylist() for c in b.columns)):
                if ids and (of != label or len(ids) == size):
                    yield cut()
                    done, ids, vectors = done + 1, [], []
                label = of
                ids.append(i)
                vectors.append(v)
        if ids:
            yield cut()
        release()
    return run


def write_blocks(rows: DataFrame, shape: Shape, size: int, group: int, page: int) -> DataFrame:
    """The written table of blocks, in the order of label and curve.  Rows alike in all keys are
    spread by their place in the scan, so copies of one vector fill as many partitions as they need."""
    order = ["label", "place", "vec_id", "spread"]
    placed = rows.mapInArrow(_encode(shape), "vec_id long, label long, place long, v binary").withColumn("spread", F.monotonically_increasing_id())
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("vec_id", "label", "v")
    return settled(ordered.mapInArrow(_blocks(shape, size, group, page), _BLOCK_SQL), "blocks")


_CHUNK_SQL = "chunk long, block array<bigint>, place array<int>, ids array<bigint>, labels array<bigint>, v binary, least array<bigint>"
_CHUNK = pa.schema([("chunk", pa.int64()), ("block", pa.list_(pa.int64())), ("place", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64())),
                    ("labels", pa.list_(pa.int64())), ("v", pa.binary()), ("least", pa.list_(pa.int64()))])


def _chunks(shape: Shape, every: int, size: int, k: int):
    """Anchors in chunks, each with the least score that its k-th positive can have: the k-th in its own block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def chunk():
            cols = list(zip(*held))
            row = [cols[0][0], list(cols[0]), *(list(c) for c in cols[1:4]), b"".join(cols[4]), list(cols[5])]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _CHUNK)], schema=_CHUNK)

        for b in batches:
            for block, label, ids, payload in zip(*(c.to_pylist() for c in b.columns)):
                v = shape.vectors(payload)
                at = [p for p, i in enumerate(ids) if i is not None and i % every == 0]
                if not at:
                    continue
                least = [LEAST] * len(at)
                if len(ids) > k:
                    own = scores(v[at], v, shape.exact)
                    own[np.arange(len(at)), at] = LEAST
                    least = np.partition(own, len(ids) - k, axis=1)[:, len(ids) - k].tolist()
                packed = v.astype(shape.dtype)
                held += [(block, p, ids[p], label, packed[p].tobytes(), x) for p, x in zip(at, least)]
                if len(held) >= size:
                    yield chunk()
                    held = []
        if held:
            yield chunk()
    return run


def windows(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest whole score n with LOW p <= OF n <= HIGH p; none where p is negative."""
    low = [-(-LOW * int(x) // OF) for x in p]
    return np.array(low, np.int64), np.array([HIGH * int(x) // OF for x in p], np.int64)


class Anchors:
    """A chunk as arrays; ``first[a]:first[a + 1]`` are anchor a's windows."""

    def __init__(self, row: dict, shape: Shape):
        self.chunk, self.ids = row["chunk"], row["ids"]
        self.block, self.place = np.array(row["block"], np.int64), np.array(row["place"], np.int64)
        self.labels, self.least = np.array(row["labels"], np.int64), np.array(row["least"], np.int64)
        self.v = shape.vectors(row["v"])
        found = sorted((w["at"], w["rank"], w["positive_id"], w["score"]) for w in row["found"]) if row.get("found") else []
        self.positive = [(w[1], w[2], w[3]) for w in found]
        self.low, self.high = windows(np.array([w[3] for w in found], dtype=object))
        self.first = np.searchsorted(np.array([w[0] for w in found], np.int64), np.arange(len(self.ids) + 1))

    def wanted(self, labels: np.ndarray, low: np.ndarray, high: np.ndarray, shape: Shape, second: bool) -> np.ndarray:
        """Which zones each anchor has to read."""
        same = self.labels[:, None] == labels[None, :]
        need = ~same if second else same
        if shape.exact:
            worst, best = bounds(self.v, low, high)
            if not second:
                need &= best >= self.least[:, None]
        for a in range(len(self.ids)) if second else ():
            w = slice(self.first[a], self.first[a + 1])
            ok = self.low[w] <= self.high[w]
            if not shape.exact:
                need[a] &= ok.any()
            else:
                need[a] &= ((best[a][None, :] >= self.low[w][ok, None]) & (worst[a][None, :] <= self.high[w][ok, None])).any(axis=0)
        return need


_PLAN_SQL = "chunk long, grp long, block long"


def _plan(shape: Shape, second: bool):
    def run(zones: pa.Table, chunks: pa.Table) -> pa.Table:
        out: list[np.ndarray] = []
        if zones.num_rows:
            labels = zones["label"].to_numpy()
            low, high = (np.frombuffer(b"".join(zones[c].to_pylist())).reshape(-1, shape.dims) for c in ("low", "high"))
            for row in chunks.to_pylist():
                anchors = Anchors(row, shape)
                at = np.flatnonzero(anchors.wanted(labels, low, high, shape, second).any(axis=0))
                out.append(np.stack([np.full(len(at), anchors.chunk), zones["grp"].to_numpy()[at], zones["block"].to_numpy()[at]]))
        got = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
        return pa.table([pa.array(c, pa.int64()) for c in got], names=["chunk", "grp", "block"])
    return run


def best_of(values: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` of the places ``at`` with the largest values, largest first, ties by place."""
    if len(at) > k:
        v = values[at]
        at = at[v >= np.partition(v, len(at) - k)[len(at) - k]]
    return at[np.argsort(-values[at], kind="stable")][:k]


_FOUND_SQL = "chunk long, at int, anchor_id long, rank int, positive_id long, other long, base long, score long"
_FOUND = pa.schema([("chunk", pa.int64()), ("at", pa.int32()), ("anchor_id", pa.int64()), ("rank", pa.int32()),
                    ("positive_id", pa.int64()), ("other", pa.int64()), ("base", pa.int64()), ("score", pa.int64())])


def _search(shape: Shape, second: bool, k: int):
    """The best rows of one group of blocks for each anchor of one chunk, or for each of its windows."""
    def run(blocks: pa.Table, chunks: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if blocks.num_rows and chunks.num_rows:
            anchors = Anchors(chunks.to_pylist()[0], shape)
            rows = blocks.to_pylist()
            sizes = [len(r["ids"]) for r in rows]
            ids = np.array([MOST if i is None else i for r in rows for i in r["ids"]], np.int64)
            none = np.array([i is None for r in rows for i in r["ids"]])
            order = np.lexsort((ids, none))                      # by id, nulls last: ties need no more than the place
            number = np.repeat(np.arange(len(rows)), sizes)[order]
            block = np.repeat([r["block"] for r in rows], sizes)[order]
            place = np.concatenate([np.arange(n) for n in sizes])[order]
            v = np.concatenate([shape.vectors(r["v"]) for r in rows])[order]
            ids, none = ids[order], none[order]
            low, high = (np.stack([np.frombuffer(r[c]) for r in rows]) for c in ("low", "high"))
            need = anchors.wanted(np.array([r["label"] for r in rows], np.int64), low, high, shape, second)
            for start in range(0, len(anchors.ids), SLICE):
                some = np.arange(start, min(start + SLICE, len(anchors.ids)))
                read = np.flatnonzero(need[some].any(axis=0)[number])
                if not len(read):
                    continue
                got = scores(anchors.v[some], v[read], shape.exact)
                for a, row in zip(some, got):
                    ok = need[a][number[read]]
                    if not second:
                        ok &= (block[read] != anchors.block[a]) | (place[read] != anchors.place[a])
                        ok &= row >= anchors.least[a]
                        looks = [(0, None, None, np.flatnonzero(ok))]
                    else:
                        looks = [(*anchors.positive[w], np.flatnonzero(ok & (row >= anchors.low[w]) & (row <= anchors.high[w])))
                                 for w in range(anchors.first[a], anchors.first[a + 1])]
                    for rank, positive, base, at in looks:
                        for x in best_of(row, at, k):
                            other = None if none[read[x]] else int(ids[read[x]])
                            out.append((anchors.chunk, int(a), anchors.ids[a], rank, positive, other, base, int(row[x])))
        cols = list(zip(*out)) or [()] * len(_FOUND)
        return pa.table([pa.array(c, f.type) for c, f in zip(cols, _FOUND)], schema=_FOUND)
    return run


def _spread(name: str, n: int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(n)).cast("int")


def search(blocks: DataFrame, chunks: DataFrame, shape: Shape, pages: int, n_chunks: int, second: bool, k: int) -> DataFrame:
    """The best ``k`` rows of every anchor, or of every window: planned on the zones, then read."""
    zones = (blocks.select("grp", "page", "block", "label", "low", "high").withColumn("p", _spread("page", pages))
             .withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1)))).drop("page"))
    asking = chunks.withColumn("c", _spread("chunk", n_chunks)).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(pages - 1))))
    plan = settled(zones.groupBy("p", "c").cogroup(asking.groupBy("p", "c")).applyInArrow(_plan(shape, second), _PLAN_SQL), "plan")
    left = plan.join(blocks.drop("grp", "page"), "block")
    pairs = plan.select(F.col("chunk").alias("asks"), F.col("grp").alias("of")).distinct()
    right = pairs.join(chunks, pairs["asks"] == chunks["chunk"])
    found = left.groupBy("chunk", "grp").cogroup(right.groupBy("asks", "of")).applyInArrow(_search(shape, second, k), _FOUND_SQL)
    best = Window.partitionBy("chunk", "at", "rank").orderBy(F.col("score").desc(), F.col("other").asc_nulls_last())
    return found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k)


def mine(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", anchor_every: int = 100,
         positives: int = POSITIVES, negatives: int = NEGATIVES, block: int = BLOCK, group: int = GROUP, page: int = PAGE,
         chunk: int = CHUNK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; anchors are the
    rows whose id is divisible by ``anchor_every``."""
    given = usable(rows, id_col, vector_col, label_col)
    shape = shape_of(given)
    blocks = write_blocks(given, shape, block, group, page)
    chunks = settled(blocks.select("block", "label", "ids", "v").mapInArrow(_chunks(shape, anchor_every, chunk, positives), _CHUNK_SQL), "anchors")
    pages, n_chunks = max(1, blocks.select("page").distinct().count()), max(1, chunks.count())
    first = search(blocks, chunks, shape, pages, n_chunks, False, positives)
    found = F.struct("at", F.col("nth").alias("rank"), F.col("other").alias("positive_id"), "score")
    asked = settled(chunks.join(first.groupBy("chunk").agg(F.collect_list(found).alias("found")), "chunk"), "windows")
    return search(blocks, asked, shape, pages, n_chunks, True, negatives).select(
        "anchor_id", "positive_id", F.col("nth").alias("rank"), F.col("other").alias("negative_id"),
        F.col("base").alias("positive_score"), F.col("score").alias("negative_score"))
