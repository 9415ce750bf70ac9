"""SimHash fingerprints and their near duplicates by bit-sliced comparison.

A fingerprint bit is 1 where more than half of a text's shingle hashes have it.  Fingerprints
that differ in at most ``radius`` bits are linked.  The 64 bits are cut into radius + 2 blocks;
a linked pair agrees in at least two of them, so it meets in the table of some pair of blocks.
Within such a bucket the fingerprints stand vertically, one bit plane per bit.  A bucket is
compared with itself moved by 1, 2, 3 ... places: the planes' differences go into carry-save
counters, a bit for each pair in every counter plane, and words of pairs that have all passed
the radius are given up before the remaining planes are read.  Buckets above ``SPLIT`` are cut
into cells of two pieces, so no task holds a whole hot bucket, and a task works through its
cells in turn, holding a bounded number of rows.  The fingerprints are the nodes of the graph;
a component's id is the smallest document id in it, found once the components are known.

Defined results: null is the empty text, whose fingerprint is 0 and links like any other; a
null id ranks after all ids and stays null, as does the id of a component without ids.  Repeated rows get equal results.  An empty table
gives an empty result.  Only the id and text columns are read.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlake.llm.common import release, settled
from laborlake.llm.graph import components

SHINGLE = 4
RADIUS = 4
SPLIT = 8192
AT_ONCE = 1 << 18
NO_ID = 2 ** 63 - 1


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    import xxhash
    hashed = xxhash.xxh64_intdigest
    # bytes.lower and bytes.split know ASCII only: A-Z, and the six ASCII white-space bytes.
    words = text.encode("utf-8").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return hashed(b" ".join(words), 42)
    h = np.array([hashed(b" ".join(t), 42) for t in zip(*(words[i:] for i in range(shingle)), strict=False)], dtype="<u8")
    votes = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at:at + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([fingerprint(t or "", shingle) for t in b.column(1).to_pylist()], dtype="<u8")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(got.view("<i8"))], ["id", "th", "fp"])
        release()
    return run


def exceeds(planes: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter (planes from the lowest bit, and a sticky overflow) is above ``radius``."""
    above, equal = over.copy(), ~np.zeros_like(over)
    for k in reversed(range(len(planes))):
        if radius >> k & 1:
            equal &= planes[k]
        else:
            above |= equal & planes[k]
            equal &= ~planes[k]
    return above


def near_lanes(planes: np.ndarray, shift: int, valid: np.ndarray, radius: int) -> np.ndarray:
    """Bit i is set where rows i and i + shift differ in at most ``radius`` planes.

    ``planes``: 64 rows of words, a bit per fingerprint; ``valid``: the lanes that matter.
    """
    bits = max(1, radius.bit_length())
    q, r = divmod(shift, 64)
    words = planes.shape[1]
    live = np.flatnonzero(valid)
    result = np.zeros_like(valid)
    counter, over = [np.zeros(len(live), np.uint64) for _ in range(bits)], np.zeros(len(live), np.uint64)
    padded = np.concatenate([planes[:, q:], np.zeros((64, q + 1), np.uint64)], axis=1) if q else np.concatenate(
        [planes, np.zeros((64, 1), np.uint64)], axis=1)
    for first in range(0, 64, 16):
        group = slice(first, first + 16)
        moved = padded[group][:, live] >> np.uint64(r)
        if r:
            moved |= padded[group][:, live + 1] << np.uint64(64 - r)
        for d in planes[group][:, live] ^ moved:
            for k in range(bits):
                counter[k], d = counter[k] ^ d, counter[k] & d
            over |= d
        far = exceeds(counter, over, radius)
        keep = (~far & valid[live]) != 0
        if not keep.any():
            return result
        if not keep.all():
            live, over = live[keep], over[keep]
            counter = [c[keep] for c in counter]
    assert words == len(valid)
    result[live] = ~exceeds(counter, over, radius) & valid[live]
    return result


def _words(lanes: np.ndarray) -> np.ndarray:
    """Booleans along the last axis, packed 64 to a word."""
    n = -(-lanes.shape[-1] // 64) * 64
    full = np.zeros((*lanes.shape[:-1], n), bool)
    full[..., :lanes.shape[-1]] = lanes
    return np.packbits(full, axis=-1, bitorder="little").view("<u8")


def bit_planes(fp: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(np.ascontiguousarray(fp, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return _words(bits.T.astype(bool))


def linked(group: np.ndarray, fp: np.ndarray, radius: int) -> np.ndarray:
    """The smallest row that each row is linked with, directly or through others of its group.
    Rows of a group stand together."""
    n = len(fp)
    root = np.arange(n)
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, int)
    size = np.diff(np.r_[start, n])
    of = np.repeat(np.arange(len(start)), size)
    step = 1
    while step < (size.max() if n else 0):
        # Groups whose rows all hang together already can gain nothing.
        apart = np.maximum.reduceat(root, start) != np.minimum.reduceat(root, start)
        rows = np.flatnonzero(((size > step) & apart)[of])
        if not len(rows):
            break
        own, planes = of[rows], bit_planes(fp[rows])
        for s in range(step, min(2 * step, int(size.max()))):
            same = np.zeros(len(rows), bool)
            same[:-s] = own[s:] == own[:-s]
            if not same.any():
                break
            hit = near_lanes(planes, s, _words(same), radius)
            if not hit.any():
                continue
            i = np.flatnonzero(np.unpackbits(hit.view(np.uint8), bitorder="little")[:len(rows)])
            a, b = rows[i], rows[i + s]
            while len(new := np.flatnonzero(root[a] != root[b])):
                low, high = np.minimum(root[a[new]], root[b[new]]), np.maximum(root[a[new]], root[b[new]])
                np.minimum.at(root, high, low)
                while (root[root] != root).any():
                    root = root[root]
        step *= 2
    return root


def _links(radius: int, at_once: int = AT_ONCE):
    """Links (node, smallest node it hangs together with) of cells.  Rows come in order of their
    cell; whole cells are compared, about ``at_once`` rows at a time, so a task holds no more."""
    def compare(t: pa.Table) -> pa.RecordBatch:
        cell, fp, node = (t[c].to_numpy() for c in ("cell", "fp", "node"))
        order = np.lexsort((fp, cell))
        cell, fp, node = cell[order], fp[order].view("<u8"), node[order]
        root = linked(cell, fp, radius)
        i = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[root[i]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            if sum(x.num_rows for x in held) < at_once:
                continue
            t = pa.Table.from_batches(held)
            cell = t["cell"].to_numpy()
            if whole := int(np.searchsorted(cell, cell[-1])):
                yield compare(t.slice(0, whole))
                held = t.slice(whole).to_batches()
        if held:
            yield compare(pa.Table.from_batches(held))
        release()
    return run


def masks(radius: int = RADIUS) -> list[int]:
    """The bits of each pair of blocks."""
    blocks = radius + 2
    cut = [64 * i // blocks for i in range(blocks + 1)]
    bits = [((1 << (b - a)) - 1) << a for a, b in zip(cut, cut[1:], strict=False)]
    return [x | y for x, y in combinations(bits, 2)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprinted(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, th, fp) of every row, ``th`` being the hash of its text."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"))
    return settled(rows.mapInArrow(_fingerprints(shingle), "id long, th long, fp long"), "simhash")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """(id, th) of one row per component, ``th`` being the hash of its text: the smallest id, rows
    without an id last, and of one id the smallest hash."""
    fps = _fingerprinted(docs, id_col, text_col, shingle)
    key = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    low = fps.groupBy("fp").agg(F.min(key).alias("key"))
    where = groups(low.select("fp"), radius, split).join(low, "fp")
    return where.groupBy("component").agg(F.min("key").alias("key")).select("key.id", "key.th")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """One row per document: doc_id, fingerprint (long) and component_id."""
    fps = _fingerprinted(docs, id_col, text_col, shingle)
    low = fps.groupBy("fp").agg(F.min("id").alias("low"))
    where = groups(low.select("fp"), radius, split).join(low, "fp")
    best = where.groupBy("component").agg(F.min("low").alias("component_id"))
    where = where.join(best, "component").select("fp", "component_id")
    return fps.join(where, "fp").select(F.col("id").alias("doc_id"), F.col("fp").alias("fingerprint"), "component_id")


def groups(nodes: DataFrame, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """(fp, component) for distinct fingerprints ``fp``; a component is named by one of its own."""
    tables = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key"))
                       for t, m in enumerate(masks(radius))))
    met = nodes.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.key")
    hot = met.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = met.join(hot, ["t", "key"])
    # A bucket of g pieces has a cell for each pair of pieces; a row goes to the cells of its piece.
    pieces = F.ceil(F.col("n") / F.lit(split)).cast("int")
    piece = F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")
    met = met.withColumn("g", pieces).withColumn("p", piece)
    met = met.withColumn("q", F.explode(F.sequence(F.lit(0), F.greatest(F.col("g") - 1, F.lit(0)))))
    met = met.where((F.col("g") == 1) | (F.col("g") == 2) & (F.col("q") == 0) | (F.col("g") > 2) & (F.col("q") != F.col("p")))
    cell = F.xxhash64("t", "key", F.when(F.col("g") > 2, F.least("p", "q")).otherwise(0),
                      F.when(F.col("g") > 2, F.greatest("p", "q")).otherwise(0))
    met = met.select(cell.alias("cell"), "fp").repartition("cell").sortWithinPartitions("cell")
    edges = met.select("cell", "fp", F.col("fp").alias("node")).mapInArrow(_links(radius), "a long, b long")
    found = components(edges)
    return nodes.join(found, nodes["fp"] == found["node"], "left").select(
        "fp", F.coalesce("component", "fp").alias("component"))
