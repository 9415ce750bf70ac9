"""Quality classifier on supervised subword embeddings.

A text is the bag of its words, its word pairs and its character n-grams, each hashed to a row
of one embedding table.  The rows are averaged, a softmax layer turns the average into class
probabilities, and table and layer are learned together by stochastic gradient descent in
numpy.  After training only the product of table and layer is needed: one number per bucket,
so scoring is a gather and a mean over whole texts.

Learning is bounded: at most ``max_train`` labelled rows, the ones whose id hashes lowest.
Their features are made on the executors; the driver gets at most a bag of ``buckets`` counts
for each.  Scoring covers every row.

Defined results: null is the empty text; a text without features gets the model's prior.
Labels that are null or whose document is missing teach nothing; contradicting labels of one
id count as their minimum.  Without any label of both classes every score is the share of
ones (0.5 without labels).  Repeated rows are scored each.  Only id and text are read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 18
DIM = 12
GRAMS = (2, 3, 5)
MAX_TRAIN = 2000
EPOCHS = 6
RATE = 1.0
PART = 1 << 19
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_R = 0xD6E8FEB86659FD93


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _A
    return h ^ (h >> np.uint64(29))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64."""
    inverse = pow(_R, -1, 1 << 64)
    up, down = np.full(n, _R, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Features:
    """Hashed features of many texts at once."""

    def __init__(self, buckets: int = BUCKETS, grams: tuple[int, ...] = GRAMS):
        self.buckets, self.grams = np.uint64(buckets), grams
        self.up, self.down = _powers(PART + 1)

    def _grown(self, n: int) -> None:
        if n > len(self.up):
            self.up, self.down = _powers(n)

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(feature, text) pairs, in no particular order."""
        lens = np.array([len(t) for t in texts], np.int64)
        raw = np.frombuffer(b"".join(texts), np.uint8)
        n = len(raw)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._grown(n + 1)
        of = np.repeat(np.arange(len(lens)), lens)
        ids, docs = [], []
        h = raw.astype(np.uint64) + np.uint64(1)
        rolling = h.copy()
        for size in range(2, max(self.grams) + 1):
            if size > n:
                break
            rolling = rolling[:-1] * _B + h[size - 1:]
            if size in self.grams:
                inside = of[:n - size + 1] == of[size - 1:]
                ids.append(_mix(rolling[inside] + np.uint64(size)))
                docs.append(of[:n - size + 1][inside])
        space = (raw == 32) | ((raw >= 9) & (raw <= 13))
        word = ~space
        new = np.r_[True, of[1:] != of[:-1]]
        start = np.flatnonzero(word & (new | np.r_[True, space[:-1]]))
        end = np.flatnonzero(word & np.r_[new[1:] | space[1:], True]) + 1
        total = np.r_[np.zeros(1, np.uint64), np.cumsum(h * self.up[:n], dtype=np.uint64)]
        words = _mix((total[end] - total[start]) * self.down[start])
        ids.append(words)
        docs.append(of[start])
        # A word that repeats its neighbour meets all others that do, in the bucket of zero.
        pair = of[start[1:]] == of[start[:-1]]
        ids.append(_mix(words[1:][pair] ^ words[:-1][pair]))
        docs.append(of[start[1:]][pair])
        return (np.concatenate(ids) % self.buckets).astype(np.int64), np.concatenate(docs)

    def parts(self, texts: list[bytes]) -> Iterator[tuple[int, int]]:
        """Ranges of texts of about PART bytes together."""
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= PART):
                size += len(texts[to])
                to += 1
            yield at, to
            at = to


def sgd(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, buckets: int, dim: int = DIM,
        epochs: int = EPOCHS, rate: float = RATE, seed: int = 42) -> tuple[np.ndarray, float]:
    """Learn table and softmax layer; returns (logit of class 1 against 0 per bucket, bias)."""
    rng = np.random.default_rng(seed)
    table = ((rng.random((buckets, dim)) - 0.5) / dim).astype(np.float32)
    layer, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    target = np.eye(2, dtype=np.float32)[labels]
    steps, done = epochs * len(bags), 0
    shares = [(i, (c / max(1, c.sum())).astype(np.float32)) for i, c in bags]
    for _ in range(epochs):
        for j in rng.permutation(len(bags)):
            ids, share = shares[j]
            lr = np.float32(rate * (1 - done / steps))
            done += 1
            rows = table[ids]
            mean = share @ rows
            z = mean @ layer + bias
            e = np.exp(z - z.max())
            g = e / e.sum() - target[j]
            back = layer @ g
            layer -= lr * np.outer(mean, g)
            bias -= lr * np.float32(0.1) * g
            # Shares are small for long texts; rare rows move by their share times the text's size.
            table[ids] = rows - (lr * np.float32(len(ids)) * share)[:, None] * back[None, :] * np.float32(0.05)
    return (table @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def _bags(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features(buckets)
        for b in batches:
            texts = [(t or "").encode() for t in b.column(1).to_pylist()]
            ids, counts = [], []
            for t in texts:
                f, c = np.unique(make.of([t])[0], return_counts=True)
                ids.append(f.astype(np.uint32).tobytes())
                counts.append(c.astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())],
                                             ["id", "label", "ids", "counts"])
    return run


def learn(docs: DataFrame, labels: DataFrame, label_col: str, usable: Column, id_col: str = "doc_id",
          text_col: str = "text", max_train: int = MAX_TRAIN, buckets: int = BUCKETS, seed: int = 42) -> tuple[np.ndarray, float]:
    """Learn from at most ``max_train`` of the labelled rows that ``usable`` accepts."""
    chosen = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & usable)
              .groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(F.col(label_col).cast("int")).alias("label"))
              .orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(max_train))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # One text of each id: a repeated id would bring a bag to the driver for each of its rows.
    one = F.min(F.struct(F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")).alias("one")
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(one).select("id", "one.text", "label")
    got = rows.mapInArrow(_bags(buckets), "id long, label int, ids binary, counts binary").collect()
    got.sort(key=lambda r: (r["id"], r["label"], bytes(r["ids"]), bytes(r["counts"])))
    y = np.array([1 if r["label"] else 0 for r in got], np.int64)
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        share = min(1 - 1e-6, max(1e-6, share))
        return np.zeros(buckets, np.float32), float(np.log(share / (1 - share)))
    bags = [(np.frombuffer(r["ids"], np.uint32).astype(np.int64), np.frombuffer(r["counts"], np.uint32).astype(np.float64)) for r in got]
    return sgd(bags, y, buckets, seed=seed)


def _scorer(weights: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features(len(weights))
        for b in batches:
            texts = [(t or "").encode() for t in b.column(1).to_pylist()]
            z = np.full(len(texts), bias)
            for at, to in make.parts(texts):
                f, of = make.of(texts[at:to])
                n = np.bincount(of, minlength=to - at)
                z[at:to] += np.bincount(of, weights=weights[f], minlength=to - at) / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60))))], ["id", "score"])
    return run


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scorer(*model), "id long, score double").withColumnRenamed("id", "doc_id")
