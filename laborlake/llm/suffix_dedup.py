"""Suffix-array dedup: removes every byte of a string that starts in an earlier document too.

All suffixes of the corpus would have to be sorted by their first ``length`` bytes; equal
neighbours are repeats.  Only suffixes that can have an equal elsewhere are sorted:

1.  Every window of ``length`` bytes is named by the smallest hash of the shorter strings in
    it.  Equal windows have equal names, and consecutive windows mostly share theirs, so a
    document has about one name for 17 bytes.  Names that occur in one document only are done.
2.  Runs of windows with a repeated name are cut out as segments and sent by their name to one
    block.  Of equal segments a chunk of documents sends the earliest alone: those of larger
    ids are repeats already, those of the same id are its twins and take over what is found
    for it.  A name with very many runs (the edge of a very common passage, in many documents
    or in one) would make a hot block: its windows are sent one by one, by their own bytes.
3.  A block sorts the suffixes of its segments deep-shallow: a multikey quicksort over eight
    bytes a step to the shallow depth, then blind tries for the groups that still agree.
4.  Windows equal to one of a smaller doc_id go back to their documents, whose bytes are cut.

The text is shuffled once, into chunks of documents by hash; names, segments and results move
as packed blocks of bounded size.  Results are exact: the hashes only choose what is compared.

Defined results: null is the empty text; texts under ``length`` bytes lose nothing; rows of
equal doc_id never count as smaller than each other; a null id ranks after all ids.  Repeated
rows are handled each; rows alike in id and text that fill a chunk together travel as counted
pieces over many chunks.  An empty table gives an empty result.  Only the id and text columns
are read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlake.llm.common import blocks_for, release, settled

LENGTH = 50
CHUNK_BYTES = 4 << 20
BLOCK_BYTES = 4 << 20
HOT_RUNS = 4096
#: Rows alike in id and text from which on, or from ``CHUNK_BYTES`` on, they are counted into pieces.
ALIKE = 1024
#: A name's runs are one byte: the top bit says "in two documents", this one "count in the next column".
_MANY = 127
SHALLOW = 16
#: Parts of a block that are sorted one after another.
PARTS = 8
NO_ID = 2 ** 63 - 1
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * _A
    h ^= b * _B
    h ^= h >> np.uint64(29)
    return h


def window_names(raw: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The name of every window of ``length`` (18 at least) bytes: the smallest hash of its grams."""
    gram = length // 3 + 2
    h = raw.astype(np.uint64) + np.uint64(1)
    size = 1
    while 2 * size <= gram:
        h = _join(h[:-size], h[size:])
        size *= 2
    if size < gram:
        h = _join(h[:len(h) - (gram - size)], h[gram - size:])
    h *= _A
    h ^= h >> np.uint64(31)
    span, have = length - gram + 1, 1
    while 2 * have <= span:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    return np.minimum(h[:len(h) - (span - have)], h[span - have:]) if have < span else h


def name_runs(texts: list[bytes], length: int, part: int = 1 << 20):
    """(name, document, first window, last window) of each run of windows with one name."""
    names, docs, firsts, lasts = [], [], [], []
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= part):
            size += len(texts[to])
            to += 1
        lens = np.array([len(t) for t in texts[at:to]])
        raw = np.frombuffer(b"".join(texts[at:to]), np.uint8)
        if len(raw) >= length:
            m = window_names(raw, length)
            begin = np.r_[0, np.cumsum(lens)[:-1]]
            of = np.repeat(np.arange(len(lens)), lens)[:len(m)]
            inside = (np.arange(len(m)) + length) <= (begin + lens)[of]
            edge = np.r_[True, (m[1:] != m[:-1]) | (of[1:] != of[:-1]) | (inside[1:] != inside[:-1])]
            first = np.flatnonzero(edge)
            last = np.r_[first[1:], len(m)] - 1
            keep = inside[first]
            first, last = first[keep], last[keep]
            names.append(m[first])
            docs.append(of[first] + at)
            firsts.append(first - begin[of[first]])
            lasts.append(last - begin[of[first]])
        at = to
    if not names:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3
    return tuple(map(np.concatenate, (names, docs, firsts, lasts)))


def equal_groups(raw: np.ndarray, pos: np.ndarray, depth: int, shallow: int = SHALLOW):
    """Deep-shallow sort of the suffixes at ``pos``, as far as their first ``depth`` bytes.

    Returns (rows of ``pos``, group) for the suffixes whose first ``depth`` bytes others share.
    """
    word = raw.astype(np.uint64)
    for width, bits in ((1, 8), (2, 16), (4, 32)):
        word = (word[:-width] << np.uint64(bits)) | word[width:]

    def regroup(*keys: np.ndarray):
        order = np.lexsort(keys)
        new = np.zeros(len(order), bool)
        new[:1] = True
        for k in keys:
            s = k[order]
            new[1:] |= s[1:] != s[:-1]
        group = np.cumsum(new) - 1
        size = np.bincount(group)
        keep = size[group] > 1
        return order[keep], group[keep]

    rows = np.arange(len(pos))
    group = np.zeros(len(pos), np.int64)
    # Shallow: multikey quicksort, eight bytes a step; suffixes alone in their group are placed.
    for at in range(0, shallow, 8):
        order, group = regroup(word[pos[rows] + at], group)
        rows = rows[order]
    # Deep: a blind trie for each group.  The first suffix of a group is its path; every other
    # one branches off at its first differing word, and what branches off alike forms a trie.
    done_rows, done_groups, made = [], [], 0
    offsets = [*range(shallow, depth - 8, 8), depth - 8]
    while len(rows):
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        path = pos[rows[np.repeat(first, np.diff(np.r_[first, len(rows)]))]]
        own = pos[rows]
        branch, byte = np.full(len(rows), len(offsets)), np.zeros(len(rows), np.uint64)
        open_ = np.arange(len(rows))
        for i, at in enumerate(offsets):
            w = word[own[open_] + at]
            off = w != word[path[open_] + at]
            branch[open_[off]], byte[open_[off]] = i, w[off]
            open_ = open_[~off]
        same = branch == len(offsets)
        label = np.cumsum(np.r_[True, group[1:] != group[:-1]]) - 1
        count = np.bincount(label[same], minlength=len(first))
        leaf = same & (count[label] > 1)
        done_rows.append(rows[leaf])
        done_groups.append(label[leaf] + made)
        made += len(first)
        rest = ~same
        rows, group, branch, byte = rows[rest], group[rest], branch[rest], byte[rest]
        if len(rows):
            order, group = regroup(byte, branch, group)
            rows = rows[order]
    if not done_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(done_rows), np.concatenate(done_groups)


def _chunk(t: pa.Table) -> tuple[list[int], list[bytes], pa.Table]:
    """The documents of a chunk, in an order that depends on the rows alone."""
    order = np.lexsort((t["th"].to_numpy(), t["id"].to_numpy()))
    t = t.take(pa.array(order))
    return t["id"].to_pylist(), t["text"].to_pylist(), t


def _rows(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.table([pa.array(c, k) for c, (_, k) in zip(cols, schema, strict=True)], names=[n for n, _ in schema])


_NAMES = [("block", pa.int32()), ("chunk", pa.int32()), ("names", pa.binary()), ("runs", pa.binary()), ("many", pa.binary())]
_REPEATED = [("chunk", pa.int32()), ("names", pa.binary()), ("hot", pa.binary())]
_SEGMENTS = [("block", pa.int32()), ("chunk", pa.int32()), ("found", pa.binary()), ("twins", pa.binary()), ("data", pa.binary()),
             ("parts", pa.binary()), ("length", pa.binary()), ("id", pa.binary()), ("doc", pa.binary()), ("start", pa.binary())]
_SPANS = [("chunk", pa.int32()), ("spans", pa.binary()), ("twins", pa.binary())]


def _sql(schema: list[tuple[str, pa.DataType]]) -> str:
    return ", ".join(f"{n} {'int' if k == pa.int32() else 'binary'}" for n, k in schema)


def _names(length: int, blocks: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        chunk = key[0].as_py()
        _, texts, _ = _chunk(t)
        name, doc, _, _ = name_runs(texts, length)
        order = np.lexsort((doc, name, name % np.uint64(blocks)))
        name, doc = name[order], doc[order]
        if not len(name):
            return _rows(_NAMES, [])
        first = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
        size = np.diff(np.r_[first, len(name)])
        two = doc[first] != doc[first + size - 1]
        runs = (np.minimum(size, _MANY) + 128 * two).astype(np.uint8)
        name = name[first]
        block = (name % np.uint64(blocks)).astype(np.int64)
        cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        ends = np.r_[cut[1:], len(name)]
        return _rows(_NAMES, [(int(block[a]), chunk, name[a:b].tobytes(), runs[a:b].tobytes(),
                               size[a:b][size[a:b] >= _MANY].astype(np.int64).tobytes())
                              for a, b in zip(cut, ends, strict=True)])
    return run


def _repeated(hot_runs: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint64) for x in t["names"].to_pylist()]
        name = np.concatenate(parts)
        mark = np.concatenate([np.frombuffer(x, np.uint8) for x in t["runs"].to_pylist()])
        runs, two = (mark & _MANY).astype(np.int64), mark > _MANY
        runs[runs == _MANY] = np.concatenate([np.frombuffer(x, np.int64) for x in t["many"].to_pylist()])
        chunk = np.repeat(t["chunk"].to_numpy(), [len(p) for p in parts])
        order = np.argsort(name, kind="stable")
        name, runs, two, chunk = name[order], runs[order], two[order], chunk[order]
        first = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
        size = np.diff(np.r_[first, len(name)])
        total = np.add.reduceat(runs, first)
        again = (size > 1) | np.logical_or.reduceat(two, first)
        of = np.repeat(np.arange(len(first)), size)
        keep = again[of]
        name, chunk, hot = name[keep], chunk[keep], (total > hot_runs)[of][keep].astype(np.uint8)
        order = np.argsort(chunk, kind="stable")
        name, chunk, hot = name[order], chunk[order], hot[order]
        if not len(chunk):
            return _rows(_REPEATED, [])
        cut = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
        ends = np.r_[cut[1:], len(name)]
        return _rows(_REPEATED, [(int(chunk[a]), name[a:b].tobytes(), hot[a:b].tobytes())
                                 for a, b in zip(cut, ends, strict=True)])
    return run


def _segments(length: int, blocks: int):
    def run(key: tuple, docs: pa.Table, replies: pa.Table) -> pa.Table:
        chunk = key[0].as_py()
        if not docs.num_rows or not replies.num_rows:
            return _rows(_SEGMENTS, [])
        import xxhash
        ids, texts, _ = _chunk(docs)
        wanted = np.concatenate([np.frombuffer(x, np.uint64) for x in replies["names"].to_pylist()])
        hot = np.concatenate([np.frombuffer(x, np.uint8) for x in replies["hot"].to_pylist()])
        order = np.argsort(wanted)
        wanted, hot = wanted[order], hot[order]
        name, doc, first, last = name_runs(texts, length)
        at = np.minimum(np.searchsorted(wanted, name), len(wanted) - 1)
        hit = wanted[at] == name
        doc, first, last, hot = doc[hit], first[hit], last[hit], hot[at[hit]]
        order = np.argsort(doc, kind="stable")
        out: dict[int, list[tuple]] = {}
        seen: dict[bytes, tuple[int, int, int]] = {}
        found: list[tuple[int, int, int]] = []
        twins: list[tuple[int, int, int, int, int]] = []
        # Windows that can be equal share their name, so they share its block and part.
        place = (name % np.uint64(blocks * PARTS)).astype(np.int64)
        for d, a, b, h, p in zip(*(x[order].tolist() for x in (doc, first, last, hot, place[hit])), strict=True):
            text, own = texts[d], ids[d]
            cuts = [(a, text[a:b + length])] if not h else [(x, text[x:x + length]) for x in range(a, b + 1)]
            for start, data in cuts:
                # Documents come in ascending order, so whoever sent these bytes before is not larger.
                sent = seen.setdefault(data, (own, d, start))
                if sent[0] < own:
                    found.append((d, start, start + len(data)))
                    continue
                if sent[1:] != (d, start):
                    twins.append((d, start, sent[1], sent[2], len(data)))
                    continue
                at = xxhash.xxh64_intdigest(data) % (blocks * PARTS) if h else p
                out.setdefault(at % blocks, []).append((at // blocks, data, own, d, start))
        rows = [(next(iter(out), 0), chunk, np.array(found, np.uint32).tobytes(), np.array(twins, np.uint32).tobytes(), *(b"",) * 6)]
        for p, segs in out.items():
            segs.sort(key=lambda x: x[0])
            part, data, own, d, start = zip(*segs, strict=True)
            rows.append((p, chunk, b"", b"", pa.compress(b"".join(data), codec="zstd", asbytes=True),
                         np.bincount(part, minlength=PARTS).astype(np.uint32).tobytes(),
                         np.array([len(x) for x in data], np.uint32).tobytes(), np.array(own, np.int64).tobytes(),
                         np.array(d, np.uint32).tobytes(), np.array(start, np.uint32).tobytes()))
        result = _rows(_SEGMENTS, rows)
        del out, seen, rows
        release()
        return result
    return run


def _covered(data: list[bytes], size, own, doc, start, chunk, length: int) -> Iterator[tuple[int, bytes]]:
    """(chunk, spans) of the segments' windows that are equal to one of a smaller id."""
    raw = np.frombuffer(b"".join(data) + bytes(8), np.uint8)
    begin = np.cumsum(size) - size
    windows = size - length + 1
    seg = np.repeat(np.arange(len(size), dtype=np.int32), windows)
    inner = (np.arange(len(seg)) - np.repeat(np.cumsum(windows) - windows, windows)).astype(np.int32)
    hit, group = equal_groups(raw, begin[seg] + inner, length)
    if not len(hit):
        return
    least = np.full(int(group.max()) + 1, NO_ID)
    np.minimum.at(least, group, own[seg[hit]])
    hit = np.sort(hit[own[seg[hit]] > least[group]])
    if not len(hit):
        return
    s, i = seg[hit], inner[hit]
    first = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (i[1:] != i[:-1] + 1)])
    last = np.r_[first[1:], len(hit)] - 1
    spans = np.stack([doc[s[first]], start[s[first]] + i[first], start[s[first]] + i[last] + length], 1).astype(np.uint32)
    where = chunk[s[first]]
    order = np.argsort(where, kind="stable")
    spans, where = spans[order], where[order]
    cut = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
    for a, b in zip(cut, np.r_[cut[1:], len(where)], strict=True):
        yield int(where[a]), spans[a:b].tobytes()


def _compare(length: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        rows = [(c, f, w) for c, f, w in zip(*(t[n].to_pylist() for n in ("chunk", "found", "twins")), strict=True) if f or w]
        sent = []
        for r in t.select(["chunk", "data", "parts", "length", "id", "doc", "start"]).to_pylist():
            if r["length"]:
                size = np.frombuffer(r["length"], np.uint32).astype(np.int64)
                sent.append((r["chunk"], pa.decompress(r["data"], int(size.sum()), codec="zstd", asbytes=True),
                             np.r_[0, np.cumsum(np.frombuffer(r["parts"], np.uint32), dtype=np.int64)], size, np.r_[0, np.cumsum(size)],
                             np.frombuffer(r["id"], np.int64), np.frombuffer(r["doc"], np.uint32), np.frombuffer(r["start"], np.uint32)))
        for part in range(PARTS if sent else 0):
            cols: list[list] = [[] for _ in range(6)]
            for chunk, data, parts, size, ends, own, doc, start in sent:
                a, b = parts[part], parts[part + 1]
                if a < b:
                    for col, x in zip(cols, (data[ends[a]:ends[b]], size[a:b], own[a:b], doc[a:b], start[a:b],
                                             np.full(b - a, chunk, np.int32)), strict=True):
                        col.append(x)
            if cols[0]:
                rows += ((c, f, b"") for c, f in _covered(cols[0], *map(np.concatenate, cols[1:]), length))
        result = _rows(_SPANS, rows)
        del sent, rows
        release()
        return result
    return run


def _with_twins(got: np.ndarray, twins: np.ndarray, length: int) -> np.ndarray:
    """The spans (document, start, end) and, for every twin, those of the segment that was sent.

    A segment's spans begin at its windows, and no two segments of a document share a window."""
    first = got[:, 0] << 32 | got[:, 1]
    got = got[np.argsort(first, kind="stable")]
    first = np.sort(first)
    doc, start, of, at, size = twins.T
    low = np.searchsorted(first, of << 32 | at)
    high = np.searchsorted(first, of << 32 | (at + size - length), "right")
    n = high - low
    which = np.repeat(np.arange(len(twins)), n)
    row = got[np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + low[which]]
    shift = (start - at)[which]
    return np.concatenate([got, np.stack([doc[which], row[:, 1] + shift, row[:, 2] + shift], 1)])


def _cut(length: int):
    def run(key: tuple, docs: pa.Table, spans: pa.Table) -> pa.Table:
        def packed(name: str, width: int) -> np.ndarray:
            return np.concatenate([np.zeros((0, width), np.int64),
                                   *(np.frombuffer(x, np.uint32).reshape(-1, width) for x in spans[name].to_pylist())])
        return _cut_spans(docs, _with_twins(packed("spans", 3), packed("twins", 5), length))
    return run


def _cut_spans(docs: pa.Table, got: np.ndarray) -> pa.Table:
    _, texts, t = _chunk(docs)
    got = got[np.lexsort((got[:, 1], got[:, 0]))].tolist()
    of: dict[int, list[list[int]]] = {}
    for d, a, b in got:
        runs = of.setdefault(d, [])
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    kept, removed, n_spans, where = [], [], [], []
    for d, text in enumerate(texts):
        runs, at, parts = of.get(d, []), 0, []
        for a, b in runs:
            parts.append(text[at:a])
            at = b
        parts.append(text[at:])
        kept.append(b"".join(parts))
        removed.append(len(text) - len(kept[-1]))
        n_spans.append(len(runs))
        where.append([x for run in runs for x in run])
    return pa.table([t["id"], t["th"], t["n"], pa.array([len(x) for x in texts], pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(n_spans, pa.int64()), pa.array(where, pa.list_(pa.int64())), pa.array(kept, pa.binary())],
                    names=["id", "th", "n", "n_bytes", "n_removed", "n_spans", "spans", "kept"])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
          chunk_bytes: int = CHUNK_BYTES, block_bytes: int = BLOCK_BYTES, hot_runs: int = HOT_RUNS,
          alike: int = ALIKE) -> DataFrame:
    """One row per document: doc_id, th (a hash of the text), n_bytes, n_removed, n_spans, the
    removed spans (start, end, start, end ...) and the kept bytes."""
    if length < 24:
        raise ValueError("windows under 24 bytes have no names")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("th"),
                       text.cast("binary").alias("text"))
    keys = rows.groupBy("id", "th").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    many = (F.col("n") >= alike) | ((F.col("n") > 1) & (F.col("bytes") >= chunk_bytes))
    head = keys.agg(F.sum("bytes").alias("bytes"), F.count_if(many).alias("many")).first()
    chunks, blocks = (blocks_for(head["bytes"] or 0, b, 2 ** 31 - 1) for b in (chunk_bytes, block_bytes))
    one = rows.select("id", "th", "text", F.lit(1).alias("n"), F.lit(0).alias("piece"))
    if head["many"]:
        # A piece stands for at most ``alike`` rows; equal ids remove nothing from each other, so
        # it does not matter that the pieces lie in different chunks.
        held = settled(keys.where(many).select("id", "th"), "alike")
        pieces = rows.join(held, ["id", "th"], "left_semi").groupBy("id", "th", "text").agg(F.count(F.lit(1)).alias("all"))
        pieces = pieces.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("all") - 1) / alike).cast("int"))))
        size = F.least(F.lit(alike), F.col("all") - F.col("piece") * alike).cast("int")
        one = (one.join(held, ["id", "th"], "left_anti").select("id", "th", "text", "n", "piece")
               .unionByName(pieces.select("id", "th", "text", size.alias("n"), "piece")))
    rows = one.select("id", "th", "text", "n", F.pmod(F.xxhash64("id", "th", "piece"), F.lit(chunks)).cast("int").alias("chunk"))
    names = rows.groupBy("chunk").applyInArrow(_names(length, blocks), _sql(_NAMES))
    repeated = names.groupBy("block").applyInArrow(_repeated(hot_runs), _sql(_REPEATED))
    segments = rows.groupBy("chunk").cogroup(repeated.groupBy("chunk")).applyInArrow(_segments(length, blocks), _sql(_SEGMENTS))
    spans = segments.groupBy("block").applyInArrow(_compare(length), _sql(_SPANS))
    out = rows.groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInArrow(
        _cut(length), "id long, th long, n int, n_bytes long, n_removed long, n_spans long, spans array<long>, kept binary")
    if head["many"]:
        out = out.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "th", "n_bytes", "n_removed", "n_spans",
                      "spans", "kept")
