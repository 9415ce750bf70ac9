"""Repair of conversations whose roles do not follow the grammar: a generalised LR parse with edits.

The roles' initials have to read ``(s?(ua)+)?``.  An LR table is built from the rules below.  A
row can be kept, get another role (user or assistant), or be deleted; rows of user or assistant
without text can be inserted anywhere.  Every edit is a shift (or, for a deletion, a step that
leaves the stack as it is) of all stacks alive; stacks share their lower parts, and of those with
equal tops only the one with the smallest (cost, audit) goes on, which is right because a top
alone decides what may follow.  The audit has one letter per edit (Delete, Insert, Keep, Rerole);
at equal cost and position no audit is the beginning of another, so the smallest stays smallest
whatever follows.  Blank and repeated rows can only be deleted.

The parse needs no text: rows travel as role, flags and a 128-bit hash of role and text.  They
are range-partitioned by conversation and turn, so a conversation of any length spans as many
partitions as it fills.  A task parses its rows in one pass and keeps only the live audits.  A
part of a conversation cut by a partition's edge is parsed from every stack top that it could
start with; its (start, end, cost, audit) tables are put together per conversation afterwards.
Texts join the edits by conversation, turn and hash, a key that no two kept rows share.

Defined results: null roles and texts are one space; rows of a null conversation are one
conversation; null turns come first; rows of one turn stand by role, then by the hash.  Turns
that are all null leave no gap.  An empty table gives an empty result.  Other columns are not read.
"""
from __future__ import annotations

import os.path
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laborlake.llm.common import settled

SPACES = " \t\n\x0b\f\r"
ROLES = {"u": "user", "a": "assistant"}
LEGAL_PAIRS = frozenset(("su", "ua", "au"))
END = "$"
RULES = (("Talk", ()), ("Talk", ("Body",)), ("Talk", ("s", "Body")),
         ("Body", ("Pair",)), ("Body", ("Body", "Pair")), ("Pair", ("u", "a")))
INSERT, REROLE, DELETE = 2, 2, 3
#: A stack that costs this much more than another can no longer win: two more inserts, or an
#: insert and a deletion, let the cheaper one go on like the dearer one.
HOPELESS = INSERT + DELETE + 1
FLUSH = 64

Stack = tuple  # (state, stack below or None)
Live = dict    # top state -> (cost, audit, stack)


@lru_cache(maxsize=None)
def lr_table(rules=RULES):
    """(steps, reductions): the states' moves by symbol, and the rules to reduce by state and next terminal."""
    names = {left for left, _ in rules}
    top = rules[0][0]

    def closed(items):
        items = set(items)
        todo = list(items)
        while todo:
            left, right, dot = todo.pop()
            fresh = {(n, r, 0) for n, r in rules if dot < len(right) and n == right[dot]} - items
            items |= fresh
            todo += fresh
        return frozenset(items)

    begins = {n: set() for n in names}
    follow = {n: {END} if n == top else set() for n in names}
    for _ in range(len(rules) * len(rules)):
        for left, right in rules:
            if right:
                begins[left] |= begins.get(right[0], {right[0]})
            for x, after in zip(right, (*right[1:], None)):
                if x in names:
                    follow[x] |= follow[left] if after is None else begins.get(after, {after})
    start = closed((n, r, 0) for n, r in rules if n == top)
    states, steps, todo = {start: 0}, {}, [start]
    while todo:
        here = todo.pop()
        for symbol in sorted({r[d] for _, r, d in here if d < len(r)}):
            there = closed((n, r, d + 1) for n, r, d in here if d < len(r) and r[d] == symbol)
            if there not in states:
                states[there] = len(states)
                todo.append(there)
            steps[states[here], symbol] = states[there]
    reductions = {}
    for items, state in states.items():
        for n, r, d in sorted(items):
            for t in follow[n] if d == len(r) else ():
                reductions.setdefault((state, t), []).append((n, len(r)))
    return steps, reductions


def _popped(stack: Stack, n: int) -> Stack:
    for _ in range(n):
        stack = stack[1]
    return stack


@lru_cache(maxsize=None)
def shifted(stack: Stack, terminal: str) -> tuple[Stack, ...]:
    """Every stack that ``stack`` becomes by reductions and the shift of ``terminal``."""
    steps, reductions = lr_table()
    out, todo = [], [stack]
    while todo:
        at = todo.pop()
        if (at[0], terminal) in steps:
            out.append((steps[at[0], terminal], at))
        for name, n in reductions.get((at[0], terminal), ()):
            below = _popped(at, n)
            todo.append((steps[below[0], name], below))
    return tuple(out)


@lru_cache(maxsize=None)
def complete(stack: Stack) -> bool:
    """Whether the roles may end here."""
    steps, reductions = lr_table()
    todo = [stack]
    while todo:
        at = todo.pop()
        for name, n in reductions.get((at[0], END), ()):
            below = _popped(at, n)
            if name == RULES[0][0] and below[1] is None:
                return True
            todo.append((steps[below[0], name], below))
    return False


EMPTY: Stack = (0, None)


@lru_cache(maxsize=None)
def entries() -> dict[int, Stack]:
    """A stack for each top that a conversation can have between two rows, found from the empty one."""
    found, todo = {EMPTY[0]: EMPTY}, [EMPTY]
    while todo:
        stack = todo.pop()
        for t in ("s", *ROLES):
            for new in shifted(stack, t):
                if new[0] not in found:
                    found[new[0]] = new
                    todo.append(new)
    return found


def _offer(live: Live, cost: int, audit: str, stack: Stack) -> bool:
    held = live.get(stack[0])
    if held is None or (cost, audit) < held[:2]:
        live[stack[0]] = (cost, audit, stack)
        return True
    return False


def with_inserts(live: Live) -> Live:
    todo = list(live.values())
    while todo:
        cost, audit, stack = todo.pop()
        for t in ROLES:
            for new in shifted(stack, t):
                if _offer(live, cost + INSERT, audit + "I", new):
                    todo.append(live[new[0]])
    best = min(v[0] for v in live.values())
    return {k: v for k, v in live.items() if v[0] < best + HOPELESS}


def consume(live: Live, initial: str, truncated: bool) -> Live:
    """One row that may stay."""
    out: Live = {}
    late = int(truncated)
    for cost, audit, stack in live.values():
        _offer(out, cost + DELETE, audit + "D", stack)
        for t in ("s", *ROLES):
            if t == initial:
                for new in shifted(stack, t):
                    _offer(out, cost + late, audit + "K", new)
            elif t in ROLES:
                for new in shifted(stack, t):
                    _offer(out, cost + REROLE + late, audit + "R", new)
    return with_inserts(out)


def delete(live: Live, n: int) -> Live:
    """``n`` rows that have to go.  An insert stands best after them, so one round of inserts is enough."""
    return with_inserts({k: (cost + n * DELETE, audit + "D" * n, stack) for k, (cost, audit, stack) in live.items()})


class Parse:
    """The live stacks of one run from one starting stack; what all audits share is put aside."""

    def __init__(self, stack: Stack):
        self.live, self.settled, self.seen = with_inserts({stack[0]: (0, "", stack)}), [], 0

    def row(self, initial: str, truncated: bool, stays: bool, gone: int) -> None:
        if stays:
            self.live = consume(self.live, initial, truncated)
        if gone:
            self.live = delete(self.live, gone)
        self.seen += 1
        if self.seen % FLUSH == 0:
            shared = os.path.commonprefix([v[1] for v in self.live.values()])
            if shared:
                self.settled.append(shared)
                self.live = {k: (c, a[len(shared):], s) for k, (c, a, s) in self.live.items()}

    def ends(self) -> list[tuple[int, int, str]]:
        before = "".join(self.settled)
        return [(top, cost, before + audit) for top, (cost, audit, _) in self.live.items()]

    def best(self) -> tuple[int, str]:
        cost, audit = min(v[:2] for v in self.live.values() if complete(v[2]))
        return cost, "".join(self.settled) + audit


def repaired_roles(rows: Iterable[tuple[str, bool, bool]]) -> tuple[int, str]:
    """(cost, audit) of one conversation in memory: rows of (initial, truncated, must go)."""
    parse = Parse(EMPTY)
    for initial, truncated, must_go in rows:
        parse.row(initial, truncated, not must_go, int(must_go))
    return parse.best()


# -- columns -------------------------------------------------------------------------------------

def _keys(conv: str, turn: str) -> list[Column]:
    return [F.col(conv).isNull().alias("cn"), F.coalesce(F.col(conv).cast("long"), F.lit(0)).alias("ck"),
            F.col(turn).isNotNull().alias("tk"), F.coalesce(F.col(turn).cast("long"), F.lit(0)).alias("tv")]


def _or_space(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


CONV = ["cn", "ck"]
ROW = [*CONV, "tk", "tv", "h1", "h2"]


def _read(talks: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    rows = talks.select(*_keys(conv, turn), _or_space(role).alias("role"), _or_space(text).alias("text"))
    return rows.select(*rows.columns, F.xxhash64(F.lit(1), "role", "text").alias("h1"), F.xxhash64(F.lit(2), "role", "text").alias("h2"))


def _flagged(rows: DataFrame) -> DataFrame:
    """One row for each set of equal rows of a turn, with their number and whether one of them
    is the first of its role and text in the conversation."""
    bare = F.rtrim("text", F.lit(SPACES))
    light = rows.select(*ROW, "role", (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("truncated"))
    alike = light.groupBy(*ROW).agg(F.count(F.lit(1)).alias("n"), F.min("role").alias("role"), F.max("blank").alias("blank"),
                                    F.max("truncated").alias("truncated"))
    first = (alike.groupBy(*CONV, "h1", "h2").agg(F.min("tk").alias("tk"), F.min(F.when(F.col("tk"), F.col("tv"))).alias("tv"))
             .select(*CONV, "tk", F.when(F.col("tk"), F.col("tv")).otherwise(0).cast("long").alias("tv"), "h1", "h2", F.lit(True).alias("first")))
    return alike.join(first, ROW, "left").select(*ROW, "n", "role", "blank", "truncated", F.col("first").isNotNull().alias("first"))


_PASS = pa.schema([
    ("cn", pa.bool_()), ("ck", pa.int64()), ("part", pa.int32()), ("i", pa.int64()),
    ("tk", pa.bool_()), ("tv", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()),
    ("stats", pa.list_(pa.int64())), ("edges", pa.list_(pa.string())), ("whole", pa.bool_()),
    ("paths", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))])
_PASS_SQL = ("cn boolean, ck long, part int, i long, tk boolean, tv long, h1 long, h2 long, stats array<bigint>, edges array<string>, "
             "whole boolean, paths array<struct<start:int,stop:int,cost:bigint,audit:string>>")
BLANK, DUPLICATE, TRUNCATED, ILLEGAL, DISTINCT, LOW, HIGH = range(7)


class Part:
    """What one task has seen of one conversation."""

    def __init__(self, opens: bool):
        # The first conversation of a partition may have begun in the one before it.
        self.parses = {k: Parse(s) for k, s in (entries().items() if opens else [(EMPTY[0], EMPTY)])}
        self.n, self.first, self.last = 0, None, None
        self.stats: list = [0, 0, 0, 0, 0, None, None]

    def row(self, turn: int | None, n: int, initial: str, blank: bool, truncated: bool, first: bool) -> int | None:
        """Takes ``n`` equal rows; the place of the one that may stay, if one may."""
        s = self.stats
        stays = first and not blank
        s[BLANK] += n if blank else 0
        s[DUPLICATE] += 0 if blank else n - first
        s[TRUNCATED] += stays and truncated
        s[ILLEGAL] += n - 1 + (self.last is not None and self.last + initial not in LEGAL_PAIRS)
        if turn is not None:
            s[DISTINCT] += turn != s[HIGH]
            s[LOW], s[HIGH] = turn if s[LOW] is None else s[LOW], turn
        self.first, self.last = initial if self.first is None else self.first, initial
        for p in self.parses.values():
            p.row(initial, truncated, stays, n - stays)
        at, self.n = self.n, self.n + n
        return at if stays else None

    def record(self, whole: bool) -> dict:
        if whole:
            cost, audit = self.parses[EMPTY[0]].best()
            paths = [(EMPTY[0], EMPTY[0], cost, audit)]
        else:
            paths = [(start, *end) for start, p in self.parses.items() for end in p.ends()]
        return {"stats": self.stats, "edges": [self.first, self.last], "whole": whole,
                "paths": [dict(zip(("start", "stop", "cost", "audit"), p)) for p in paths]}


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext
    number = TaskContext.get().partitionId()
    here, part, opens = None, None, True
    for b in batches:
        out = []
        for cn, ck, tk, tv, h1, h2, n, role, blank, truncated, first in zip(*(c.to_pylist() for c in b.columns)):
            if (cn, ck) != here:
                if part is not None:
                    out.append({"cn": here[0], "ck": here[1], "part": number, **part.record(not opens)})
                    opens = False
                here, part = (cn, ck), Part(opens)
            at = part.row(tv if tk else None, n, role[:1], blank, truncated, first)
            if at is not None:
                out.append({"cn": cn, "ck": ck, "part": number, "i": at, "tk": tk, "tv": tv, "h1": h1, "h2": h2})
        if out:
            yield pa.RecordBatch.from_pylist(out, _PASS)
    if part is not None:
        yield pa.RecordBatch.from_pylist([{"cn": here[0], "ck": here[1], "part": number, **part.record(False)}], _PASS)


_JOINED_SQL = ("cn boolean, ck long, stats array<bigint>, cost long, "
               "pieces array<struct<part:int,audit:string,before:bigint>>, odd boolean")
_JOINED = pa.schema([("cn", pa.bool_()), ("ck", pa.int64()), ("stats", pa.list_(pa.int64())), ("cost", pa.int64()),
                     ("pieces", pa.list_(pa.struct([("part", pa.int32()), ("audit", pa.string()), ("before", pa.int64())]))),
                     ("odd", pa.bool_())])


def cheapest_path(tables: Iterable[list[tuple[int, int, int, str]]]) -> tuple[int, list[str]]:
    """The cheapest chain of (start, stop, cost, audit) entries, one of each table, from the
    empty stack to a complete one: its cost and audits."""
    live: dict = {EMPTY[0]: (0, "", None)}  # what all tails share is put aside; the chain holds whole audits
    for table in tables:
        out: dict = {}
        for start, stop, cost, audit in table:
            if start in live:
                c, tail, chain = live[start]
                new = (c + cost, tail + audit, (chain, audit))
                if stop not in out or new[:2] < out[stop][:2]:
                    out[stop] = new
        best = min(v[0] for v in out.values())
        out = {k: v for k, v in out.items() if v[0] < best + HOPELESS}
        shared = len(os.path.commonprefix([v[1] for v in out.values()]))
        live = {k: (c, tail[shared:], chain) for k, (c, tail, chain) in out.items()}
    cost, _, chain = min((v for k, v in live.items() if complete(entries()[k])), key=lambda v: v[:2])
    audits = []
    while chain is not None:
        chain, audit = chain
        audits.append(audit)
    return cost, audits[::-1]


def kept_in(audit: str) -> int:
    return len(audit) - audit.count("D")


def _join_parts(t: pa.Table) -> pa.Table:
    """The parts of one conversation, in order of the partitions."""
    parts = sorted(t.to_pylist(), key=lambda p: p["part"])
    cost, audits = cheapest_path([(p["start"], p["stop"], p["cost"], p["audit"]) for p in part["paths"]] for part in parts)
    stats: list = [0, 0, 0, 0, 0, None, None]
    last = None
    for part in parts:
        s = part["stats"]
        for k in (BLANK, DUPLICATE, TRUNCATED, ILLEGAL, DISTINCT):
            stats[k] += s[k]
        if last is not None:
            stats[ILLEGAL] += last + part["edges"][0] not in LEGAL_PAIRS
        if s[LOW] is not None:
            stats[DISTINCT] -= s[LOW] == stats[HIGH]
            stats[LOW], stats[HIGH] = s[LOW] if stats[LOW] is None else stats[LOW], s[HIGH]
        last = part["edges"][1]
    pieces, before = [], 0
    for part, audit in zip(parts, audits):
        pieces.append({"part": part["part"], "audit": audit, "before": before})
        before += kept_in(audit)
    return pa.Table.from_pylist([{"cn": parts[0]["cn"], "ck": parts[0]["ck"], "stats": stats, "cost": cost, "pieces": pieces,
                                  "odd": before % 2 == 1}], _JOINED)


_EDITS_SQL = "cn boolean, ck long, part int, i long, pos long, action string, role string"
_EDITS = pa.schema([("cn", pa.bool_()), ("ck", pa.int64()), ("part", pa.int32()), ("i", pa.int64()), ("pos", pa.int64()),
                    ("action", pa.string()), ("role", pa.string())])
AT_ONCE = 16_384


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What stays: one row per letter of an audit other than D.  The role follows from the
    place: only a system row makes their number odd, and it stands first."""
    out: list[tuple] = []
    for b in batches:
        for cn, ck, part, audit, before, odd in zip(*(c.to_pylist() for c in b.columns)):
            i, pos = 0, before
            for x in audit:
                if x != "D":
                    role = None if x == "K" else ROLES["ua"[(pos - odd) % 2]]
                    out.append((cn, ck, part, None if x == "I" else i, pos, x, role))
                    pos += 1
                i += x != "I"
                if len(out) >= AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _EDITS)], schema=_EDITS)
                    out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _EDITS)], schema=_EDITS)


def repair(talks: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(summary, rows).

    The summary has conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of every
    conversation with rows; rows are the repaired ones: conv_id, pos from 0, turn, role, text and
    action (K, R or I).
    """
    read = _read(talks, conv, turn, role, text)
    order = [*CONV, "tk", "tv", "role", "h1", "h2"]
    light = _flagged(read).repartitionByRange(*order).sortWithinPartitions(*order)
    seen = settled(light.mapInArrow(_parse, _PASS_SQL), "turns-parsed")
    parts = seen.where("paths is not null").select(*CONV, "part", "stats", "edges", "whole", "paths")
    path = F.element_at("paths", 1)
    whole = parts.where("whole").select(
        *CONV, "stats", path["cost"].alias("cost"),
        F.array(F.struct("part", path["audit"].alias("audit"), F.lit(0).cast("long").alias("before"))).alias("pieces"),
        (F.char_length(F.replace(path["audit"], F.lit("D"), F.lit(""))) % 2 == 1).alias("odd"))
    cut = parts.where("not whole").select(*CONV, "part", "stats", "edges", "paths").groupBy(*CONV).applyInArrow(_join_parts, _JOINED_SQL)
    joined = settled(whole.unionByName(cut), "turns-joined")

    def stat(k: int) -> Column:
        return F.element_at("stats", k + 1)

    conv_id = F.when(~F.col("cn"), F.col("ck")).alias("conv_id")
    summary = joined.select(
        conv_id, F.coalesce(stat(HIGH) - stat(LOW) + 1 - stat(DISTINCT), F.lit(0)).cast("long").alias("gaps"),
        stat(BLANK).alias("blank"), stat(DUPLICATE).alias("duplicate"), stat(TRUNCATED).alias("truncated"), stat(ILLEGAL).alias("illegal"),
        "cost", F.array_join(F.transform("pieces", lambda p: p["audit"]), "").alias("audit"))
    edits = (joined.select(*CONV, "odd", F.explode("pieces").alias("p"))
             .select(*CONV, "p.part", "p.audit", "p.before", "odd").mapInArrow(_edits, _EDITS_SQL))
    edits = settled(edits, "turns-edits")
    places = seen.where("i is not null").select(*CONV, "part", "i", "tk", "tv", "h1", "h2")
    texts = read.dropDuplicates(ROW).select(*ROW, F.col("role").alias("old"), "text")
    stayed = (edits.where("action <> 'I'").join(places, [*CONV, "part", "i"]).join(texts, ROW)
              .select(conv_id, "pos", F.when(F.col("tk"), F.col("tv")).alias("turn"), F.coalesce("role", "old").alias("role"), "text", "action"))
    added = edits.where("action = 'I'").select(conv_id, "pos", F.lit(None).cast("long").alias("turn"), "role", F.lit("").alias("text"), "action")
    return summary, stayed.unionByName(added)


def damage(talks: DataFrame) -> DataFrame:
    """The faults of the test: by the checksum of ``conv_id:turn`` a row goes, loses its text or
    its full stops, comes twice, or becomes the user's; nulls read as one space."""
    sort = F.pmod(F.crc32(F.concat_ws(":", _or_space("conv_id"), _or_space("turn")).cast("binary")), F.lit(20))
    rows = talks.select("conv_id", "turn", _or_space("role").alias("role"), _or_space("text").alias("text"), sort.alias("sort"))
    text = (F.when(F.col("sort") == 1, F.lit("")).when(F.col("sort") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    times = F.when(F.col("sort") == 3, 2).otherwise(1)
    return (rows.where("sort <> 0").select(
        "conv_id", "turn", F.when(F.col("sort") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).drop("copy"))


_HASH_SQL = "cn boolean, ck long, repaired_sha256 string"


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    def pairs():
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns))

    def record(done):
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.bool_()), pa.array([x[1] for x in done], pa.int64()),
                                           pa.array([x[2] for x in done], pa.string())], ["cn", "ck", "repaired_sha256"])
    done = []
    for (cn, ck), lines in groupby(pairs(), key=lambda r: r[:2]):
        h, between = hashlib.sha256(), b""
        for *_, line in lines:
            h.update(between + line.encode("utf-8"))
            between = b"\n"
        done.append((cn, ck, h.hexdigest()))
        if len(done) >= AT_ONCE:
            yield record(done)
            done = []
    if done:
        yield record(done)


def repaired_hash(rows: DataFrame) -> DataFrame:
    """(cn, ck, repaired_sha256): a conversation's ``role:text`` lines in order go through one
    running hash, a batch at a time; the digest of a whole string leaves no other way."""
    keyed = rows.select(F.col("conv_id").isNull().alias("cn"), F.coalesce("conv_id", F.lit(0)).alias("ck"), "pos",
                        F.concat_ws(":", "role", "text").alias("line"))
    return (keyed.repartition(*CONV).sortWithinPartitions(*CONV, "pos").select(*CONV, "line").mapInArrow(_hashes, _HASH_SQL))
