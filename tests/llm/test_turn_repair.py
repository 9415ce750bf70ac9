"""Conversation repair against a plain search over the roles' automaton, in memory and over cut conversations."""
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from laborlake.llm import turn_repair
from laborlake.llm.queries import QUERIES

# What may follow: at the start s or u, after s only u, then u and a by turns.
NEXT = {"start": {"s": "sys", "u": "user"}, "sys": {"u": "user"}, "user": {"a": "done"}, "done": {"u": "user"}}


def plain(rows):
    """(cost, audit) of rows (initial, truncated, must go), from the last row backwards."""
    best = {"start": (0, ""), "done": (0, "")}
    tables = [best]

    def inserts(best):
        for _ in range(6):
            for state, moves in NEXT.items():
                for t, to in moves.items():
                    if t != "s" and to in best:
                        c = (best[to][0] + 2, "I" + best[to][1])
                        best[state] = min(best.get(state, c), c)
        return best
    inserts(best)
    for initial, truncated, must_go in reversed(rows):
        new = {}
        for state, moves in NEXT.items():
            found = [(best[state][0] + 3, "D" + best[state][1])] if state in best else []
            for t, to in moves.items():
                if not must_go and to in best:
                    if t == initial:
                        found.append((best[to][0] + truncated, "K" + best[to][1]))
                    if t != "s":
                        found.append((best[to][0] + 2 + truncated, "R" + best[to][1]))
            if found:
                new[state] = min(found)
        best = inserts(new)
        tables.append(best)
    return best["start"]


def applied(rows, audit):
    """The repaired lines, from the rows and the audit alone."""
    lines, roles, at = [], "", 0
    for x in audit:
        if x == "D":
            at += 1
            continue
        role = None
        if x == "K":
            role = rows[at][0]
        odd = roles[:1] == "s"
        roles += role[:1] if role else "ua"[(len(roles) - odd) % 2]
        lines.append(f"{role or ('user' if roles[-1] == 'u' else 'assistant')}:{'' if x == 'I' else rows[at][1]}")
        at += x != "I"
    assert at == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles)
    return "\n".join(lines)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        sort = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if sort == 0:
            continue
        text = "" if sort == 1 else re.sub(r"[.!?]", "", text) if sort == 2 else text
        out += [(conv, turn, "user" if sort == 4 else role, text)] * (2 if sort == 3 else 1)
    return out


def brute(rows, damage=True):
    talks = defaultdict(list)
    for r in damaged(rows) if damage else rows:
        talks[r[0]].append((r[1], *(" " if x is None else x for x in r[2:])))
    out = {}
    for conv in {r[0] for r in rows}:
        ordered = sorted(talks[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        seen, marks, n = set(), [], Counter()
        for turn, role, text in ordered:
            last = re.search(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z", text)
            fault = ("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[1] not in ".!?" else "")
            seen.add((role, text))
            n[fault] += 1
            marks.append((role[:1], fault == "truncated", fault in ("blank", "duplicate")))
        cost, audit = plain(marks)
        turns = [r[0] for r in ordered if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:]))
        digest = hashlib.sha256(applied([r[1:] for r in ordered], audit).encode()).hexdigest()
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, digest)
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_parse_equals_plain_search():
    for n in range(6):
        for roles in itertools.product("sua", repeat=n):
            rows = [(r, False, False) for r in roles]
            assert turn_repair.repaired_roles(rows) == plain(rows), rows
    rng = random.Random(1)
    for _ in range(1500):
        rows = [(rng.choice("suauaua t"), rng.random() < 0.3, rng.random() < 0.2) for _ in range(rng.randint(0, 30))]
        assert turn_repair.repaired_roles(rows) == plain(rows), rows
    rows = [(rng.choice("sua"), rng.random() < 0.3, rng.random() < 0.2) for _ in range(1000)]
    assert turn_repair.repaired_roles(rows) == plain(rows)


def test_table_has_one_stack_per_top():
    tops = turn_repair.entries()
    assert len(tops) == 4 and all(stack[0] == top for top, stack in tops.items())
    assert sorted(turn_repair.complete(s) for s in tops.values()) == [False, False, True, True]


def test_parts_put_together_equal_one_run():
    rng = random.Random(2)
    for _ in range(300):
        rows = [(rng.choice("suat"), rng.random() < 0.3, rng.random() < 0.2) for _ in range(rng.randint(1, 40))]
        cuts = sorted(rng.sample(range(1, len(rows) + 1), min(len(rows), rng.randint(0, 4))))
        tables = []
        for a, b in zip([0, *cuts], [*cuts, len(rows)]):
            table = []
            for start, stack in turn_repair.entries().items():
                p = turn_repair.Parse(stack)
                for initial, truncated, gone in rows[a:b]:
                    p.row(initial, truncated, not gone, int(gone))
                table += [(start, *e) for e in p.ends()]
            tables.append(table)
        cost, audits = turn_repair.cheapest_path(tables)
        assert (cost, "".join(audits)) == plain(rows), rows


def talk(rng, conv, n):
    roles = ["system", "user", "assistant", "user", "assistant", "user", "assistant", "tool", None, "user "]
    texts = ["Yes.", "No!", "cut off", "", " \n", None, "Why? ", "ends in é", "..", "ok\x0b"]
    return [(conv, t, rng.choice(roles[:7] if rng.random() < 0.9 else roles), rng.choice(texts) if rng.random() < 0.4 else f"Text {rng.random()}.")
            for t in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [r for conv in range(120) for r in talk(rng, conv, rng.randint(1, 9)) if rng.random() < 0.95]
    out += talk(rng, 1000, 700)                                     # one that fills several partitions
    out += [(None, t, "user", f"Null {t}.") for t in range(5)] + [(1001, None, "assistant", "First."), (1001, 3, "user", "Then?")]
    out += [(1002, None, None, None), (1003, 7, "user", "Same.")] + [(1003, 7, "user", "Same.")] * 4 + [(1003, 8, "user", "Same.")]
    out += [(1004, 0, "user", "long " * 100_000 + ".")]
    return out


SCHEMA = "conv_id long, turn long, role string, text string, ck long, part int, pos int, action string, first boolean, n int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *(None,) * 6) for r in rows], SCHEMA).repartition(5)


def test_repair_against_plain_search(spark, rows):
    want = brute(rows, damage=False)
    summary, repaired = turn_repair.repair(frame(spark, rows))
    digests = {None if r["cn"] else r["ck"]: r["repaired_sha256"] for r in turn_repair.repaired_hash(repaired).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    got = {r["conv_id"]: (*(r[c] for c in COLUMNS[:-1]), digests.get(r["conv_id"], empty)) for r in summary.collect()}
    assert got == want


def test_query_with_damage(spark, rows, tmp_path):
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op12_turn_repair"](spark, str(tmp_path)).collect()
    want = brute(rows)
    assert {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in got} == want and len(got) == len(want)


def test_query_on_the_small_table(spark, small_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{small_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op12_turn_repair"](spark, small_dir).collect()
    assert {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in got} == brute(rows)


def test_long_conversation_is_cut_by_partitions(spark, rows):
    read = turn_repair._read(frame(spark, rows), "conv_id", "turn", "role", "text")
    order = ["cn", "ck", "tk", "tv", "role", "h1", "h2"]
    parts = (turn_repair._flagged(read).repartitionByRange(16, *order).sortWithinPartitions(*order)
             .mapInArrow(turn_repair._parse, turn_repair._PASS_SQL).where("paths is not null and ck = 1000"))
    assert parts.count() > 3 and parts.where("whole").count() == 0


def test_empty_table(spark, tmp_path):
    summary, repaired = turn_repair.repair(frame(spark, []))
    assert summary.count() == 0 and repaired.count() == 0
    frame(spark, []).write.parquet(f"{tmp_path}/conversations.parquet")
    assert QUERIES["op12_turn_repair"](spark, str(tmp_path)).count() == 0


def test_damage(spark, rows):
    got = Counter(tuple(r) for r in turn_repair.damage(frame(spark, rows)).select("conv_id", "turn", "role", "text").collect())
    assert got == Counter(damaged(rows))
    assert turn_repair.damage(frame(spark, rows)).where(F.col("text").isNull()).count() == 0
