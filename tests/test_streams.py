"""The match stream's index and its once-only stage: deltas, replays, corrections, both stages at once."""
import os
import uuid

import pytest

from laborlake.session import shared_dir
from laborlake.streaming import events, jobs
from laborlake.streaming.profile_index import ProfileIndex

PROFILE = "user_id long, email string, skills string, target_roles string"


def folder(spark, name):
    return shared_dir(spark, f"{name}-{uuid.uuid4().hex}")


def postings(spark, rows):
    return spark.createDataFrame(rows, "posting_id string, title string, company_name string, region string, url string, required_skills array<string>")


def event_batch(spark, rows):
    return events.encode_events(postings(spark, rows))


@pytest.fixture
def index(spark):
    ix = ProfileIndex(spark, folder(spark, "index"))
    ix.commit(spark.createDataFrame([(1, "a@x", "python, SQL", ""), (2, "b@x", "java,scala", "ring"), (3, "c@x", "python,sql", None),
                                     (4, "d@x", "", "ring")], PROFILE))
    return ix


def files_of(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path.removeprefix("file://")) for f in names}


def test_second_version_reads_and_writes_changes_only(spark, index, monkeypatch):
    index.advance(1)
    before = files_of(index.base)
    index.commit(spark.createDataFrame([(2, "b@x", "python,sql", ""), (3, "c@x", "go,rust", "welder"), (1, "a@x", "", "")], PROFILE))
    read, of = [], ProfileIndex._of
    monkeypatch.setattr(ProfileIndex, "_of", lambda self, name, v: read.append((name, v)) or of(self, name, v))
    index.advance(2)
    assert ("profiles", 2) in read and ("profiles", 1) not in read
    after = files_of(index.base)
    assert all(after[f] == t for f, t in before.items())                      # nothing is rewritten
    new = spark.read.parquet(f"{index.base}/signatures/version=2").collect()
    assert [sorted(r.skill_set) for r in new] == [["go", "rust"]]             # python, sql is known already
    now = {r.user_id: r.sig_id for r in index.at(2).members.collect()}
    then = {r.user_id: r.sig_id for r in index.at(1).members.collect()}
    assert sorted(then) == [1, 2, 3] and then[1] == then[3] and sorted(now) == [2, 3] and now[2] == then[1]
    held = {tuple(r.skill_set) for r in index.at(2).signatures.collect()}
    assert held == {("python", "sql"), ("go", "rust")}                        # java, scala has no user left


def test_replayed_batch_uses_the_version_it_noted(spark, index):
    staging = folder(spark, "staging")
    batch = event_batch(spark, [("p1", "Data Engineer", "Co", "R", None, ["Python", "SQL"]), ("p2", "Ring master", "Co", "R", None, None)])
    jobs.match_batch(batch, 0, index, staging)
    first = sorted(map(tuple, spark.read.parquet(f"{staging}/batch_id=0").collect()))
    assert [(r[0], r[1]) for r in first] == [(1, "p1"), (2, "p2"), (3, "p1")]
    index.commit(spark.createDataFrame([(1, "a@x", "", ""), (2, "b@x", "python,sql", "")], PROFILE))
    jobs.match_batch(batch, 1, index, staging)
    second = sorted((r.user_id, r.posting_id, r.profile_version) for r in spark.read.parquet(f"{staging}/batch_id=1").collect())
    assert second == [(2, "p1", 2), (3, "p1", 2)]
    jobs.match_batch(batch, 0, index, staging)
    assert sorted(map(tuple, spark.read.parquet(f"{staging}/batch_id=0").collect())) == first


def test_match_stream_stages_run_at_once(spark, index, monkeypatch):
    path, sink = folder(spark, "events"), folder(spark, "sink")
    for n in range(3):
        events.publish(postings(spark, [(f"p{n}", "Ring", "Co", "R", None, ["SQL", "python"]), ("p0", "Ring", "Co", "R", None, ["SQL", "python"])])
                       .coalesce(1), path=path)
    seen, match = [], jobs.match_batch

    def watched(*args):
        match(*args)
        seen.append(sorted(q.isActive for q in spark.streams.active))
    monkeypatch.setattr(jobs, "match_batch", watched)
    jobs.run_match_stream(spark, events.subscribe(spark, path=path, files_per_trigger=1), index, sink)
    assert seen and all(s == [True, True] for s in seen)
    got = sorted((r.user_id, r.posting_id) for r in jobs.read_notifications(spark, sink).collect())
    assert got == sorted((u, p) for p in ("p0", "p1", "p2") for u in (1, 2, 3))


ROWS = "n long, user_id long, posting_id string, at long"


def once(spark, sink, batches, order, buckets=4):
    for i, rows in batches:
        jobs.once_batch(spark.createDataFrame(rows, ROWS), i, ["user_id", "posting_id"], "n", order, sink, buckets)
    return sorted(map(tuple, jobs.read_once(spark, sink, ["user_id", "posting_id"], order, ROWS, "n").select(
        "n", "user_id", "posting_id", "at").collect()))


def test_once_keeps_the_earliest_and_survives_replays(spark):
    a = [(1, 1, "p", 50), (2, 1, "p", 40), (3, 2, "p", 10), (4, 9, None, 1), (4, 9, None, 1)]
    b = [(5, 1, "p", 30), (6, 2, "p", 20), (7, 3, "q", 5), (4, 9, None, 1), (8, 9, None, 2), (9, None, "p", 3)]
    want = [(3, 2, "p", 10), (4, 9, None, 1), (5, 1, "p", 30), (7, 3, "q", 5), (8, 9, None, 2), (9, None, "p", 3)]
    for batches in ([(0, a), (1, b)], [(0, a), (1, b), (1, b)], [(0, a), (0, a), (1, b)], [(0, b), (1, a)]):
        assert once(spark, folder(spark, "once"), batches, ["at", "n"]) == want
    first = once(spark, folder(spark, "once"), [(0, a), (1, b), (1, b)], [])
    assert len(first) == 6 and {r[0] for r in first} >= {3, 4, 7, 8, 9}


def test_once_reads_the_touched_buckets(spark):
    sink = folder(spark, "once")
    once(spark, sink, [(0, [(i, i, "p", 1) for i in range(200)])], ["at"], buckets=16)
    once(spark, sink, [(1, [(500, 7, "p", 0)])], ["at"], buckets=16)
    path = jobs._history(sink).removeprefix("file://")
    assert len([d for d in os.listdir(f"{path}/batch_id=0") if d.startswith("bucket=")]) > 8
    assert len([d for d in os.listdir(f"{path}/batch_id=1") if d.startswith("bucket=")]) == 1
    got = {r.user_id: r.n for r in jobs.read_once(spark, sink, ["user_id", "posting_id"], ["at"], ROWS, "n").collect()}
    assert got[7] == 500 and got[8] == 8 and len(got) == 200


def test_history_runs_are_the_digits_of_the_batch():
    assert jobs._runs_before(23, 4) == [(0, 2), (16, 1), (20, 0), (21, 0), (22, 0)] and jobs._runs_before(0, 4) == []
    for n in range(1, 200):
        runs = jobs._runs_before(n, 3)
        ends = [first + 3 ** level for first, level in runs]
        assert [f for f, _ in runs] == [0, *ends[:-1]] and ends[-1] == n      # every earlier batch once, in order


def test_once_over_merged_runs(spark, monkeypatch):
    """Nine batches, merged by two: the same rows as one pass over all, also for batches run again, and few folders read."""
    sink, keys, order = folder(spark, "once"), ["user_id", "posting_id"], ["at", "n"]
    batches = [[(100 * b + i, (b * 7 + i * 5) % 11, "p" if i % 3 else None, (b * 13 + i * 29) % 40) for i in range(12)] for b in range(9)]
    best = {}
    for n, user, posting, at in (r for b in batches for r in b):
        key = (user, posting) if posting else n
        best[key] = min(best.get(key, (at, n, user, posting)), (at, n, user, posting))
    want = sorted((n, user, posting, at) for at, n, user, posting in best.values())

    def run(b):
        jobs.once_batch(spark.createDataFrame(batches[b], ROWS), b, keys, "n", order, sink, 4, run=2)
        return sorted(map(tuple, spark.read.parquet(f"{sink}/batch_id={b}").collect()), key=repr)
    written = [run(b) for b in range(9)]
    key = lambda r: (r[0], r[1])
    rows = jobs.read_once(spark, sink, keys, order, ROWS, "n").select("n", "user_id", "posting_id", "at").collect()
    assert sorted(map(tuple, rows), key=key) == sorted(want, key=key)
    path = jobs._history(sink).removeprefix("file://")
    assert sorted(os.listdir(f"{path}_runs/level=1")) == ["first=0", "first=2", "first=4", "first=6"]
    assert os.listdir(f"{path}_runs/level=3") == ["first=0"]
    before = files_of(f"{path}_runs")
    assert [run(b) for b in (8, 5, 8)] == [written[8], written[5], written[8]]
    assert files_of(f"{path}_runs") == before                                 # a run is merged once


def test_stream_rows_are_those_of_the_signatures(spark, index):
    """Two users of one signature are one row of the sink; a posting that comes again under a new profile version
    reaches only users that were not told before, and each the first time."""
    path, sink, checkpoint = (folder(spark, n) for n in ("events", "sink", "ckpt"))

    def publish(*ids):
        events.publish(postings(spark, [(p, "Data Engineer", "Co", "R", None, ["SQL", "python", "go", "rust"]) for p in ids]), path=path)
        jobs.run_match_stream(spark, events.subscribe(spark, path=path), index, sink, checkpoint)
    publish("p0", "p1")
    assert sorted((r.sig_id, r.posting_id) for r in spark.read.parquet(sink).collect()) == sorted(
        (s, p) for p in ("p0", "p1") for s in {r.sig_id for r in index.at(1).members.where("user_id in (1, 3)").collect()})
    # 3 moves to another signature that matches as well, 5 is new, 1 leaves.
    index.commit(spark.createDataFrame([(3, "c@x", "go,rust", ""), (5, "e@x", "sql,python", ""), (1, "a@x", "", "")], PROFILE))
    publish("p1", "p2")
    got = sorted((r.user_id, r.posting_id, r.profile_version) for r in jobs.read_notifications(spark, sink).collect())
    assert got == [(1, "p0", 1), (1, "p1", 1), (3, "p0", 1), (3, "p1", 1), (3, "p2", 2), (5, "p1", 2), (5, "p2", 2)]


def test_postings_heard_before_are_not_matched_again(spark, index):
    """Events that come again word for word are not staged again; one in other words tells only who was not told yet,
    and a staged batch that is noted again tells nobody twice."""
    path, sink, checkpoint = (folder(spark, n) for n in ("events", "sink", "ckpt"))
    skills = ["SQL", "python"]

    def publish(*rows):
        for id_, names in rows:
            events.publish(postings(spark, [(id_, "Welder", "Co", "R", None, names)]).coalesce(1), path=path)
        jobs.run_match_stream(spark, events.subscribe(spark, path=path, files_per_trigger=1), index, sink, checkpoint)
    publish(("p0", skills), ("p1", skills), ("p0", skills), ("p1", skills))
    staged = lambda: sorted((r.posting_id, r.again) for r in spark.read.parquet(f"{sink}_staging").collect())
    told = lambda: sorted((r.user_id, r.posting_id) for r in jobs.read_notifications(spark, sink).collect())
    assert staged() == [("p0", False), ("p1", False)]
    assert told() == [(1, "p0"), (1, "p1"), (3, "p0"), (3, "p1")]
    publish(("p1", [*skills, "Java", "scala"]))
    assert staged() == [("p0", False), ("p1", False), ("p1", True), ("p1", True)]
    want = [(1, "p0"), (1, "p1"), (2, "p1"), (3, "p0"), (3, "p1")]
    assert told() == want
    notes = spark.createDataFrame([(n, n == 4) for n in range(5)], jobs.NOTE_SCHEMA)
    jobs.told_batch(notes, 99, f"{sink}_staging", sink)
    assert told() == want and spark.read.parquet(f"{sink}/batch_id=99").isEmpty()


def test_a_pair_is_found_once(spark):
    from laborlake.operators import matching
    signatures = spark.createDataFrame([("a", ["go", "sql"], ["ring", "ring master"]), ("b", ["go"], ["master", "ring"]), ("c", [], ["rod"])],
                                       "sig_id string, skill_set array<string>, roles array<string>")
    rows = spark.createDataFrame([("p", "Ring master, ring", ["go", "r", "sql"]), ("q", "ring", None), ("r", None, ["go", "sql"]), (None, "ring", ["go"])],
                                 "posting_id string, title string, posting_skills array<string>")
    got = sorted((r.posting_id, r.sig_id, r.overlap, r.role_match) for r in matching.signature_match(rows, None, signatures).collect())
    assert got == [("p", "a", ["go", "sql"], True), ("p", "b", ["go"], True), ("q", "a", [], True), ("q", "b", [], True), ("r", "a", ["go", "sql"], False)]
