"""Every operator on small tables: against brute force, and on nulls, empty, long and repeated rows."""
import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from laborlake.llm import (cube_mixing, dom_extract, packing, quality_rules, simhash, spotsigs, subword_quality,
                           suffix_dedup, toxicity, warc)
from laborlake.llm.graph import components
from laborlake.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars int, score double, kept boolean, id string, "
          "chunk int, block int, th string, fp string, label string")


def prose(rng, n):
    words = "the of and a in to house garden river stone idiot light paper wolf é ü night".split()
    return " ".join(rng.choice(words) + rng.choice(["", "", ".", ",", "\n", "##"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [prose(rng, rng.randint(30, 120)) for _ in range(12)]
    texts = [None, "", " \t\n ", "one", "two words", "%%% &&&", "THE END\n\nTHE END", base[0], base[0], base[1] + base[2], base[2] + base[3],
             "x" * 300, "x" * 200, base[4] + " tail", "head " + base[4], prose(rng, 20_000), *base]
    out = [(i, t, None, ["a", "b", None, "é"][i % 4], None) for i, t in enumerate(texts)]
    return out + [out[7], out[7], (None, base[5], "en", None, None), (3, "another text under a used id", None, "b", 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([r + (None,) * 8 for r in rows], SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def as_set(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


def test_spotsigs(docs, none, rows):
    got = spotsigs.fingerprints(docs).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(rows) and spotsigs.fingerprints(none).count() == 0
    by_text = {}
    for r in got:
        by_text.setdefault(r["doc_id"], []).append(r)
    for a, b in zip(order, order[1:] + order[:1]):
        ids = [r[0] for r in order]
        if ids.count(a[0]) > 1 or ids.count(b[0]) > 1:
            continue
        t, n = a[1] or "", b[1] or ""
        half = len(t) // 2
        r = by_text[a[0]][0]
        assert r["edited_text"] == t[:len(t) - half] + n[:half] and r["n_chars"] == len(t)
        s, e = set(r["signatures"]), set(r["edited_signatures"])
        assert r["near_edited"] == pytest.approx(len(s & e) / len(s | e) if s | e else 1.0)
        assert r["n_signatures"] == len(s) and (len(s) > 0) == bool(t.strip(" "))
    same = [r for r in got if r["doc_id"] in (7, 8)]
    assert len({tuple(r["signatures"]) for r in same}) == 1


def test_spotsigs_next_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "DOCS_PER_BLOCK", 7)
    ids = sorted(random.Random(1).sample(range(10_000), 100))
    df = spark.createDataFrame([(i, f"the text {i} of row {i}") for i in ids], "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["__next"] for r in spotsigs.with_next(df).collect()}
    assert got == {a: f"the text {b} of row {b}" for a, b in zip(ids, ids[1:] + ids[:1])}


def test_spotsigs_deals_an_id_with_many_texts_to_many_ranges(spark, monkeypatch):
    """Half the rows without an id, a sixth under one id: still one successor each, in ranges of bounded size."""
    monkeypatch.setattr(spotsigs, "DOCS_PER_BLOCK", 40)
    ids = [None] * 600 + [77] * 200 + list(range(400))
    rows = [(i, f"the text {n} of a row") for n, i in enumerate(ids)] + [(None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = spotsigs.with_next(df).select("doc_id", "__text", "__next", "__b").collect()
    assert len(got) == len(rows) and max(Counter(r["__b"] for r in got).values()) < 160
    step = {r["__text"]: r["__next"] for r in got}
    at, seen = "", []
    for _ in rows:
        seen.append(at)
        at = step[at]
    assert at == "" and len(set(seen)) == len(rows)
    of = {t: -1 if i is None else i for i, t in rows}
    turn = [of[t] for t in seen]
    first = min(range(len(turn)), key=lambda k: (turn[k], turn[k - 1] == -1))
    assert turn[first:] + turn[:first] == sorted(turn)


def test_spotsigs_likeness_is_pruned_by_length(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [1, 2, 3]), ([1], [1, 2, 3]), ([], []), ([], [1])], "a array<long>, b array<long>")
    exact = [r[0] for r in df.select(spotsigs.pruned_jaccard(F.col("a"), F.col("b"))).collect()]
    pruned = [r[0] for r in df.select(spotsigs.pruned_jaccard(F.col("a"), F.col("b"), 0.5)).collect()]
    assert exact == [0.75, pytest.approx(1 / 3), 1.0, 0.0] and pruned == [0.75, 0.0, 1.0, 0.0]


def test_quality_rules(docs, none, rows):
    got = {(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
           for r in quality_rules.quality_rules(docs).collect()}
    want = set()
    for i, t, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
        n, seen = Counter(grams), set()
        for k, g in enumerate(grams):
            seen |= {k, k + 1, k + 2} if n[g] > 1 else set()
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want.add((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(seen),
                  len(w) < 50 or 100 * len(seen) > 50 * len(w)))
    assert got == want and quality_rules.quality_rules(none).count() == 0


def test_water_fill():
    t = cube_mixing.water_fill([100, 10, 0, 50], [5, 2, 1, 5])
    assert sum(t) == pytest.approx(240) and t[1] == 20 and t[2] == 0 and t[3] == 100 and t[0] == 120
    rng = random.Random(3)
    for _ in range(200):
        s = [rng.randint(0, 50) for _ in range(rng.randint(1, 9))]
        t = cube_mixing.water_fill(s, [[5, 2, 1][i % 3] for i in range(len(s))])
        assert sum(t) == pytest.approx(1.5 * sum(s)) and all(x <= 2 * y + 1e-9 for x, y in zip(t, s))


def test_flight_keeps_the_totals():
    rng = np.random.default_rng(0)
    p, size = rng.random(500), rng.integers(1, 4000, 500)
    out = cube_mixing.flight(p, size, rng)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert out.sum() == pytest.approx(p.sum()) and (out * size).sum() == pytest.approx((p * size).sum())
    landed = cube_mixing.land(out, size)
    assert set(landed) <= {0.0, 1.0} and abs((landed * size).sum() - (p * size).sum()) <= 4000


def test_mix(docs, none, rows, monkeypatch):
    monkeypatch.setattr(cube_mixing, "BLOCK", 4)
    got = cube_mixing.mix(docs).collect()
    again = cube_mixing.mix(docs.repartition(3)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again)) and len(got) == len(rows)
    assert cube_mixing.mix(none).count() == 0
    assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2 for r in got)


def test_land_is_the_best_rounding():
    rng = np.random.default_rng(3)
    for _ in range(60):
        k = int(rng.integers(1, 9))
        p, size = rng.random(k), rng.integers(0, 500, k)
        got = cube_mixing.land(p, size)
        near = [m for m in np.ndindex(*[2] * k) if abs(sum(m) - p.sum()) < 4.5]
        assert set(got) <= {0.0, 1.0} and tuple(got) in {tuple(map(float, m)) for m in near}
        assert abs((got * size).sum() - (p * size).sum()) == pytest.approx(min(abs(np.dot(m, size) - (p * size).sum()) for m in near))


def test_last_block_comes_near_its_target_with_heavy_tails():
    miss = []
    for seed in range(20):
        rng = np.random.default_rng(seed)
        size = np.sort(np.minimum(rng.pareto(0.8, 500) * 20 + 1, 20_000).astype(int))
        p = np.full(500, 0.37)
        got = cube_mixing.fly_and_land(p, size, rng)
        assert set(got) <= {0.0, 1.0} and abs(got.sum() - p.sum()) < 4.5
        miss.append(abs((got * size).sum() - (p * size).sum()) / (p * size).sum())
    assert np.mean(miss) < 0.01 and max(miss) < 0.1


def test_mix_numbers_and_deals_rows_alike(spark, monkeypatch):
    monkeypatch.setattr(cube_mixing, "NUMBERED", 7)
    monkeypatch.setattr(cube_mixing, "BLOCK", 16)
    df = spark.createDataFrame([(None, "five words in this text", "b")] * 150 + [(i, "word " * (i % 9), "a") for i in range(90)],
                               "doc_id long, text string, source string")
    rows = cube_mixing.mix(df).collect()
    assert len(rows) == 240 and sum(r["doc_id"] is None for r in rows) == 150
    for source, size in Counter(r["source_size"] for r in rows).items():
        mine = [r for r in rows if r["source_size"] == source]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 5
    copies = cube_mixing.numbered(df.where("doc_id is null")).select("copy").collect()
    assert sorted(r[0] for r in copies) == list(range(150))


def test_simhash(docs, none, rows):
    got = simhash.near_duplicates(docs, split=4).collect()
    fp = [simhash.fingerprint(t or "") for _, t, *_ in rows]
    best = [i if i is not None else simhash.NO_ID for i, *_ in rows]
    for _ in rows:
        best = [min(b for b, g in zip(best, fp) if (f ^ g).bit_count() <= 4) for f in fp]
    want = Counter((r[0], simhash.signed(f), b) for r, f, b in zip(rows, fp, best))
    assert Counter((r["doc_id"], r["fingerprint"], simhash.NO_ID if r["component_id"] is None else r["component_id"]) for r in got) == want
    assert simhash.near_duplicates(none).count() == 0


def near_pairs(n, seed=7):
    """``n`` unlike texts and for each a near copy of another fingerprint."""
    rng, out = random.Random(seed), []
    while len(out) < n:
        words = [f"w{rng.randint(0, 10 ** 6)}" for _ in range(400)]
        a, b = " ".join(words), " ".join([*words[:-1], "end"])
        if 0 < (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() <= simhash.RADIUS:
            out.append((a, b))
    return out


def test_simhash_shared_and_missing_ids_link_nothing(spark):
    (a, near_a), (b, near_b), (c, near_c), (d, near_d), (e, _) = near_pairs(5)
    rows = [(5, a), (9, b), (None, near_a), (None, near_b), (20, c), (30, d), (15, near_c), (15, near_d), (None, e)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect())
    assert got == Counter((simhash.signed(simhash.fingerprint(t)), i) for t, i in (
        (a, 5), (near_a, 5), (b, 9), (near_b, 9), (c, 15), (near_c, 15), (d, 15), (near_d, 15), (e, None)))


@pytest.mark.parametrize("radius", [1, 3, 4])
def test_bit_sliced_links(radius):
    rng = np.random.default_rng(radius)
    centre = rng.integers(0, 1 << 63, 30, dtype=np.int64).astype(np.uint64)
    fp = np.concatenate([centre ^ np.uint64(1 << int(b)) ^ np.uint64(1 << int(c)) for b, c in rng.integers(0, 64, (9, 2))])
    group = np.sort(rng.integers(0, 3, len(fp)))
    root = simhash.linked(group, fp, radius)
    want = np.arange(len(fp))
    for _ in range(len(fp)):
        new = np.array([min(want[j] for j in range(len(fp)) if group[i] == group[j] and int(fp[i] ^ fp[j]).bit_count() <= radius)
                        for i in range(len(fp))])
        if (new == want).all():
            break
        want = new
    assert (root == want).all()


def test_cells_are_compared_in_turn():
    rng = np.random.default_rng(5)
    fp = rng.integers(0, 1 << 63, 40, dtype=np.int64)[rng.integers(0, 40, 300)] ^ (1 << rng.integers(0, 60, 300))
    rows = pa.table({"cell": np.sort(rng.integers(-9, 9, 300)), "fp": fp, "node": np.arange(300)})

    def links(at_once):
        out = simhash._links(4, at_once)(iter(rows.to_batches(max_chunksize=7)))
        return sorted((r["a"], r["b"]) for b in out for r in b.to_pylist())
    # A cell's smallest row is the one its sorted rows begin with, whatever is held with it.
    assert links(20) == links(1) == links(1000) and links(20)


def test_components_of_a_long_path(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 103), (103, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and got[103] == got[101] == 100


def brute_dedup(rows, length):
    best = {}
    key = [simhash.NO_ID if i is None else i for i, *_ in rows]
    data = [(t or "").encode() for _, t, *_ in rows]
    for k, b in zip(key, data):
        for p in range(len(b) - length + 1):
            w = b[p:p + length]
            best[w] = min(best.get(w, k), k)
    for k, b in zip(key, data):
        cut = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if best[b[p:p + length]] < k:
                cut[p:p + length] = b"\1" * length
        yield bytes(x for x, c in zip(b, cut) if not c), sum(1 for p in range(len(cut)) if cut[p] and not (p and cut[p - 1]))


@pytest.mark.parametrize("hot", [4096, 1])
def test_suffix_dedup(docs, none, rows, hot):
    got = suffix_dedup.dedup(docs, chunk_bytes=20_000, block_bytes=10_000, hot_runs=hot).collect()
    want = Counter((r[0], kept, spans) for r, (kept, spans) in zip(rows, brute_dedup(rows, 50)))
    assert Counter((r["doc_id"], bytes(r["kept"]), r["n_spans"]) for r in got) == want
    assert all(r["n_bytes"] - len(r["kept"]) == r["n_removed"] for r in got)
    assert suffix_dedup.dedup(none).count() == 0
    lone = suffix_dedup.dedup(docs.where("doc_id = 11")).first()  # a table in which nothing repeats
    assert lone["n_removed"] == 0 and lone["n_bytes"] == 300


def test_suffix_dedup_counts_every_run_of_a_name(spark):
    """A line many times in one long document, and once elsewhere: every run counts, its bytes go once."""
    line = "".join(chr(97 + i * 7 % 26) for i in range(70))
    rows = [(5, (line + "\n") * 700), (2, "head " + line), (9, line + line), (None, (line + " ") * 200), (None, (line + " ") * 200)]
    rows = [r + (None,) * 3 for r in rows]
    texts = pa.table({"id": [5], "th": [0], "text": [rows[0][1].encode()], "n": [1]})
    named = suffix_dedup._names(50, 1)((pa.scalar(0),), texts)
    marks = np.frombuffer(named["runs"][0].as_py(), np.uint8)
    many = np.frombuffer(named["many"][0].as_py(), np.int64)
    assert (marks < 128).all() and len(many) == (marks == 127).sum() > 0 and many.max() >= 699
    one = suffix_dedup._repeated(1000)((pa.scalar(0),), named)
    assert one.num_rows == 0  # one document alone has no repeats
    both = pa.concat_tables([named, named.set_column(1, "chunk", pa.array([1], pa.int32()))])
    reply = suffix_dedup._repeated(1000)((pa.scalar(0),), both)
    assert 1 in np.frombuffer(reply["hot"][0].as_py(), np.uint8)
    sent = suffix_dedup._segments(50, 1)((pa.scalar(0),), texts, reply.filter(pa.array([True, False])))
    assert sum(len(x) // 4 for x in sent["length"].to_pylist()) <= 2 * 71 + 2
    for hot in (10, 4096):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
        got = suffix_dedup.dedup(df, chunk_bytes=20_000, block_bytes=10_000, hot_runs=hot).collect()
        want = Counter((r[0], kept, n) for r, (kept, n) in zip(rows, brute_dedup(rows, 50)))
        assert Counter((r["doc_id"], bytes(r["kept"]), r["n_spans"]) for r in got) == want


def test_suffix_dedup_deals_rows_alike_as_counted_pieces(spark):
    """A third of all rows alike in id and text: no chunk takes them, and every row comes back."""
    rng = random.Random(3)
    base = [prose(rng, 40) for _ in range(4)]
    rows = [(None, base[0])] * 50 + [(7, base[1] + base[2])] * 30 + [(i, base[i % 4] + str(i)) for i in range(40)] + [(None, None)] * 25
    rows = [r + (None,) * 3 for r in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    got = suffix_dedup.dedup(df, chunk_bytes=20_000, block_bytes=10_000, alike=8).collect()
    want = Counter((r[0], kept, n) for r, (kept, n) in zip(rows, brute_dedup(rows, 50)))
    assert Counter((r["doc_id"], bytes(r["kept"]), r["n_spans"]) for r in got) == want


def test_equal_groups():
    rng = np.random.default_rng(2)
    raw = np.concatenate([rng.integers(97, 99, 3000).astype(np.uint8), np.zeros(8, np.uint8)])
    raw[500:800] = raw[100:400]
    raw[1500:1600] = 97
    pos = np.arange(2900)
    row, group = suffix_dedup.equal_groups(raw, pos, 40)
    found = {}
    for r, g in zip(row.tolist(), group.tolist()):
        found.setdefault(g, set()).add(r)
    want = {}
    for p in pos.tolist():
        want.setdefault(raw[p:p + 40].tobytes(), set()).add(p)
    assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_packing_round_trip(docs, none, rows):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.pack(docs, block_tokens=2000, with_ids=True).collect()
    by_seq, by_doc = {}, {}
    for r in got:
        by_seq.setdefault(r["sequence_id"], []).append(r)
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] > 0
    padded = 0
    for s in by_seq.values():
        s.sort(key=lambda r: r["offset"])
        n = sum(r["length"] for r in s)
        assert [r["offset"] for r in s] == [sum(x["length"] for x in s[:i]) for i in range(len(s))] and n <= 1024
        padded += 0 if n & (n - 1) == 0 else 1024 - n
    assert padded == 0
    for i, text, *_ in rows:
        if [r[0] for r in rows].count(i) == 1:
            ids = t.encode(text or "", add_special_tokens=False).ids + [0]
            parts = sorted(by_doc[i, len(ids)], key=lambda r: r["start"])
            assert b"".join(bytes(p["ids"]) for p in parts) == np.array(ids, "<u4").tobytes()
    assert packing.pack(none).count() == 0


def test_ids_equal_the_tokenizer():
    from hypothesis import given, settings
    from hypothesis import strategies as st
    ids = packing.Ids(packing.default_tokenizer())

    @settings(max_examples=400, deadline=None)
    @given(st.text(st.sampled_from(list("ab Z'.,1é\n\t\r  ́ß中😀s<|>\x01\x85")), max_size=30) | st.text(max_size=12))
    def same(text):
        want = ids.full.encode(text, add_special_tokens=False).ids
        assert ids.of(text) == np.array(want, "<u4").tobytes()
    same()
    assert np.frombuffer(ids.of("a<|endoftext|>b"), "<u4").tolist() == ids.full.encode("a<|endoftext|>b", add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(5))
def test_pack_block_loses_nothing(seed):
    rng = random.Random(seed)
    rests = [(i, 0, rng.randint(1, 1023)) for i in range(rng.randint(1, 200))]
    seqs, waiting = packing.pack_block(rests, last=False)
    assert all(sum(p[2] for p in s) == 1024 for s in seqs) and sum(p[2] for p in waiting) < 1024
    pieces = sorted(p for s in [*seqs, waiting] for p in s)
    for i, _, n in rests:
        mine = [p for p in pieces if p[0] == i]
        assert sum(p[2] for p in mine) == n and all(a[1] + a[2] == b[1] for a, b in zip(mine, mine[1:]))


def test_warc_round_trip(spark, tmp_path):
    html = ["<p>a</p>", "<p>a</p>", None, "", "x\r\n\r\nWARC/1.1\r\n", "é" * 5000, "<p>a</p>"]
    rows = [(5 - i, f"http://e.example/ü {i}" if i else None, h, "x") for i, h in enumerate(html)] + [(None, "u", "null id", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    got = Counter(tuple(r) for r in warc.round_trip(pages).collect())
    want = Counter()
    for i, _, h, _ in rows:
        b = (h or "").encode()
        first = min(r[0] for r in rows if r[0] is not None and (r[2] or "") == (h or "")) if i is not None else None
        want[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == first else "revisit", None if i == first else first] += 1
    assert got == want
    assert warc.round_trip(pages.limit(0)).count() == 0
    files = warc.write_warc(pages, str(tmp_path / "w"), min_payload=100)
    assert warc.read_warc(spark, files).where("record_type = 'revisit'").count() == 0
    plan = warc.read_warc(spark, files).where("record_type = 'response'")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\bFilter\b", plan)


def test_warc_reader_skips_without_decoding():
    reader = warc.WarcReader({"files": "a"}, type("S", (), {"fields": []})())
    from pyspark.sql.datasource import EqualTo, GreaterThan, In
    kept = GreaterThan(("payload_length",), 3)
    assert list(reader.pushFilters([EqualTo(("record_type",), "response"), In(("target_uri",), ("u",)), kept])) == [kept]
    assert reader.accepts({"warc-type": "response", "warc-target-uri": "u"}) and not reader.accepts({"warc-type": "response"})


def test_dom_extract(spark):
    model = dom_extract.fit(dom_extract.training_pages())
    held = dom_extract.training_pages(120, seed=9)
    assert sum(dom_extract.main_text(h, model) == t for h, t in held) >= 0.93 * len(held)
    page = ("<html><body><header><p>Site</p></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class='cookie-notice'><p>We use cookies.</p></div>"
            "<article><h1>A  title</h1><p>First &amp; <b>bold</b>\n text.<p>Second <a href=/x>link</a> text.</article><script>var x = '</p>';</script>"
            "<section id=comments><div class=comment><p>Nice one, I agree.</p></div></section><footer>&copy; me</footer>")
    assert dom_extract.main_text(page, model) == "A title\nFirst & bold text.\nSecond link text."
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<p"), (None, "u", page), (4, "u", "<div>" * 3000 + "deep text here."), (4, "u", "plain")]
    got = dom_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()
    assert len(got) == len(rows) and all(r["text"] is not None for r in got) and dom_extract.extract(
        spark.createDataFrame([], "page_id long, url string, html string"), model).count() == 0


def test_hidden_is_an_attribute_of_its_own():
    for attrs in ('title="A hidden gem"', 'title="The hidden cost of rent"', 'class="post hidden sm"', 'style="overflow: hidden !important"',
                  "title='say hidden'", "data-hidden", "href=/hidden", 'style="--display: none"', 'aria-hidden="false"',
                  'title="display: none"', "style=\"background:url('x;display:none')\"", 'style="display:none; display:block"'):
        assert [t for _, t in dom_extract.parse(f"<p {attrs}>some text</p>more").blocks] == ["some text", "more"], attrs
    for attrs in ("hidden", "HIDDEN=''", 'class=x hidden="until-found"', 'style="color: red; Display : NONE"', "style=display:none",
                  'style="display:none!important; display:block"', "aria-hidden=true", 'id="a"hidden'):
        assert [t for _, t in dom_extract.parse(f"<div>a<p {attrs}>some <b>text</b></p>more</div>b").blocks] == ["a", "more", "b"], attrs
    for html, want in (("<p hidden>x<p>one<p>two", ["one", "two"]), ("<ul><li hidden>x<li>one<li>two</ul>end", ["one", "two", "end"]),
                       ("<p hidden>x<p hidden>y<p>one", ["one"]), ("<div>a<p hidden>x</div>b", ["a", "b"]),
                       ("a <span hidden>x<i>y</i></span> b", ["a b"]), ("<div hidden><div>x</div>y</div>b", ["b"]),
                       ("<p>a<span hidden>x</p>b", ["a", "b"]), ("<div hidden/>b", ["b"]), ("a<br hidden>b", ["ab"]),
                       ("<div hidden><script>'</div>'</script>x</div>b", ["b"])):
        assert [t for _, t in dom_extract.parse(html).blocks] == want, html


def test_deobfuscation():
    words = {"": (60, 60, 600, 6000)} | {w: (20, 0, 25, 0) for w in ("idiot", "moron", "trash")}
    words |= {w: (30, 30, 90, 900) for w in "the this and stone river light of paper dot an are you".split()}
    model = toxicity.fit(words)
    toxicity.calibrate(model, [(model.ratio(t, {}), y) for t, y in (("you idiot", 1), ("the trash of moron", 1), ("the stone and river", 0), ("this paper", 0))] * 5)
    clean = model.score("you are the light of the river and the stone and this paper", {})
    for t in ("you are an 1d10t", "you i d i o t", "what a m0r0n", "tr@sh trash", "idioooot", "m.o.r.o.n", "m-o-r-o-n idiot"):
        assert model.score(t, {}) > max(0.3, clean), t
    assert clean < 0.3 and toxicity.viterbi("1d10t", model.trigrams) == "idiot"


def test_long_tokens_are_searched_whole():
    model = toxicity.Trigrams()
    for w in ("idiot", "stupid", "the"):
        model.learn(w, 10)
    assert toxicity.disguised("1d10t-" * 40) is not None
    assert toxicity.viterbi("1d10t" * 40, model) == "idiot" * 40
    assert toxicity.viterbi("x" * 100_000, model) in ("x", "xx")


def test_disguises_at_the_ends_doubled_and_spaced():
    vile = ("idiot", "dumbass", "asshole", "shit", "ass", "loser", "stupid")
    words = {"": (60, 60, 600, 6000)} | {w: (20, 0, 25, 0) for w in vile}
    words |= {w: (30, 30, 90, 900) for w in "you are a an such the this and stone river light of paper apple letter hole radio".split()}
    model = toxicity.fit(words)
    for t in ("idio+", "dumba$$", "@$$hole", "5h17", "a55", "@$$", "stuppid", '"idio+",', "$h1t!", "such a l o s e r", "a s s",
              "y o u a r e a n i d i o t", "y o u a r e s t u u u u p i d", "1d10t!", "(1d10t)"):
        assert model.ratio(t, {}) + len(t.split()) * model.excess > model.weight("idiot") / 2, t
    for t in ("apple letter!", "the (river)", "a 2 3 -", "such a - b"):
        assert model.ratio(t, {}) <= 0, t
    # What a token hides counts once, and not beside its plain word.
    assert model.ratio("idiot!", {}) == pytest.approx(model.ratio("idiot", {}))
    assert toxicity.viterbi("y o u a r e a n i d i o t", model.trigrams) == "you are an idiot"


def test_classifiers_on_edges(spark, docs, none, rows):
    labels = spark.createDataFrame([(i, i % 2, None if i == 9 else i % 2) for i in range(20)] + [(0, 1, 1), (None, 1, 1), (999, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    every = F.lit(True)
    model = subword_quality.learn(docs, labels, "quality", every)
    for m in (model, subword_quality.learn(none, labels, "quality", every)):
        got = subword_quality.score(docs, m).collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert subword_quality.score(none, model).count() == 0
    tox = toxicity.learn(docs, labels, "toxic", every)
    got = toxicity.score(docs, tox).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got) and toxicity.score(none, tox).count() == 0
    toxicity.learn(none, labels, "toxic", every)
    assert toxicity.clean(docs, tox, 2.0).count() == len(rows) and toxicity.clean(docs, tox, 2.0).columns == docs.columns


def test_quality_learns_one_text_of_each_id(spark, monkeypatch):
    bags = []
    monkeypatch.setattr(subword_quality, "sgd", lambda got, y, buckets, seed: bags.append(got) or (np.zeros(buckets, np.float32), 0.0))
    texts = spark.createDataFrame([(i % 2 if i < 60 else i, f"text number {i} of many") for i in range(64)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in (0, 1, 60, 61)], "doc_id long, quality int")
    for parts in (1, 4):
        subword_quality.learn(texts.repartition(parts), labels, "quality", F.lit(True))
    assert [len(b) for b in bags] == [4, 4]
    assert all((x[0] == y[0]).all() and (x[1] == y[1]).all() for x, y in zip(*bags, strict=True))


@pytest.mark.parametrize("name, label, kind, least", [("op2_quality_classifier", "quality", 3, 0.97), ("op7_toxicity", "toxic", 4, 0.93)])
def test_held_out_accuracy(spark, name, label, kind, least):
    sf = "/root/testdata/sf0.1"
    got = QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(got) > 300 and sum(r["predicted"] == r[label] for r in got) >= least * len(got)


def test_queries_match_their_sql(spark):
    import duckdb
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in ORACLE_SQL.items():
        want = con.sql(sql)
        cols = sorted(want.columns)
        assert as_set(QUERIES[name](spark, sf), *cols) == Counter(want.select(*cols).fetchall()), name


def test_pipeline(spark):
    import corpus_pipeline as c
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for _, stage in c.STAGES[:-1]:
        out = stage(spark, docs, sf).persist()
        assert out.columns == list(c.DOCUMENTS) and out.count() > 0
        docs = out
    last = c.run(spark, sf).collect()
    assert n and {r["doc_id"] for r in last} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_near_dedup_keeps_one_row_of_each_component(spark):
    import corpus_pipeline as c
    (a, near_a), (b, near_b), (x, near_x), (d, _) = near_pairs(4)
    rows = [(None, a), (None, b), (None, d), (None, d), (4, near_b), (7, x), (7, near_a), (2, near_x), (9, None), (9, "")]
    for parts in (1, 5):
        df = spark.createDataFrame([(i, t, "en", s, 1) for s, (i, t) in zip("abcdefghij", rows, strict=True)],
                                   "doc_id long, text string, lang string, source string, n_chars int").repartition(parts)
        got = c.near_dedup(spark, df, "").collect()
        # The clean texts without an id stay, as does a row whose id another component holds too.
        assert Counter((r["doc_id"], r["text"], r["source"]) for r in got) == Counter(
            [(7, near_a, "g"), (4, near_b, "e"), (None, d, "c"), (2, near_x, "h"), (9, "", "i")])


def test_mix_takes_rows_alike_in_id_and_text_no_more_than_others(spark):
    import corpus_pipeline as c
    df = spark.createDataFrame([(None, "the same rest", "en", "ab"[i % 2], 13) for i in range(6)] + [(i, f"text {i}", "en", "a", 6) for i in range(9)],
                               "doc_id long, text string, lang string, source string, n_chars int")
    got = c.mix_sources(spark, df, "")
    assert got.count() == cube_mixing.mix(df).agg(F.sum("copies")).first()[0]
    assert got.columns == list(c.DOCUMENTS)
