"""Extraction on hand-made pages and against enumeration; toxicity's bounded training and its search."""
import itertools
import math
import random
import time

import pytest

from laborlake.llm import dom_extract, toxicity

PROSE = ("<p>The first paragraph of the story tells what happened in the town last night.</p>"
         "<p>A second paragraph goes on with more words about it.</p>")
LINES = ["The first paragraph of the story tells what happened in the town last night.", "A second paragraph goes on with more words about it."]


def site(body):
    return (f"<html><head><title>x</title></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav>"
            f"{body}<footer>&copy; 2024 some site</footer></body></html>")


@pytest.fixture(scope="module")
def model():
    return dom_extract.fit(dom_extract.training_pages())


@pytest.mark.parametrize("block,lines", [
    ("<pre>def f(): return 1</pre>", ["def f(): return 1"]), ("<dl><dt>Term</dt><dd>Meaning of it.</dd></dl>", ["Term", "Meaning of it."]),
    ("<figure><img src=a><figcaption>A caption here</figcaption></figure>", ["A caption here"]), ("<address>Main street 5</address>", ["Main street 5"]),
    ("<table><tr><th>Head</th><th>Other</th></tr><tr><td>1</td><td>2</td></tr></table>", ["Head", "Other", "1", "2"]),
    ("<details><summary>More of it</summary><p>Inner words.</p></details>", ["More of it", "Inner words."]),
    ("<div>Own text of a div.</div>", ["Own text of a div."])])
def test_every_block_of_an_article_stays(model, block, lines):
    html = site(f"<article><h1>Title</h1>{PROSE}{block}{PROSE}</article>")
    assert dom_extract.main_text(html, model).split("\n") == ["Title", *LINES, *lines, *LINES]


def test_byline_and_named_bodies(model):
    assert dom_extract.main_text(site(f"<article><header><h1>Title</h1><p>By Jane Doe</p></header>{PROSE}</article>"), model).split("\n") == [
        "Title", "By Jane Doe", *LINES]
    assert dom_extract.main_text(site(f"<article><h1>T</h1><div class=\"review-body\">{PROSE}</div></article>"), model).split("\n") == ["T", *LINES]


@pytest.mark.parametrize("n", [0, 1, 8, 9, 30, 100])
def test_comments_do_not_outvote_the_article(model, n):
    comments = "".join(f"<div class='comment'><b>user{i}</b><p>I think this is a comment number {i}, quite so.</p></div>" for i in range(n))
    html = site(f"<div id=x><h1>Title of it</h1>{PROSE}{PROSE}</div><section class=comments><h3>Comments</h3>{comments}</section>")
    assert dom_extract.main_text(html, model).split("\n") == ["Title of it", *LINES, *LINES]


def test_controls_and_graphics_stay_inside_their_sentence(model):
    html = site("<article><p>Before <button>Go</button> middle <svg><path d='x'/></svg> after it.</p></article>")
    assert dom_extract.main_text(html, model) == "Before middle after it."


@pytest.mark.parametrize("piece", ["<p a=\"b\"c=d ", "<a ", "<a \"", "<a '\"", "<a x='", "</a x", "< ", "<p"])
def test_cut_off_tags_take_linear_time(piece):
    started = time.perf_counter()
    page = dom_extract.parse(piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - started < 10
    if piece.strip() != "<":
        assert page.blocks == []


def test_quoted_brackets_and_cut_tags():
    page = dom_extract.parse("<p title='a < b > c'>one</p><p class=\"x\" <b>two</b><p>three <i")
    assert [t for _, t in page.blocks] == ["one", "two", "three"]


@pytest.mark.parametrize("children", range(1, 11))
def test_marginals_equal_enumeration(children):
    rng = random.Random(children)
    page = dom_extract.parse("<div>" + "<p>x</p>" * children + "</div>")
    n = len(page.nodes)
    found = [[f"f{i}"] for i in range(n)]
    model = dom_extract.Model({f"f{i}": rng.uniform(-2, 2) for i in range(n)},
                              {k: [rng.uniform(-1, 1) for _ in range(4)] for k in ("p", "div", "other")})
    total, on = 0.0, [0.0] * n
    for state in itertools.product((0, 1), repeat=n):
        e = sum(model.weights[f"f{i}"] for i in range(n) if state[i])
        for i in range(1, n):
            p = page.nodes[i].parent
            e += page.nodes[p].bond * model.pair(page.nodes[i].tag)[2 * state[p] + state[i]]
        w = math.exp(e)
        total += w
        for i in range(n):
            on[i] += w * state[i]
    got, _ = model.marginals(page, found)
    assert got == pytest.approx([x / total for x in on])


SCHEMA = "doc_id long, text string, label string"


def test_toxicity_training_is_bounded_by_ids(spark, monkeypatch):
    rows = [(1, f"an utter idiot says number {i}", "x") for i in range(3000)] + [(2, "a kind word", None), (3, "another", None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    seen, settled = [], toxicity.settled

    def spy(df, name):
        out = settled(df, name)
        seen.append(out.count())
        return out
    monkeypatch.setattr(toxicity, "settled", spy)
    from pyspark.sql import functions as F
    toxicity.learn(docs, labels, "toxic", F.lit(True), max_train=2)
    assert seen == [2]


def test_training_texts_are_shuffled_once(spark):
    """Each label's copies and each id's rows teach by one text, and only one shuffle carries texts."""
    from pyspark.sql import functions as F
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c"), (3, "c"), (4, "c"), (5, None), (6, "d"), (None, "e")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 1), (5, 0), (9, 1)], "id long, label int")
    rows = toxicity.training_texts(docs, labels)
    first = docs.where("doc_id = 1").orderBy(F.xxhash64("text")).first()["text"]
    assert sorted(rows.collect(), key=lambda r: r["id"]) == [(1, first, 1), (2, "c", 0), (4, "c", 1), (5, None, 0)]
    conf = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "-1")
    try:
        plan = spark._jvm.PythonSQLUtils.explainString(toxicity.training_texts(docs, labels)._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set(conf, before)
    carried = [block.split("\n")[1] for block in plan.split("\n\n") if " Exchange\n" in block.lstrip("\n") + "\n"]
    assert carried and sum("text#" in columns for columns in carried) == 1, plan


def test_long_texts_keep_moving():
    m = toxicity.Model(toxicity.Trigrams(), {}, 0.0)
    m.slope, m.bias, m.ratio = 0.1, 0.0, lambda text, kept: float(text)
    assert m.score("30", {}) < m.score("60", {}) < m.score("300", {}) <= 1.0 and m.score("-1e9", {}) >= 0.0


def test_plain_marks_at_the_ends_change_no_reading():
    rng = random.Random(4)
    m = toxicity.Model(toxicity.Trigrams(), {"idiot": 3.0, "^idiot": 2.0, "loser": 1.5}, 0.0)
    for w in ("idiot", "loser", "house", "wall", "tree"):
        m.trigrams.learn(w, 5)
    assert not set(toxicity.PLAIN_MARKS) & set(toxicity.LOOKS_LIKE)
    for _ in range(3000):
        t = "".join(rng.choice("idiotl0s3r$!.,;:?\"'-_([{@*aé") for _ in range(rng.randint(0, 8)))
        assert m.token(t) == m.token(t.strip(toxicity.PLAIN_MARKS)), t


def test_search_equals_enumeration():
    rng = random.Random(5)
    m = toxicity.Trigrams()
    for w in ("idiot", "loser", "house", "sell", "toast"):
        m.learn(w, 4)
    for _ in range(150):
        token = "".join(rng.choice("idot1053s@$.. l") for _ in range(rng.randint(1, 6))).strip() or "s"
        best = None
        for arcs in itertools.product(*toxicity.lattice(token)):
            word, score = "".join(a for a, _ in arcs), -sum(p for _, p in arcs)
            for part in word.split(" "):
                w = f"^^{part}$"
                score += sum(m.log(w[i:i + 2], w[i + 2]) for i in range(len(w) - 2))
            best = score if best is None else max(best, score)
        found = toxicity.viterbi(token, m)
        reach = [(-sum(p for _, p in arcs)) for arcs in itertools.product(*toxicity.lattice(token)) if "".join(a for a, _ in arcs) == found]
        mine = max(reach)
        for part in found.split(" "):
            w = f"^^{part}$"
            mine += sum(m.log(w[i:i + 2], w[i + 2]) for i in range(len(w) - 2))
        assert mine == pytest.approx(best)


def test_all_labelled_rows_teach(spark, monkeypatch):
    """More labelled rows than the 8,000 that once were taken: every one is counted."""
    from pyspark.sql import functions as F
    n = 9000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number n"), F.col("id").cast("string")).alias("text"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 7 == 0).cast("int").alias("toxic"))
    seen, fit, fitted, calibrate = [], toxicity.fit, [], toxicity.calibrate
    monkeypatch.setattr(toxicity, "fit", lambda words: seen.append(words[""]) or fit(words))
    monkeypatch.setattr(toxicity, "calibrate", lambda m, rows: fitted.append(len(rows)) or calibrate(m, rows))
    toxicity.learn(docs, labels, "toxic", F.lit(True))
    assert seen[0][:2] == (1286, n - 1286) and fitted == [n]


def test_the_curve_is_the_same_when_spark_sums(spark):
    rows = [((i * 37 % 101) / 7 - 9, int((i * 37 % 101) > 60) if i % 9 else i % 2) for i in range(400)]
    here, there = (toxicity.Model(toxicity.Trigrams(), {}, 0.0) for _ in range(2))
    toxicity.calibrate(here, sorted(rows))
    toxicity.calibrate_on(there, spark.createDataFrame(rows, "ratio double, label int").repartition(3))
    assert abs(here.slope - there.slope) < 1e-6 and abs(here.bias - there.bias) < 1e-6
    toxicity.calibrate_on(there, spark.createDataFrame([(1.0, 1)], "ratio double, label int"))
    toxicity.calibrate(here, [(1.0, 1)])
    assert (here.slope, here.bias) == (there.slope, there.bias)
