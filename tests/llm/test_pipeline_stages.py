"""Single pipeline stages on repeated rows, parted characters and empty tables."""
from collections import Counter

import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def test_cut_repeats_keeps_rows_and_foreign_marks(spark):
    shared = "x" * 24 + "äöü€😀" * 12
    rows = [(1, "first " + shared, "de", "a", 0), (2, "head � " + shared + " tail �", "de", "a", 0), (3, None, None, None, None),
            (4, "é" + shared[1:] + "é", "fr", "b", 0)] + [(5, "a repeated row of its own", lang, s, 0) for lang, s in (("en", "a"), ("en", "b"), (None, "a"))]
    got = cp.cut_repeats(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert Counter(r["doc_id"] for r in got) == Counter({1: 1, 2: 1, 3: 1, 4: 1, 5: 3})
    by = {r["doc_id"]: r["text"] for r in got}
    assert by[1] == rows[0][1] and by[3] == "" and by[2].count("�") == 2 and by[2].startswith("head �")
    assert "�" not in by[4] and all(r["n_chars"] == len(r["text"]) for r in got)
    assert Counter((r["lang"], r["source"]) for r in got if r["doc_id"] == 5) == Counter([("en", "a"), ("en", "b"), (None, "a")])


def test_stages_take_empty_tables(spark, small_dir):
    none = spark.createDataFrame([], SCHEMA)
    for name, stage in cp.STAGES:
        assert stage(spark, none, small_dir).count() == 0, name
