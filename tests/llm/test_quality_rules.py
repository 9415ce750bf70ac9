"""The verdict of the quality rules against a plain loop over the rule table."""
import random
import re

from laborlake.llm import quality_rules
from laborlake.llm.common import common_words


def plain_kept(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    stop = {s for w in common_words() for s in (w, w.capitalize())}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    again = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    chars, n = sum(map(len, words)), max(len(words), 1)
    value = {
        "mean_word_chars": chars / n, "symbol_ratio": len(re.findall(r"[#*$%&|<>]", text)) / max(chars, 1),
        "stop_word_ratio": sum(w in stop for w in words) / n, "upper_ratio": sum(c.isupper() for c in text) / max(len(text), 1),
        "dup_line_ratio": (len(lines) - len(set(lines))) / max(len(lines), 1),
        "stutter_ratio": sum(a == b for a, b in zip(words, words[1:])) / n}
    if len(words) < 50 or 100 * len(again) > 50 * len(words):
        return False, set()
    broken = {r.measure for r in quality_rules.RULES if (r.least is not None and value[r.measure] < r.least)
              or (r.most is not None and value[r.measure] > r.most)}
    return not broken, broken


def test_kept_against_plain_loop(spark):
    rng = random.Random(11)
    words = "the of and in to house garden river stone light paper wolf night bridge winter candle".split()
    good = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(4)]
    one_each = [
        " ".join(rng.choice(words[5:]) + str(i) for i in range(80)),                                  # no stop words
        " ".join(f"{w} {rng.choice('#*$%&|<>') * 2}{i}" for i, w in enumerate(good[0].split())),      # symbols
        " ".join(rng.choice("abcdefg") + ("" if i % 9 else " the") for i in range(300)),              # short words
        " ".join(f"{'x' * 30}{i} the" for i in range(60)),                                            # long words
        good[1].upper().replace("THE", "the").replace("OF", "of"),                                    # capitals
        "\n".join([good[2]] + ["row"] * 5),                                                           # lines again
        " ".join(f"{w}{i} {w}{i} the" for i, w in enumerate(good[3].split())),                        # words twice
    ]
    exact = [" ".join(["the"] * 4 + [f"w{i}" for i in range(46)]), " ".join(["the"] + [f"w{i}" for i in range(49)])]
    texts = [*good, *one_each, *exact, "", "the " * 60, good[0][:200]]
    df = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(df).collect()}
    want = {i: plain_kept(t) for i, t in enumerate(texts)}
    assert got == {**{i: k for i, (k, _) in want.items()}, 99: False}
    assert set().union(*(b for _, b in want.values())) == {r.measure for r in quality_rules.RULES} and any(k for k, _ in want.values())
