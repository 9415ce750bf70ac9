"""Quality rules: a table of thresholds compiled into one Spark projection.

``measures`` computes every ratio of a text with built-in functions, and ``compile_rules``
turns a table of ``Rule`` rows into one boolean column, so a scan, one projection and no
shuffle are the whole job.

Defined results: a null or empty text has zero for every count and every ratio; a document
without words fails the base.  Only the text column is read, so other columns may have any
names and any nulls.  Repeated rows each get their own result.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laborlake.llm.common import common_words, let, words_of

SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """A measure has to lie within [least, most]; None leaves that side open."""
    measure: str
    least: float | None = None
    most: float | None = None


#: The production table.
RULES = (
    Rule("mean_word_chars", least=2.0, most=14.0),
    Rule("symbol_ratio", most=0.06),
    Rule("stop_word_ratio", least=0.08),
    Rule("upper_ratio", most=0.5),
    Rule("dup_line_ratio", most=0.6),
    Rule("stutter_ratio", most=0.3),
)


def _repeated_words(words: Column) -> Column:
    """Words that lie in a window of three words which the text has twice or more.

    Windows are sorted as one long each (hash bits above, position below), and neighbours
    with the same hash bits are compared word by word.  Should two different windows share
    their bits, the windows of that text are sorted as text instead.
    """
    def covered(starts: Column) -> Column:
        return let(F.sort_array(starts), lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))),
            F.lit(0).cast("long"), lambda a, x: a + x))

    def as_text(w: Column) -> Column:
        spelled = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(
            F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i")))
        return let(F.sort_array(spelled), lambda c: covered(F.transform(
            F.filter(c, lambda x, k: F.coalesce(x["g"] == F.get(c, k - 1)["g"], F.lit(False))
                     | F.coalesce(x["g"] == F.get(c, k + 1)["g"], F.lit(False))),
            lambda x: x["i"])))

    def by_bits(w: Column, m: Column) -> Column:
        bits = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(m["high"]).bitwiseOR(i))

        def at(s: Column, k: Column) -> Column:
            return F.get(s, k).bitwiseAND(m["low"]).cast("int")

        def pairs(s: Column) -> Column:
            return F.transform(
                F.filter(F.sequence(F.lit(1), F.size(s) - 1),
                         lambda k: F.get(s, k).bitwiseXOR(F.get(s, k - 1)).bitwiseAND(m["high"]) == 0),
                lambda k: F.struct(at(s, k).alias("i"), at(s, k - 1).alias("j")))

        def differ(x: Column) -> Column:
            return ((F.get(w, x["i"]) != F.get(w, x["j"])) | (F.get(w, x["i"] + 1) != F.get(w, x["j"] + 1))
                    | (F.get(w, x["i"] + 2) != F.get(w, x["j"] + 2)))

        return let(F.sort_array(bits), lambda s: let(pairs(s), lambda p: F.when(F.size(p) == 0, F.lit(0).cast("long"))
                   .when(F.exists(p, differ), as_text(w))
                   .otherwise(covered(F.concat(F.transform(p, lambda x: x["i"]), F.transform(p, lambda x: x["j"]))))))

    def windows(w: Column) -> Column:
        low = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.size(w).cast("long")))) - 1
        return let(F.struct(low.alias("low"), F.bitwise_not(low).alias("high")), lambda m: by_bits(w, m))

    return F.when(F.size(words) >= 4, windows(words)).otherwise(F.lit(0).cast("long"))


def measures(text: Column) -> Column:
    """A struct of the base counts and the ratios that rules may name."""
    text = F.coalesce(text, F.lit(""))
    stop = sorted({s for w in common_words() for s in (w, w.capitalize())})

    def of(w: Column) -> Column:
        count = F.size(w).cast("long")
        per = F.greatest(count, F.lit(1)).cast("double")
        lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
        return F.struct(
            count.alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))) / F.greatest(F.size(x), F.lit(1)))
            .alias("dup_line_ratio"),
            _repeated_words(w).alias("n_repeat_words"),
            (F.size(F.filter(w, lambda x: x.isin(stop))) / per).alias("stop_word_ratio"),
            (F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")) / F.greatest(F.length(text), F.lit(1)))
            .alias("upper_ratio"),
            (F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))) / per).alias("stutter_ratio"),
        )

    out = let(words_of(text), of)
    return let(out, lambda m: F.struct(
        *(m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                  "stop_word_ratio", "upper_ratio", "dup_line_ratio", "stutter_ratio")),
        (m["word_chars"] / F.greatest(m["n_words"], F.lit(1))).alias("mean_word_chars"),
        (m["n_symbols"] / F.greatest(m["word_chars"], F.lit(1))).alias("symbol_ratio")))


def compile_rules(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean expression: every rule of the table holds."""
    ok = F.lit(True)
    for r in rules:
        if r.least is not None:
            ok = ok & (m[r.measure] >= F.lit(r.least))
        if r.most is not None:
            ok = ok & (m[r.measure] <= F.lit(r.most))
    return ok


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def quality_rules(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
                  rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``keep`` columns, the measures, ``base_failed`` and ``kept``; one row per input row."""
    m = F.col("__m")
    out = docs.select(*(F.col(c) for c in keep), measures(F.col(text_col)).alias("__m"))
    # The struct is referenced many times, which keeps the optimizer from inlining it.
    return out.select(*keep, "__m.*", base_failed(m).alias("base_failed"),
                      (~base_failed(m) & compile_rules(m, rules)).alias("kept"))
