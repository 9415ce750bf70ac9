"""SpotSigs fingerprints: chains of content words behind common-word anchors.

Every common word that stands directly before a content word is an anchor; its signature is
the anchor with the next three content words (common words between them are skipped).  The
first content word of a text and a content-defined sixteenth of all content words anchor a
chain too, so texts that hold few common words (tables, shouting, other languages) still get
signatures.  The fingerprint is the sorted set of signatures, eight hex digits each.

Fingerprints are compared as sets: set lengths fall into partitions that grow by the factor
1 / threshold, and a pair whose length ratio is under the threshold is pruned before its sets
are intersected.  The default threshold 0 prunes nothing, so every likeness is exact.

Defined results: null is the empty text, with no signature and the fingerprint ''; two empty
fingerprints have likeness 1.  A text without any content word gets one signature of its own.
Rows of equal doc_id are ordered by a hash of their text; null ids come first.  Only the id
and text columns are read.  Built-in functions only: no Python runs on the executors.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laborlake.llm.common import blocks_for, common_words, let

CHAIN = 3
SAMPLE = 16
DOCS_PER_BLOCK = 1024


def spot_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")), " "), lambda w: w != "")


def signatures(text: Column) -> Column:
    """The sorted set of a text's signatures, as longs of 32 bits."""
    common = common_words()
    text = F.coalesce(text, F.lit(""))
    low32 = F.lit(0xFFFFFFFF)

    def chains(w: Column, p: Column) -> Column:
        def gap(k: Column) -> Column:
            return F.get(p, k) - F.coalesce(F.get(p, k - 1), F.lit(-1)) > 1

        spots = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda k: gap(k) | (k == 0) | (
            F.pmod(F.xxhash64(F.get(w, F.get(p, k))), F.lit(SAMPLE)) == 0))
        return F.transform(spots, lambda k: F.xxhash64(
            F.get(w, F.when(gap(k), F.get(p, k) - 1).otherwise(F.lit(-1))),
            *(F.get(w, F.get(p, k + j)) for j in range(CHAIN))).bitwiseAND(low32))

    def of(w: Column) -> Column:
        content = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: ~F.get(w, i).isin(common))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(let(
            content, lambda p: F.when(F.size(p) == 0, F.array().cast("array<bigint>")).otherwise(chains(w, p))))

    found = F.sort_array(F.array_distinct(let(spot_words(text), of)))
    alone = F.when(F.trim(text) == "", F.array().cast("array<bigint>")).otherwise(
        F.array(F.xxhash64(text).bitwiseAND(low32)))
    return let(found, lambda s: F.when(F.size(s) > 0, s).otherwise(alone))


def fingerprint_text(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda s: F.lower(F.lpad(F.hex(s), 8, "0"))), "")


def length_partition(size: Column, threshold: float) -> Column:
    """Sets whose likeness can reach ``threshold`` lie in the same or in adjacent partitions."""
    return F.floor(F.log(F.greatest(size, F.lit(1))) / F.lit(-1.0) / F.log(F.lit(threshold))).cast("int")


def pruned_jaccard(a: Column, b: Column, threshold: float = 0.0) -> Column:
    """Exact Jaccard likeness, or 0 where the set lengths alone rule the threshold out."""
    least, most = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))

    def from_shared(shared: Column) -> Column:
        return shared.cast("double") / (F.size(a) + F.size(b) - shared)

    return (F.when(most == 0, F.lit(1.0)).when((least == 0) | (least < most * F.lit(threshold)), F.lit(0.0))
            .otherwise(let(F.size(F.array_intersect(a, b)), from_shared)))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, signatures, next text, next signatures) in ascending order of the id.

    Ids are cut into ranges of about ``DOCS_PER_BLOCK`` documents.  An id on which several cuts
    fall (null ids above all) gets as many ranges, by the hash of its texts.  The first document
    of a range is sent to the range before it as well, so each range finds all its successors by
    itself: the text is shuffled once and no task sees all rows.  Only rows alike in id and text
    stay in one range, however many.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2 ** 63)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = docs.count()
    blocks = blocks_for(n, DOCS_PER_BLOCK)
    cuts: list[int] = []
    if blocks > 1:
        at = [i / blocks for i in range(1, blocks)]
        cuts = sorted(docs.select(key.alias("__k")).agg(F.percentile_approx("__k", at, 100_000)).first()[0])
    repeated = len(set(cuts)) < len(cuts)
    # Without an id that several cuts name, the texts need no hash to be placed.
    mark = F.xxhash64(text) if repeated else F.lit(0).cast("long")
    of_cuts = F.array(*map(F.lit, cuts)).cast("array<bigint>")
    under = F.size(F.filter(of_cuts, lambda c: c < F.col("__k")))
    if repeated:
        same = F.size(F.filter(of_cuts, lambda c: c == F.col("__k")))
        # The place of a hash among all hashes, in 2^20 steps.
        step = F.shiftright(F.col("__h"), 44) + 2 ** 19
        block = under + F.when(same > 0, F.floor(step * same / 2 ** 20) + 1).otherwise(0)
    else:
        block = F.size(F.filter(of_cuts, lambda c: c <= F.col("__k")))
    block = block.cast("int")
    # One row for each range: bounded by blocks_for, not by the rows.
    first = {r[0]: r[1] for r in docs.select(key.alias("__k"), mark.alias("__h")).groupBy(block.alias("__b"))
             .agg(F.min(F.struct("__k", "__h"))).collect()}
    have = sorted(first)
    before = {b: have[i - 1] for i, b in enumerate(have)}
    size = len(cuts) + 1
    first_keys = F.array(*(F.lit(first[b][0] if b in first else None) for b in range(size))).cast("array<bigint>")
    first_marks = F.array(*(F.lit(first[b][1] if b in first else None) for b in range(size))).cast("array<bigint>")
    befores = F.array(*(F.lit(before.get(b, -1)) for b in range(size))).cast("array<int>")
    placed = docs.select(key.alias("__k"), mark.alias("__h"), F.col(id_col).alias("doc_id"), text.alias("__text")
                         ).withColumn("__b", block)
    own = F.struct(F.col("__b").alias("b"), F.lit(False).alias("ghost"))
    ghost = F.struct(F.get(befores, F.col("__b")).alias("b"), F.lit(True).alias("ghost"))
    leads = (F.col("__k") == F.get(first_keys, F.col("__b"))) & (F.col("__h") == F.get(first_marks, F.col("__b")))
    placed = placed.withColumn("__at", F.explode(F.when(leads, F.array(own, ghost)).otherwise(F.array(own))))
    dealt = (placed.select("doc_id", "__k", "__text", F.col("__at.b").alias("__b"), F.col("__at.ghost").alias("__ghost"))
             .repartition("__b")
             .withColumn("__sigs", signatures(F.col("__text"))))
    w = Window.partitionBy("__b").orderBy("__ghost", "__k", F.xxhash64("__text"))
    return (dealt.withColumn("__next", F.lead("__text").over(w)).withColumn("__next_sigs", F.lead("__sigs").over(w))
            .where(~F.col("__ghost")))


def edited(text: Column, following: Column) -> Column:
    """The last half of ``text`` (rounded down) replaced by as many characters of ``following``."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 threshold: float = 0.0) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likenesses."""
    both = with_next(docs, id_col, text_col).withColumn("__edited", edited(F.col("__text"), F.col("__next")))
    both = both.withColumn("__edited_sigs", signatures(F.col("__edited")))
    return both.select(
        "doc_id",
        F.char_length("__text").cast("long").alias("n_chars"),
        F.col("__edited").alias("edited_text"),
        F.col("__sigs").alias("signatures"),
        F.col("__edited_sigs").alias("edited_signatures"),
        pruned_jaccard(F.col("__sigs"), F.col("__edited_sigs"), threshold).alias("near_edited"),
        pruned_jaccard(F.col("__sigs"), F.col("__next_sigs"), threshold).alias("near_next"),
        F.size("__sigs").cast("long").alias("n_signatures"))
