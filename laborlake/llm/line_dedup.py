"""Lines that many documents share are dropped from all of them.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased.  The lines of
every text are exploded to (document, position, key hash); the distinct documents of a hash are
counted in two steps, first per (hash, document), so a line that stands in a third of all
documents is reduced before it meets itself.  Hashes in ``min_docs`` documents or more form a
written table.  The exploded lines are joined to it; the hashes that hold more than a
``HOT``-th of all common lines (never more than ``HOT`` of them, hence broadcast) are dealt over
``SALT`` parts.  Positions come together per document and the other lines are joined in order.

A document is the pair of its id and text: rows alike in both count once and all get the same
result, rows that share a null or used id but not the text are different documents.  A null
text is the empty text, which is one empty line.  Keys under ``min_chars`` code points always
stay.  Where every line goes, the kept text is empty.  An empty table gives an empty result.
Only the id and text columns are read.
"""
from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laborlake.llm.common import let, settled

MIN_DOCS = 10
MIN_CHARS = 1
HOT = 2048
SALT = 64
STRIPPED = " \t\n\x0b\f\r"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(STRIPPED)), ascii_uppercase, ascii_lowercase)


def _wide_hash(names: tuple[str, str], *of: Column) -> list[Column]:
    """128 bits as two longs: the same value under two seeds."""
    return [F.xxhash64(F.lit(seed), *of).alias(name) for seed, name in enumerate(names)]


def exploded_lines(rows: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(d1, d2, pos, h1, h2): one row for each line with a key, pos counted from 1."""
    lines = rows.select("d1", "d2", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keyed = lines.select("d1", "d2", (F.col("pos") + 1).alias("pos"), line_key(F.col("line")).alias("key"))
    return keyed.where(F.char_length("key") >= min_chars).select("d1", "d2", "pos", *_wide_hash(("h1", "h2"), F.col("key")))


def common_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(h1, h2, docs, lines) of the hashes found in at least ``min_docs`` distinct documents."""
    per_doc = lines.groupBy("h1", "h2", "d1", "d2").agg(F.count(F.lit(1)).alias("n"))
    return (per_doc.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("lines"))
            .where(F.col("docs") >= min_docs))


def _dropped(lines: DataFrame, common: DataFrame, hot: int, salt: int) -> DataFrame:
    """(d1, d2, gone): the positions of each document's common lines."""
    total = common.agg(F.sum("lines").alias("n")).first()["n"] or 0
    is_hot = F.col("lines") * hot > total
    heavy = common.where(is_hot).select("h1", "h2", F.lit(True).alias("heavy"))
    lines = (lines.join(F.broadcast(heavy), ["h1", "h2"], "left")
             .withColumn("part", F.when(F.col("heavy"), F.pmod("d1", F.lit(salt))).otherwise(0).cast("int")).drop("heavy"))
    parts = F.when(is_hot, F.sequence(F.lit(0), F.lit(salt - 1))).otherwise(F.array(F.lit(0)))
    dealt = common.select("h1", "h2", F.explode(parts).alias("part"))
    return lines.join(dealt, ["h1", "h2", "part"]).groupBy("d1", "d2").agg(F.collect_set("pos").alias("gone"))


def drop_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS,
                      min_chars: int = MIN_CHARS, hot: int = HOT, salt: int = SALT) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped and the kept text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", "text", *_wide_hash(("d1", "d2"), F.col("doc_id"), F.col("text")))
    lines = exploded_lines(rows, min_chars)
    common = settled(common_lines(lines, min_docs), "common-lines")
    out = rows.join(_dropped(lines, common, hot, salt), ["d1", "d2"], "left")
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    kept = let(F.split("text", "\n"), lambda all_lines: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(1), F.size(all_lines)), gone), lambda i: F.element_at(all_lines, i)), "\n"))
    return out.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
                      F.size(gone).cast("long").alias("n_dropped"), F.when(F.size(gone) == 0, F.col("text")).otherwise(kept).alias("kept"))
