"""Small helpers that the operators of this folder share."""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laborlake.session import shared_dir

#: Separators between words, as the contracts of the queries name them.
SPACE = r"[\x20\x09-\x0D]+"

#: Very common short words of the four languages of the corpus.
COMMON_WORDS = {
    "en": ("the of and to in a is that it for as was with be by on not he his but at are this have from or an they "
           "which you were there all been their has will").split(),
    "de": ("der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er "
           "hat dass sie nach").split(),
    "fr": ("de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou "
           "son elle").split(),
    "es": ("de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí "
           "es").split(),
}


def common_words() -> list[str]:
    return sorted({w for words in COMMON_WORDS.values() for w in words})


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body``.

    A plain column alias can be inlined by the optimizer into a lambda and evaluated again
    for every element; a lambda variable cannot.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text (null: none), split at ASCII white space only."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words_of(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder of its own below the shared checkpoint location."""
    return shared_dir(spark, f"{name}-{uuid.uuid4().hex}")


def settled(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: lineage ends here, and
    a lost executor costs a re-read instead of a re-run."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def per_process(key, make: Callable[[], object]):
    """What ``make`` returns, made once in each Python worker and kept for its later tasks."""
    import sys
    import types
    store = sys.modules.setdefault("_laborlake_kept", types.ModuleType("_laborlake_kept")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def release() -> None:
    """Hand unused memory of a Python worker back, as workers wait idle between tasks."""
    import ctypes
    import gc

    import pyarrow
    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def blocks_for(n: int, per_block: int, most: int = 20_000) -> int:
    """How many blocks hold ``n`` things at about ``per_block`` each; all of them are always
    covered, a count above ``most`` only makes the blocks larger."""
    return int(max(1, min(most, -(-n // per_block))))
