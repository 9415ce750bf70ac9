"""Releases: a set of tables that readers see all at once or not at all.

``publish`` writes every table into a new folder, checks what it wrote, and then swaps one small
pointer file by a rename, which replaces it in one step.  Readers go through ``current``, so they
see the last complete release while the next one is written, and a refresh that fails, or whose
check raises, leaves them where they were.  A release that nobody points to is only a folder.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "_current"


def _path(spark: SparkSession, path: str) -> JavaObject:
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str) -> JavaObject:
    return spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, path).toUri(), spark._jsc.hadoopConfiguration())


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """Replace the file at ``path`` by ``text`` in one step."""
    at, draft = _path(spark, path), _path(spark, f"{path}.{uuid.uuid4().hex}")
    fs = draft.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(draft, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    _files(spark, path).rename(draft, at, options)


def read_small(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, or None where there is none."""
    at = _path(spark, path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def current(spark: SparkSession, base: str) -> str | None:
    """Folder of the release that readers see, if there is one."""
    name = read_small(spark, f"{base}/{POINTER}")
    return f"{base}/{name}" if name else None


def read(spark: SparkSession, base: str, table: str) -> DataFrame:
    folder = current(spark, base)
    if folder is None:
        raise FileNotFoundError(f"nothing has been published under {base}")
    return spark.read.parquet(f"{folder}/{table}")


def counts(spark: SparkSession, base: str, tables: list[str]) -> DataFrame:
    """(table, rows) read back from the current release."""
    out = None
    for name in tables:
        one = read(spark, base, name).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def publish(spark: SparkSession, base: str, tables: dict[str, DataFrame], check: Callable[[dict[str, DataFrame]], object] | None = None) -> str:
    """Write ``tables`` as a release and let readers see it; ``check`` gets the tables read back
    and raises to stop it.  Returns the release's folder."""
    name = f"release-{uuid.uuid4().hex}"
    for table, df in tables.items():
        df.write.option("compression", "zstd").parquet(f"{base}/{name}/{table}")
    if check:
        check({table: spark.read.parquet(f"{base}/{name}/{table}") for table in tables})
    write_small(spark, f"{base}/{POINTER}", name)
    return f"{base}/{name}"
