"""WARC archives: written by Spark, read back by a Python data source.

Writing: every page becomes one record, its version line, headers, a blank line and its block.
Records are plain text in UTF-8, so Spark's own text writer stores them (with the two line
ends that close a record as separator) in whatever file system the folder lies in, and a
failed task's files are never seen.  Of the records with equal payloads the one with the
smallest page id is a ``response`` with the whole payload, the others are ``revisit`` records
that refer to it and have no payload.

Reading: the data source ``warc`` plans one partition per archive file.  Filters on header
columns (equality, IN, null tests) are pushed down and checked on the parsed headers, before
a payload is touched; payloads that no row needs are skipped, not decoded.

Defined results: null html is the empty payload; a null url has no target header, and control
characters and blanks in a url are percent-encoded; a null page id sorts after all others and
has no record id.  Rows with the smallest id of their payload are all responses.  An empty
table gives archives without records.  Only the three page columns are read.
"""
from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull
from pyspark.sql.types import StructType

from laborlake.llm.common import scratch

CRLF = "\r\n"
FIELDS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI",
          "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "payload_length": "WARC-Payload-Length"}
SCHEMA = ("record_type string, record_id string, target_uri string, payload_digest string, refers_to string, "
          "payload_length long, payload binary")


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of 40 hex digits: eight groups of five digits, four letters each."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")

    def group(i: int) -> Column:
        n = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("long")
        return F.concat(*(F.substring(alphabet, F.shiftright(n, 15 - 5 * j).bitwiseAND(31).cast("int") + 1, F.lit(1))
                          for j in range(4)))
    return F.concat(*(group(i) for i in range(8)))


def page_urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def records(pages: DataFrame, min_payload: int = 0, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """One WARC record per page as a column ``record``."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.select("*", F.octet_length("html").cast("long").alias("bytes"), F.sha1("html").alias("sha"))
    # The smallest id per payload is combined before the shuffle, so copies cost one row a task.
    none = F.lit(2 ** 63 - 1)
    first = rows.groupBy("sha").agg(F.min(F.coalesce("page_id", none)).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = rows.join(first.select("sha", "first"), "sha", "left")
    revisit = (F.col("bytes") >= min_payload) & (F.coalesce("page_id", none) > F.col("first"))
    revisit = F.coalesce(revisit, F.lit(False))
    digest = F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha")))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("bytes").cast("string"), F.lit(CRLF * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    target = F.url_encode(F.col("url"))
    target = F.when(F.col("url").rlike(r"[^\x21-\x7e]"), target).otherwise(F.col("url"))

    def header(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))

    return rows.select(F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        header("WARC-Record-ID", page_urn(F.col("page_id"))),
        F.lit(f"WARC-Date: 1970-01-01T00:00:00Z{CRLF}"),
        header("WARC-Target-URI", target),
        header("WARC-Payload-Digest", digest),
        header("WARC-Payload-Length", F.col("bytes").cast("string")),
        header("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        header("WARC-Refers-To", F.when(revisit, page_urn(F.col("first")))),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"),
        header("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF), block).alias("record"))


def write_warc(pages: DataFrame, path: str, min_payload: int = 0) -> list[str]:
    """Write the archives below ``path``; returns their files."""
    spark = pages.sparkSession
    (records(pages, min_payload).write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path))
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().toString() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-"))


def open_archive(uri: str) -> io.BufferedIOBase:
    """A local path or any URI that pyarrow's file systems know."""
    if uri.startswith("file:") or "://" not in uri:
        raw: io.BufferedIOBase = open(uri.removeprefix("file://").removeprefix("file:"), "rb")
    else:
        from pyarrow import fs
        store, at = fs.FileSystem.from_uri(uri)
        raw = io.BufferedReader(store.open_input_file(at))
    return gzip.GzipFile(fileobj=raw) if uri.endswith(".gz") else raw


def _skip(f: io.BufferedIOBase, n: int) -> None:
    while n > 0:
        got = len(f.read(min(n, 1 << 20)))
        if not got:
            raise ValueError("archive ends inside a record")
        n -= got


def read_records(f: io.BufferedIOBase, wanted=lambda headers: True, payloads: bool = True) -> Iterator[tuple[dict, bytes | None]]:
    """(headers, payload) of the records that ``wanted`` accepts by their headers alone."""
    while True:
        line = f.readline()
        while line in (b"\r\n", b"\n"):
            line = f.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := f.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        length = int(headers["content-length"])
        if not wanted(headers):
            _skip(f, length)
            continue
        if not payloads:
            _skip(f, length)
            yield headers, None
            continue
        block = f.read(length)
        if len(block) < length:
            raise ValueError("archive ends inside a record")
        if headers.get("content-type", "").startswith("application/http"):
            block = block.partition(b"\r\n\r\n")[2]
        yield headers, None if headers.get("warc-type") == "revisit" else block


class Archive(InputPartition):
    def __init__(self, uri: str):
        super().__init__(uri)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.uris = options.get("files", "").split("\n") if options.get("files") else []
        self.columns = [f.name for f in schema.fields]
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in FIELDS and isinstance(f, EqualTo):
                self.tests.append((name, "in", [f.value]))
            elif name in FIELDS and isinstance(f, In):
                self.tests.append((name, "in", list(f.value)))
            elif name in FIELDS and isinstance(f, IsNotNull):
                self.tests.append((name, "set", True))
            elif name in FIELDS and isinstance(f, IsNull):
                self.tests.append((name, "set", False))
            else:
                yield f

    def partitions(self) -> list[Archive]:
        return [Archive(u) for u in self.uris] or [Archive("")]

    def value(self, headers: dict, name: str):
        v = headers.get(FIELDS[name].lower())
        return int(v) if name == "payload_length" and v is not None else v

    def accepts(self, headers: dict) -> bool:
        for name, kind, want in self.tests:
            v = self.value(headers, name)
            if (v is not None) != want if kind == "set" else v not in want:
                return False
        return True

    def read(self, partition: Archive) -> Iterator[tuple]:
        if not partition.value:
            return
        with open_archive(partition.value) as f:
            for headers, payload in read_records(f, self.accepts, "payload" in self.columns):
                yield tuple(payload if c == "payload" else self.value(headers, c) for c in self.columns)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options, schema)


def read_warc(spark: SparkSession, files: list[str], columns: tuple[str, ...] | None = None) -> DataFrame:
    """The records of the archives.  A Python source is not told which columns a query needs,
    so ``columns`` names them: without ``payload`` no payload is decoded."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    kinds = {c.split()[0]: c for c in SCHEMA.split(", ")}
    schema = ", ".join(kinds[c] for c in columns or kinds)
    return spark.read.format("warc").schema(schema).option("files", "\n".join(files)).load()


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def round_trip(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """Archive the pages and read them back: one row per page.

    Responses are read with their payloads, from which size and digest are computed again;
    revisits have theirs in the headers, so their scan skips every payload.
    """
    spark = pages.sparkSession
    files = write_warc(pages, scratch(spark, "warc"), min_payload)
    page = F.regexp_extract("record_id", r"urn:page:(-?\d+)", 1).try_cast("long")
    refers = F.regexp_extract("refers_to", r"urn:page:(-?\d+)", 1).try_cast("long")
    full = read_warc(spark, files, ("record_type", "record_id", "payload")).where(F.col("record_type") == "response")
    slim = (read_warc(spark, files, ("record_type", "record_id", "payload_digest", "refers_to", "payload_length"))
            .where(F.col("record_type") == "revisit"))
    return full.select(
        page.alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_of_hex(F.sha1("payload")).alias("payload_digest"), "record_type",
        F.lit(None).cast("long").alias("refers_to"),
    ).unionByName(slim.select(
        page.alias("page_id"), F.col("payload_length").alias("payload_bytes"),
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type",
        refers.alias("refers_to")))
