"""`posting.discovered` events: encode, publish, subscribe.

The event is a JSON value keyed by ``posting_id`` (per-key ordering on a partitioned
topic).  With a Kafka connector on the classpath the sink/source is Kafka; otherwise (as
in tests — the connector jar is not in this environment) the same key/value records go to
JSON files in a shared folder and are read back with a file stream source.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

TOPIC = "posting.discovered"
EVENT_SCHEMA = ("posting_id string, title string, company string, region string, "
                "required_skills array<string>, source string, url string")
RECORD_SCHEMA = "key string, value string"


def encode_events(postings: DataFrame) -> DataFrame:
    """Postings → (key, value) records; value = JSON of the event fields (+ url)."""
    cols = set(postings.columns)
    opt = lambda c, t="string": F.col(c) if c in cols else F.lit(None).cast(t)
    company = F.col("company") if "company" in cols else opt("company_name")
    ev = F.struct(F.col("posting_id"), opt("title").alias("title"), company.alias("company"),
                  opt("region").alias("region"),
                  opt("required_skills", "array<string>").alias("required_skills"),
                  opt("source").alias("source"), opt("url").alias("url"))
    return postings.select(F.col("posting_id").alias("key"), F.to_json(ev).alias("value"))


def decode_events(records: DataFrame) -> DataFrame:
    """(key, value) records → event columns (bad JSON → NULL fields, row dropped)."""
    ev = F.from_json(F.col("value").cast("string"), EVENT_SCHEMA)
    return records.select(ev.alias("e")).select("e.*").filter(F.col("posting_id").isNotNull())


def kafka_available(spark: SparkSession) -> bool:
    try:
        spark._jvm.java.lang.Class.forName("org.apache.spark.sql.kafka010.KafkaSourceProvider")
        return True
    except Exception:  # noqa: BLE001
        return False


def publish(postings: DataFrame, path: str | None = None, bootstrap: str | None = None,
            topic: str = TOPIC, mode: str = "append") -> int:
    """Write one event per posting; returns the number of records written.  No connector and
    no path → 0.  ``mode`` is that of the file form: a step that may run again overwrites."""
    written = Observation()
    records = encode_events(postings).observe(written, F.count(F.lit(1)).alias("records"))
    spark = postings.sparkSession
    if bootstrap and kafka_available(spark):
        records.write.format("kafka").option("kafka.bootstrap.servers", bootstrap) \
               .option("topic", topic).save()
    elif path:
        records.hint("rebalance").write.mode(mode).option("compression", "gzip").json(path)  # files of a good size, however many tasks made the rows
    else:
        return 0
    return written.get["records"]


def subscribe(spark: SparkSession, path: str | None = None, bootstrap: str | None = None,
              topic: str = TOPIC, files_per_trigger: int | None = None) -> DataFrame:
    """Streaming source of (key, value) records."""
    if bootstrap and kafka_available(spark):
        return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", bootstrap)
                .option("subscribe", topic).option("startingOffsets", "latest").load()
                .select(F.col("key").cast("string"), F.col("value").cast("string")))
    reader = spark.readStream.schema(RECORD_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)
