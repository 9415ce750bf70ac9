"""Spark session construction and shared-storage helpers.

On a cluster the session is created by the launcher (spark-submit / notebook) and every
setting below comes from the cluster configuration; ``get_session`` only fills in values
that are *unset*, so tests and local runs get sane defaults without overriding a cluster.
"""
from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

# Defaults for a local run. On a 1000-executor cluster these are expected to come from
# spark-defaults.conf / spark-submit; AQE re-plans shuffle sizes and join strategies at
# runtime from measured statistics either way.
LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
    # Keyed streaming state (dedupe, status) off-heap and spillable, as on a cluster.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, app_name: str = "laborlake",
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Return the active session, or build a local one for tests and benchmarks."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(LOCAL_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return ``spark.checkpoint.dir``; only when the cluster left it unset (tests, local
    runs) do we point it at a fresh local scratch folder."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir has to name a shared folder on {master or 'this master'}")
        current = tempfile.mkdtemp(prefix="laborlake-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    spark.sparkContext.setCheckpointDir(current)
    return current


def shared_dir(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint location (used for lineage cuts and
    streaming checkpoints) — never a machine-local temp folder on a cluster."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint into ``spark.checkpoint.dir`` (survives executor loss)."""
    return df.checkpoint(eager=eager)
