"""Spark session helpers.

Library code never creates its own session: every public function takes a
``SparkSession`` or a ``DataFrame``.  ``local_session`` is for tests, the
bench script and examples only.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # local runs: small shuffles feed CPU-heavy in-row work (token arrays, COD,
    # anchors); keep post-shuffle partitions small enough to use every core
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": os.environ.get("DRAFTSMITH_TZ", "UTC"),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "draftsmith") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if os.environ.get("DRAFTSMITH_EVENT_LOG"):  # a scratch folder for stage/task metrics (bench)
        builder = (
            builder.config("spark.eventLog.enabled", "true")
            .config("spark.eventLog.dir", os.environ["DRAFTSMITH_EVENT_LOG"])
            .config("spark.eventLog.compress", "false")
        )
    builder = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("DRAFTSMITH_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session.  Only when it is unset
    *and* the master is local (tests, the bench) a scratch folder is created,
    because a machine-local folder is useless to executors of a real cluster.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    scratch = tempfile.mkdtemp(prefix="draftsmith-ckpt-", dir=os.environ.get("DRAFTSMITH_SCRATCH", "/tmp"))
    sc.setCheckpointDir(scratch)
    return sc.getCheckpointDir() or scratch


# Largest row bound accepted for an explicit broadcast (a model constant such
# as a vocabulary, never a data-dependent size).
MAX_BROADCAST_ROWS = 1 << 22


def broadcast_bounded(df, bound: int, what: str):
    """``F.broadcast(df)`` for a table whose row count is bounded by ``bound``
    *by construction* (a parameter, not a measured size).  Larger bounds are
    refused: such a side must be joined by shuffle (AQE still broadcasts it
    at run time when it turns out small)."""
    from pyspark.sql import functions as F

    if bound > MAX_BROADCAST_ROWS:
        raise ValueError(f"{what}: bound {bound} rows exceeds the broadcast limit {MAX_BROADCAST_ROWS}; use a shuffle join")
    return F.broadcast(df)
