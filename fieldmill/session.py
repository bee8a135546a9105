"""Session defaults, the shared checkpoint folder and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Session settings every fieldmill job relies on.  AQE re-plans joins at
# runtime (broadcast conversion, skew split, partition coalescing).
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # a checkpoint goes when nothing refers to its table any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # cp1252 source files need the legacy Java charset list (Spark 4.1).
    "spark.sql.legacy.javaCharsets": "true",
}


def build_session(master: str | None = None, app: str = "fieldmill",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or fetch) a session with fieldmill's defaults.

    On a cluster leave ``master`` as ``None`` so spark-submit decides.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting one only where none is set.

    The cluster names it in ``spark.checkpoint.dir``; a local test session
    without one gets a fresh folder under /tmp.  A non-local session without
    a configured folder is an error: a machine-local folder does not survive
    the loss of that machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset conf raises on some versions
            configured = None
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="fieldmill-ckpt-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique folder below the shared checkpoint folder."""
    base = checkpoint_dir(spark)
    return os.path.join(base, "fieldmill-scratch", f"{name}-{uuid.uuid4().hex}")


def stable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    Used where later passes must see exactly the same rows and partitioning
    (row numbering), and so that a lost executor re-reads the files instead
    of recomputing a non-deterministic plan.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
