"""Session helpers: a tuned local session for tests and benchmarks, and the
shared scratch folder for written intermediate tables."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app: str = "scriptorium", extra: dict | None = None) -> SparkSession:
    """Session for local runs. On a cluster, pass the cluster's own master and
    size ``shuffle_partitions`` to the data (AQE coalesces small ones)."""
    builder = SparkSession.builder.appName(app)
    # under spark-submit (which starts Python with a gateway port) the
    # launcher's master stands; otherwise default to local mode
    if master or "PYSPARK_GATEWAY_PORT" not in os.environ:
        builder = builder.master(master or os.environ.get("SCRIPTORIUM_MASTER", "local[*]"))
    builder = (
        builder
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # per-article Python batches carry whole texts: bound rows per batch
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        # small inputs: cut files into ~3 tasks per core (at scale the split
        # size is spark.sql.files.maxPartitionBytes and these do not bind)
        .config("spark.sql.files.openCostInBytes", str(512 * 1024))
        .config("spark.sql.files.minPartitionNum", str(3 * _cores(master)))
        .config("spark.driver.memory", os.environ.get("SCRIPTORIUM_DRIVER_MEMORY", "8g"))
        # checkpoints of intermediate rows (page index, sorted writers) are
        # removed from the shared folder once no longer referenced
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _cores(master: str | None) -> int:
    m = master or os.environ.get("SCRIPTORIUM_MASTER", "local[*]")
    if m.startswith("local[") and m[6:-1].isdigit():
        return int(m[6:-1])
    return os.cpu_count() or 8


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for written tables.

    Uses the cluster's ``spark.checkpoint.dir``. Only when the session has
    none (local tests) a fresh folder is created and registered as the
    checkpoint folder, so that ``DataFrame.checkpoint`` works as well.
    """
    sc = spark.sparkContext
    root = spark.conf.get(_CHECKPOINT_KEY, None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...) for this cluster")
        root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    if not sc.getCheckpointDir():
        # DataFrame.checkpoint needs the context to know the folder
        sc.setCheckpointDir(root)
    return root.rstrip("/")
