"""Session helpers: a configured SparkSession and a reliable checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job of this package wants. AQE re-plans joins from real
# shuffle sizes (broadcast only below the threshold, skew splitting), and
# coalesces the many small shuffle partitions a cluster-sized default leaves.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # lookups by a key table: a Bloom filter of the keys runs in scans from this size on
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1g",
}


def get_session(master: str | None = None, app: str = "seatspark",
                shuffle_partitions: int | None = None,
                extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with the package defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting one only in local mode.

    On a cluster the folder must be shared storage named by
    ``spark.checkpoint.dir``; a machine-local folder would vanish with the
    executor that wrote it. Only a local-mode session (tests, bench) gets a
    scratch folder when nothing is configured.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "set spark.checkpoint.dir to a shared folder before running bulk changes")
    scratch = tempfile.mkdtemp(prefix="seatspark-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(scratch)
    return sc.getCheckpointDir()


def cut_lineage(df):
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder.

    Used where an iterative plan would otherwise grow without bound, and where
    a non-deterministic step (ids from partition positions) must not be
    recomputed differently after an executor is lost. Unlike a checkpointed
    plan, which keeps the size estimate of the plan it replaces (a product over
    all joins, growing with every round of a loop) and is computed twice, the
    table is computed once and has its true size, so small ones are broadcast.
    """
    return stored(df, "cut")


def stored(df, name: str):
    """Write ``df`` as Parquet to the shared folder and read it back, with its size known to the planner."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
