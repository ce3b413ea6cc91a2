"""Session helpers: building a local session for tests/bench, and finding the
shared checkpoint folder the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "murmur",
                  conf: dict[str, str] | None = None) -> SparkSession:
    """Local session for tests and the bench, with further settings in
    ``conf``. On a cluster, use the cluster's own session; every operator only
    needs ``spark.checkpoint.dir``."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config(map=conf or {})
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder. The cluster's setting wins; only
    when it is unset (local tests) do we create one of our own."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="murmur-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str, ext: str = "") -> str:
    """A fresh folder next to the checkpoints (shared storage on a cluster),
    used when an operator must hand data over through files."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "murmur-scratch", f"{name}-{uuid.uuid4().hex}{ext}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss); never localCheckpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int):
    """While it lasts, Python workers are sent at most ``rows`` rows at a time:
    for steps over long texts that are run inside it. The user's setting is put
    back afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        if int(before) <= 0 or int(before) > rows:
            spark.conf.set(key, str(rows))
        yield
    finally:
        spark.conf.set(key, before)
