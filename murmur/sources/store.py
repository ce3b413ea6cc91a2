"""Stored tables that are replaced as a whole: every write is a new version in a
folder of its own, and readers follow one small manifest file, which a rename
switches. A failed write leaves the old version in place, and a table may be
read, changed and written back. The version before the current one is kept for
readers that are still on it; older ones are removed."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "_current.json"
KEPT_VERSIONS = 2
EVIDENCE_BUCKETS = 64


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _manifest(spark: SparkSession, path: str) -> dict | None:
    jvm, where, fs = _hadoop(spark, f"{path}/{MANIFEST}")
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return json.loads(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def _switch(spark: SparkSession, path: str, manifest: dict) -> None:
    """The manifest in one step: written aside, renamed over the old one."""
    jvm, aside, fs = _hadoop(spark, f"{path}/.{MANIFEST}-{uuid.uuid4().hex}")
    stream = fs.create(aside)
    stream.write(bytearray(json.dumps(manifest).encode()))
    stream.close()
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(aside), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}")), how)


def save_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), **facts) -> None:
    """Replace the table at ``path`` by ``df`` (which may read that table).
    ``facts`` go to the manifest."""
    spark = df.sparkSession
    old = _manifest(spark, path)
    version = f"v-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(f"{path}/{version}")
    versions = [version, *(old["versions"] if old else [])]
    _switch(spark, path, {"versions": versions[:KEPT_VERSIONS], **facts})
    for gone in versions[KEPT_VERSIONS:]:
        _, where, fs = _hadoop(spark, f"{path}/{gone}")
        fs.delete(where, True)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a stored table."""
    manifest = _manifest(spark, path)
    if manifest is None:
        raise ValueError(f"there is no stored table at {path}")
    return spark.read.parquet(f"{path}/{manifest['versions'][0]}")


def _bucket(cluster, buckets: int):
    return F.pmod(F.xxhash64(cluster.cast("long")), F.lit(buckets)).cast("int")


def save_evidence(evidence: DataFrame, path: str, buckets: int = EVIDENCE_BUCKETS) -> None:
    """Evidence (:func:`~murmur.operators.insights.evidence_table`) stored by
    insight: folders of a hash of the cluster, files in ranges of (cluster, pos),
    so a cluster of any size is spread over files and one insight opens few."""
    placed = evidence.withColumn("bucket", _bucket(F.col("cluster"), buckets))
    ordered = placed.repartitionByRange("bucket", "cluster", "pos").sortWithinPartitions("bucket", "cluster", "pos")
    save_table(ordered, path, partition_by=("bucket",), buckets=buckets)


def open_evidence(spark: SparkSession, path: str, cluster: int | None = None) -> DataFrame:
    """Stored evidence of one insight (only its folder is read), or of all."""
    table = load_table(spark, path)
    if cluster is not None:
        own = _bucket(F.lit(cluster), _manifest(spark, path)["buckets"])
        table = table.where((F.col("bucket") == own) & (F.col("cluster") == cluster))
    return table.drop("bucket")
