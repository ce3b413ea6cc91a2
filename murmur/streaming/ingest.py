"""Structured Streaming: feedback files landing in a folder (the upload flow)
are standardised, scored and appended to a feedback table, and a daily
timeline is kept with a watermark.

Each micro-batch is a static DataFrame, so ``foreachBatch`` applies the same
batch operators; the batch is written under ``batch_id=<n>`` with overwrite,
so a retried batch replaces its own output (exactly-once per batch). The
stream carries each row's file path and split start, so every arriving file
is numbered like an upload (generated ids 1..n per file)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from murmur.operators.enrich import detect_severity, score_sentiment
from murmur.operators.standardize import ORDER_COL, standardize_feedback


POS_BITS = 40   # positions inside a batch; the batch number is above them


def raw_feedback_stream(spark: SparkSession, source_dir: str, schema: str, fmt: str = "csv",
                        max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        raw = reader.option("header", True).option("multiLine", True).option("escape", '"').csv(source_dir)
    elif fmt == "json":
        raw = reader.json(source_dir)
    else:
        raise ValueError(f"no stream reader for {fmt!r}")
    return raw.select("*", F.col("_metadata.file_path").alias("_src_f"),
                      F.col("_metadata.file_block_start").alias("_src_b"))


def _with_order_key(batch: DataFrame) -> DataFrame:
    """The file readers' (file, split start, row) order key, rebuilt on a
    micro-batch from the file metadata carried by the stream."""
    key = F.struct(F.col("_src_f").alias("f"), F.col("_src_b").alias("b"),
                   F.monotonically_increasing_id().alias("r"))
    return batch.withColumn(ORDER_COL, key).drop("_src_f", "_src_b")


def ingest_stream(spark: SparkSession, source_dir: str, out_dir: str, schema: str, fmt: str = "csv",
                  ingest_ts=None, *, checkpoint: str, available_now: bool = True,
                  sentiment=None, dataset_col: str | None = "dataset") -> StreamingQuery:
    """Start the ingest query: standardise + sentiment + severity per batch,
    appended as Parquet under ``out_dir/batch_id=<n>``. ``dataset_col`` holds
    each row's file (its upload). ``pos`` is unique over all batches: the
    batch number, then the position in the batch. ``checkpoint`` is the
    stream's own folder, kept across restarts of the application."""
    raw = raw_feedback_stream(spark, source_dir, schema, fmt)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        std = standardize_feedback(_with_order_key(batch), ingest_ts=ingest_ts, dataset_col=dataset_col)
        std = std.withColumn("pos", F.col("pos") + F.lit(batch_id << POS_BITS))
        scored = detect_severity((sentiment or score_sentiment)(std))
        scored.write.mode("overwrite").parquet(os.path.join(out_dir, f"batch_id={batch_id}"))

    writer = raw.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def timeline_stream(feedback: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Daily counts of a stream of standardised rows; a day is emitted once
    the watermark (max date seen minus ``lateness``) has passed it."""
    return (
        feedback.where(F.col("date").isNotNull())
        .withWatermark("date", lateness)
        .groupBy(F.window("date", "1 day").alias("day"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.date_format("day.start", "yyyy-MM-dd").alias("date"), "count")
    )
