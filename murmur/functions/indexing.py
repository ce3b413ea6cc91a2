"""Distributed row numbering.

``Window.orderBy(...)`` without ``partitionBy`` moves every row into one task.
These helpers number rows with per-partition offsets instead: each partition
counts its rows, the (tiny, one row per partition) count table is prefix-summed
and broadcast, and every row adds its offset to its position inside the
partition. The frame is checkpointed first so both passes see the same
partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.session import cut_lineage

_PID = "__pid"
_MID = "__mid"


def _number_partitions(df: DataFrame, name: str, start: int) -> DataFrame:
    tagged = df.withColumn(_PID, F.spark_partition_id()).withColumn(_MID, F.monotonically_increasing_id())
    tagged = cut_lineage(tagged)
    counts = tagged.groupBy(_PID).agg(F.count(F.lit(1)).alias("__n"))
    # one row per partition: a proven size bound, safe to broadcast
    w = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(_PID, F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    local = F.col(_MID) - F.shiftleft(F.col(_PID).cast("long"), 33)
    return (
        tagged.join(F.broadcast(offsets), _PID)
        .withColumn(name, F.col("__off") + local + F.lit(start))
        .drop(_PID, _MID, "__off")
    )


def with_file_order_index(df: DataFrame, name: str, start: int = 1) -> DataFrame:
    """Number rows in their current (scan) order: file by file, offset by
    offset, as a reader sees them. Apply directly on a file scan."""
    return _number_partitions(df, name, start)


def with_ordinal(df: DataFrame, name: str, order_cols, start: int = 0) -> DataFrame:
    """``row_number() over (order by order_cols) - 1 + start`` without a
    single-partition window: range-partitioned sort, then partition offsets."""
    return _number_partitions(df.orderBy(*order_cols), name, start)


def with_sum_before(df: DataFrame, value_col: str, order_cols, name: str) -> DataFrame:
    """``sum(value) over (order by order_cols rows between unbounded preceding
    and 1 preceding)`` without a single-partition window: range-partitioned
    sort (``order_cols`` should be unique), running sums inside each range
    partition, plus the broadcast totals of the earlier partitions."""
    tagged = cut_lineage(df.orderBy(*order_cols).withColumn(_PID, F.spark_partition_id()))
    inside = Window.partitionBy(_PID).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    totals = tagged.groupBy(_PID).agg(F.sum(value_col).alias("__t"))
    w = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(_PID, F.coalesce(F.sum("__t").over(w), F.lit(0)).alias("__off"))
    return (
        tagged.withColumn("__in", F.coalesce(F.sum(value_col).over(inside), F.lit(0)))
        .join(F.broadcast(offsets), _PID)
        .withColumn(name, F.col("__off") + F.col("__in"))
        .drop(_PID, "__in", "__off")
    )
