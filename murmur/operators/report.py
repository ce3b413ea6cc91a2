"""Dataset-level outputs and sinks: stats (D1), timeline (D2), non-finite
sanitising (D3), JSON serialisation (D4), persisting the standardised table
(D5) and evidence tracing (D6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# --- D1 --------------------------------------------------------------------------
def dataset_stats(feedback: DataFrame, insights: DataFrame, group_col: str | None = None) -> DataFrame:
    """One row (per group): total feedback, insights, HIGH-priority insights,
    strong signals (the value the pipeline emits, ``STRONG SIGNAL``), distinct
    sources. An insight whose evidence takes several rows (``chunk_no``) counts
    once."""
    if "chunk_no" in insights.columns:
        insights = insights.where("chunk_no = 0")
    ins_aggs = [
        F.count(F.lit(1)).alias("active_insights"),
        F.count_if(F.upper("priority") == "HIGH").alias("high_priority"),
        F.count_if(F.upper("signal_strength") == "STRONG SIGNAL").alias("strong_signals"),
    ]
    fb_aggs = [F.count(F.lit(1)).alias("total_feedback"), F.count_distinct("source").alias("sources")]
    if group_col:
        ins = insights.groupBy(group_col).agg(*ins_aggs)
        fb = feedback.groupBy(group_col).agg(*fb_aggs)
        out = fb.join(ins, group_col, "left")
        return out.select(group_col, "total_feedback",
                          *[F.coalesce(F.col(c), F.lit(0)).alias(c)
                            for c in ("active_insights", "high_priority", "strong_signals")], "sources")
    ins = insights.select(F.struct(*ins_aggs)).scalar()
    fb = feedback.agg(*fb_aggs)
    # the insight figures are a one-row scalar subquery, inlined once
    return fb.select(
        "total_feedback",
        ins.getField("active_insights").alias("active_insights"),
        ins.getField("high_priority").alias("high_priority"),
        ins.getField("strong_signals").alias("strong_signals"),
        "sources",
    )


# --- D2 --------------------------------------------------------------------------
def feedback_timeline(feedback: DataFrame, date_col: str = "date", group_col: str | None = None) -> DataFrame:
    """Rows per calendar day (``yyyy-MM-dd``, per group), null dates dropped,
    ascending."""
    lead = [group_col] if group_col else []
    return (
        feedback.where(F.col(date_col).isNotNull())
        .groupBy(*lead, F.date_format(date_col, "yyyy-MM-dd").alias("date"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(*lead, "date")
    )


# --- D3 --------------------------------------------------------------------------
def _sanitize(col, dtype):
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(col) | (F.abs(col) == F.lit(float("inf"))), F.lit(None).cast(dtype)).otherwise(col)
    if isinstance(dtype, T.TimestampType) or isinstance(dtype, T.TimestampNTZType):
        # like Python's isoformat(): fraction only when there are microseconds
        return F.when(F.unix_micros(col.cast("timestamp")) % 1_000_000 == 0,
                      F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(
            F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    if isinstance(dtype, T.DateType):
        return F.date_format(col, "yyyy-MM-dd")
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: _sanitize(x, dtype.elementType))
    if isinstance(dtype, T.StructType):
        inner = F.struct(*[_sanitize(col.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields])
        return F.when(col.isNotNull(), inner)   # a null struct stays null
    if isinstance(dtype, T.MapType):
        return F.transform_values(col, lambda _k, v: _sanitize(v, dtype.valueType))
    return col


def sanitize_nonfinite(df: DataFrame) -> DataFrame:
    """NaN and +-Inf become null, timestamps become ISO strings, recursively
    through arrays, structs and maps. Schema-driven projection, no UDF."""
    return df.select(*[_sanitize(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


# --- D4 --------------------------------------------------------------------------
def insights_json(insights: DataFrame) -> DataFrame:
    """One JSON document per insight row (several an insight, told apart by
    ``chunk_no``, where its evidence is long), nulls kept (after D3, so no ``NaN``)."""
    clean = sanitize_nonfinite(insights)
    return clean.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def write_insights_json(insights: DataFrame, path: str) -> None:
    insights_json(insights).write.mode("overwrite").text(path)


# --- D5 --------------------------------------------------------------------------
def write_feedback(feedback: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Persist the standardised table, replacing the previous one. CSV dates
    are written in a form that the readers parse back exactly."""
    writer = feedback.write.mode("overwrite")
    if fmt == "parquet":
        writer.parquet(path)
    elif fmt == "csv":
        (writer.option("header", True).option("escape", '"').option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    else:
        raise ValueError(f"no writer for {fmt!r}")


# --- D6 --------------------------------------------------------------------------
def trace_evidence(evidence: DataFrame, cluster: int | None = None) -> DataFrame:
    """Supporting rows of one insight (or all), in row order."""
    ev = evidence if cluster is None else evidence.where(F.col("cluster") == cluster)
    return ev.orderBy("cluster", "pos")


def insight_of_feedback(feedback: DataFrame, evidence: DataFrame, key: str | list[str] = "pos") -> DataFrame:
    """Reverse trace: each feedback row with the insight (cluster) it supports,
    null when it supports none; the number of rows does not change. The join
    is on the row's position (with its dataset, where positions restart),
    because ids of different uploads may be equal."""
    keys = [key] if isinstance(key, str) else list(key)
    return feedback.join(evidence.select(*keys, "cluster"), keys, "left")
