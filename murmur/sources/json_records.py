"""Records of one large JSON document that is read in splits.

The document is read in pieces that end at a closing brace, wherever it stands.
Whether a piece starts inside a string is the parity of the quotes before it, and
the depth of brackets at its end is a sum over the pieces before it: two prefix
sums, inside splits and over the splits of a file. A record of the list ends
where a brace outside strings brings the depth back to that of the list; the
pieces up to there are put together by (file, number of record).

Documents are a list of objects, or an object whose first and only key is one
of the record keys and holds such a list; others raise an error and are read
with the document layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmur.session import cut_lineage


def _before(rows: DataFrame, value: str, out: str) -> DataFrame:
    """Adds the sum of ``value`` over the pieces of the file before a row."""
    inside = Window.partitionBy("_f", "_b").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("_f").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy("_f", "_b").agg(F.sum(value).alias("_t")).select(
        "_f", "_b", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_t"))
    return rows.join(splits, ["_f", "_b"]).withColumn(
        out, F.col("_t") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_t")


def _opened(text: Column) -> Column:
    """Brackets opened less brackets closed, outside strings, of a piece that
    starts outside them (it holds no closing brace)."""
    plain = F.regexp_replace(text, '"[^"]*("|$)', "")
    return (F.length(plain) - F.length(F.translate(plain, "{[", ""))) - (F.length(plain) - F.length(F.translate(plain, "]", "")))


def json_records(spark: SparkSession, path, keys: tuple[str, ...]) -> DataFrame:
    """(_f, _b, _r, value): the text of every record, its file, split and order."""
    text = F.regexp_replace("value", r"(?s)\\.", "")      # without escapes
    pieces = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"),
        F.monotonically_increasing_id().alias("_r"), "value", text.alias("_x"))
    pieces = cut_lineage(pieces.select(
        "_f", "_b", "_r", "value", (F.length("_x") - F.length(F.replace("_x", F.lit('"'), F.lit("")))).cast("long").alias("_q"),
        _opened(F.col("_x")).cast("long").alias("_d0"),
        _opened(F.regexp_replace("_x", '^[^"]*("|$)', "")).cast("long").alias("_d1")))
    scan = _before(pieces, "_q", "_q0")
    outside = (F.col("_q0") + F.col("_q")) % 2 == 0
    scan = scan.withColumns({"_out": outside, "_d": F.when(F.col("_q0") % 2 == 0, F.col("_d0")).otherwise(F.col("_d1"))
                             - outside.cast("long")})
    # the list's depth, from the document's start
    heads = pieces.groupBy("_f").agg(F.min(F.struct("_b", "_r", F.substring("value", 1, 4096).alias("v")))["v"].alias("_s"))
    wrapper = "^﻿?\\s*\\{\\s*\"(" + "|".join(keys) + ")\"\\s*:\\s*\\["
    level = F.when(F.col("_s").rlike("^﻿?\\s*\\["), 1).when(F.col("_s").rlike(wrapper), 2)
    heads = heads.select("_f", F.coalesce(level, F.raise_error(F.lit("not a list of records, read it as a document")).cast("int")).alias("_level"))
    scan = _before(scan, "_d", "_depth").join(heads, "_f").withColumn(
        "_end", (F.col("_out") & (F.col("_depth") + F.col("_d") == F.col("_level"))).cast("long"))
    scan = _before(scan, "_end", "_rec")
    whole = scan.groupBy("_f", "_rec").agg(
        F.array_sort(F.collect_list(F.struct("_b", "_r", "value"))).alias("_p"), F.max("_end").alias("_end"))
    whole = whole.select("_f", "_rec", "_end", F.col("_p")[0]["_b"].alias("_b"), F.col("_p")[0]["_r"].alias("_r"),
                         F.array_join(F.transform("_p", lambda p: p["value"]), "}").alias("value"))
    # before a record: the list's start or a comma; after the last: the list's end
    first, other = f"(?:^﻿?\\s*\\[|{wrapper})\\s*(?=\\{{)", r"^\s*,\s*(?=\{)"
    lead = F.when(F.col("_rec") == 0, F.lit(first)).otherwise(F.lit(other))
    tail = f"^(?:(?:﻿?\\s*\\[|{wrapper[1:]})\\s*)?\\s*\\]\\s*\\}}?\\s*$"
    fits = F.when(F.col("_end") == 1, F.rlike("value", lead)).otherwise(F.col("value").rlike(tail) | F.col("value").rlike(r"^\s*$"))
    kept = F.when(fits, F.col("_end") == 1).otherwise(
        F.raise_error(F.lit("not a list of objects only, read it as a document")).cast("boolean"))
    record = F.concat(F.regexp_replace("value", lead, F.lit("")), F.lit("}"))
    return whole.where(kept).select("_f", "_b", "_r", record.alias("value"))
