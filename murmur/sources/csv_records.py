"""CSV records of files that are read in splits.

A quoted field may hold line breaks, so whether a line starts a record depends
on all lines before it. Every line is a function of two states (outside or
inside a quoted field at its start) to the state at its end: a constant, the
identity or a swap. Such functions compose, so the state at any line is a prefix
scan: over the lines of a split (bounded by the split size) and over the splits
of a file (one row a split).

Only files in which some line ends inside a quoted field need this; their lines
are stored once, so that all steps see the same splits. Only quotes at the start
of a field open it: ``5" screen`` is plain text. Line breaks inside a field are
read as ``\\n``; blank records are skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmur.session import cut_lineage

_QUOTED = '[^"]*+(?:""[^"]*+)*+'                         # up to the closing quote
_FIELD = f'(?:"{_QUOTED}"[^,]*+|[^",][^,]*+|)'
_OPEN_FROM_OUTSIDE = f'^(?:{_FIELD},)*+"{_QUOTED}\\z'
_OPEN_FROM_INSIDE = f'^(?:{_QUOTED}\\z|{_QUOTED}"[^,]*+,(?:{_FIELD},)*+"{_QUOTED}\\z)'


def _lines(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"),
        F.monotonically_increasing_id().alias("_r"), "value")


def _ends_open(pattern: str, plain: bool) -> Column:
    """The state after a line; ``plain``: after one without quotes."""
    return F.when(F.contains("value", F.lit('"')), F.col("value").rlike(pattern)).otherwise(F.lit(plain))


def _full() -> Column:
    return F.col("value").rlike("[^\\x00-\\x20]")


def _state_before(part: list[str], by: str, const: Column, swaps: Column, start: Column) -> Column:
    """Whether a quoted field is open before a row: the last constant of the
    rows before it, else ``start``, turned by the swaps since."""
    before = Window.partitionBy(*part).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    upto = F.sum(swaps).over(Window.partitionBy(*part).orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    last = F.last(F.when(const.isNotNull(), F.struct(const.alias("v"), upto.alias("s"))), ignorenulls=True).over(before)
    total = F.coalesce(F.sum(swaps).over(before), F.lit(0))
    return F.coalesce(last["v"], start) != (F.coalesce(total - last["s"], total) % 2 == 1)


def header_names(header: Column) -> Column:
    """The names in a header record."""
    own = F.regexp_extract_all(F.concat(F.lit(","), F.ltrim(header, F.lit("﻿"))), F.lit(',("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    return F.transform(own, lambda n: F.when(
        n.rlike('^".*"$'), F.replace(n.substr(F.lit(2), F.length(n) - 2), F.lit('""'), F.lit('"'))).otherwise(n))


def csv_files(spark: SparkSession, path, breaks: bool = True) -> DataFrame:
    """(_f, header, names, broken) of every file that is not blank: its first
    line that is not, the names in it, and whether a quoted field of the file
    holds a line break (not looked for without ``breaks``). ``path`` may be a
    list. One pass over the lines."""
    first = F.min_by("value", F.when((F.col("_b") == 0) & _full(), F.col("_r")))
    broken = F.bool_or(_ends_open(_OPEN_FROM_OUTSIDE, False)) if breaks else F.lit(False)
    files = _lines(spark, path).groupBy("_f").agg(first.alias("header"), broken.alias("broken")).where("header is not null")
    return cut_lineage(files.withColumn("names", header_names(F.col("header"))))


def csv_records(spark: SparkSession, path, files: DataFrame) -> DataFrame:
    """(_f, _b, _r, value): the records of the broken ones of ``files``, their
    split and order in it, without header and blank records."""
    lines = _lines(spark, path).join(files.where("broken").select("_f"), "_f", "left_semi")
    # the state after the line, from outside and from inside a quoted field
    lines = cut_lineage(lines.withColumns({"_out": _ends_open(_OPEN_FROM_OUTSIDE, False),
                                           "_in": _ends_open(_OPEN_FROM_INSIDE, True)}))
    const, swap = F.col("_out") == F.col("_in"), F.col("_out") & ~F.col("_in")
    splits = lines.groupBy("_f", "_b").agg(
        F.max(F.when(const, F.struct("_r", F.col("_out").alias("v")))).alias("c"),
        F.collect_list(F.when(swap, F.col("_r"))).alias("s"), F.min(F.when(_full(), F.col("_r"))).alias("full")).select(
        "_f", "_b", "full", F.col("c.v").alias("v"),
        F.size(F.filter("s", lambda r: F.col("c").isNull() | (r > F.col("c._r")))).cast("long").alias("swaps"))
    # a split is a constant with the swaps after its last constant, or all its swaps
    start = _state_before(["_f"], "_b", F.col("v") != (F.col("swaps") % 2 == 1), F.col("swaps"), F.lit(False))
    heads = F.min(F.when(F.col("full").isNotNull(), F.struct("_b", F.col("full").alias("_r")))).over(Window.partitionBy("_f"))
    splits = cut_lineage(splits.select("_f", "_b", start.alias("start"), heads.alias("_head")))
    opened = _state_before(["_f", "_b"], "_r", F.when(const, F.col("_out")), swap.cast("long"), F.col("start"))
    whole = _joined_records(lines.join(splits, ["_f", "_b"]).withColumn("_opened", opened))
    return whole.where((F.struct("_b", "_r") != F.col("_head")) & _full()).select("_f", "_b", "_r", "value")


def _joined_records(lines: DataFrame) -> DataFrame:
    """Lines put together to records; ``_opened`` says that a line goes on with one."""
    inside = Window.partitionBy("_f", "_b").orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)
    own = lines.withColumn("_rec", F.last(F.when(~F.col("_opened"), F.col("_r")), ignorenulls=True).over(inside))
    # a record within its split; the lines before a split's first record belong to an earlier split
    pieces = cut_lineage(own.groupBy("_f", "_b", "_rec").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "value"))), lambda x: x["value"]), "\n").alias("value"),
        F.first("_head").alias("_head")))
    last = Window.partitionBy("_f").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    heads = pieces.where("_rec is null")
    # the record that such lines go on with: the last one of the splits before
    tails = pieces.where("_rec is not null").groupBy("_f", "_b").agg(F.max("_rec").alias("_r"))
    border = tails.select("_f", "_b", F.struct("_b", "_r").alias("owner")).join(
        heads.select("_f", "_b", F.lit(True).alias("goes_on")), ["_f", "_b"], "full_outer")
    border = border.withColumn("to", F.last("owner", ignorenulls=True).over(last)).where("goes_on").select("_f", "_b", "to")
    more = heads.join(border, ["_f", "_b"]).groupBy("_f", F.col("to._b").alias("_b"), F.col("to._r").alias("_r")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_b", "value"))), lambda x: x["value"]), "\n").alias("more"))
    whole = pieces.where("_rec is not null").withColumnRenamed("_rec", "_r").join(more, ["_f", "_b", "_r"], "left")
    return whole.withColumn("value", F.concat_ws("\n", "value", "more")).drop("more")
