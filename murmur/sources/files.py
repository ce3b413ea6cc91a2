"""File sources (S1, S2, S6).

Readers return the raw table (every column a string for CSV, the union of
keys for JSON) plus an ``_order`` key -- (file path, split start, row in
split[, element]) -- so the standardiser can number rows in input order
without moving them through one task."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmur.functions.indexing import with_sum_before
from murmur.functions.text import py_strip
from murmur.operators.standardize import (DATE_CANDIDATES, ID_CANDIDATES, NO_SOURCE, ORDER_COL, SOURCE_CANDIDATES,
                                          TEXT_CANDIDATES, UNKNOWN_SOURCE, standardize_feedback)
from murmur.session import cut_lineage
from murmur.sources.csv_records import csv_files, csv_records
from murmur.sources.json_records import json_records

# --- fixed values: pandas' default missing-value tokens for CSV ------------------
CSV_NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# wrapper keys whose list value holds the records, in priority order
JSON_RECORD_KEYS = ("feedback", "data", "reviews", "records")
SUPPORTED_EXTENSIONS = (".csv", ".json", ".jsonl", ".txt")
# -------------------------------------------------------------------------------


def _order_key(*extra):
    return F.struct(
        F.col("_metadata.file_path").alias("f"),
        F.col("_metadata.file_block_start").alias("b"),
        F.monotonically_increasing_id().alias("r"),
        *extra,
    )


# --- S1 ----------------------------------------------------------------------------
#: A table of files is broadcast up to this size; beyond it, it is joined.
BROADCAST_FILES = 5_000
BROADCAST_CHARS = 1 << 22


def _of_file(rows: DataFrame, files: DataFrame, how: str = "inner") -> DataFrame:
    """Rows with what is known of their file: broadcast while the table is small,
    else joined with the rows of a file dealt out by their split."""
    size = files.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("_f")).alias("c")).first()
    if size["n"] <= BROADCAST_FILES and (size["c"] or 0) <= BROADCAST_CHARS:
        return rows.join(F.broadcast(files), "_f", how)
    salts = 16
    spread = files.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    salt = F.pmod(F.xxhash64(F.col(f"{ORDER_COL}.b")), F.lit(salts))
    return rows.withColumn("_salt", salt).join(spread, ["_f", "_salt"], how).drop("_salt")


def _cells(spark: SparkSession, path, files: DataFrame, null_tokens) -> DataFrame:
    """(_f, _cells, _order): every record's cells, missing-value tokens as NULL.
    Files without line breaks inside fields go through Spark's CSV reader, the
    others through :func:`csv_records`."""
    size = files.agg(F.max(F.size("names")).alias("w"), F.bool_or("broken").alias("some"), F.bool_and("broken").alias("all")).first()
    if size["w"] is None:
        raise ValueError("There are no rows in the input.")
    cells = [f"_c{i}" for i in range(size["w"])]
    schema, tokens = ", ".join(f"{c} string" for c in cells), list(null_tokens)

    def row(df: DataFrame, order, prefix: str = "") -> DataFrame:
        own = [F.col(prefix + c) for c in cells]
        return df.select(F.array(*[F.when(~c.isin(*tokens), c) for c in own]).alias("_cells"), order.alias(ORDER_COL))

    out = []
    if not size["all"]:
        raw = spark.read.option("header", True).option("escape", '"').schema(schema).csv(path)
        # with records of the other kind in the table, rows have a number of their own
        plain = row(raw, _order_key(*([F.lit(0).alias("i")] if size["some"] else []))).withColumn("_f", F.col(f"{ORDER_COL}.f"))
        out.append(_of_file(plain, files.where("broken").select("_f"), "left_anti") if size["some"] else plain)
    if size["some"]:
        records = csv_records(spark, path, files).withColumn("_p", F.from_csv("value", schema, {"escape": '"'}))
        order = F.struct(F.col("_f").alias("f"), F.col("_b").alias("b"), F.col("_r").alias("r"), F.lit(0).alias("i"))
        out.append(row(records, order, "_p.").withColumn("_f", F.col(f"{ORDER_COL}.f")))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def read_csv_feedback(spark: SparkSession, path, null_tokens=CSV_NULL_TOKENS,
                      multi_line: bool | None = None) -> DataFrame:
    """Header row (the first that is not blank), quoted fields, every column a
    string; pandas' missing-value tokens become NULL in every column. ``path`` may
    be a list. Files may have different headers: each row's cells go to the
    columns its own file names, and the result has the union of the columns.
    Files are split across tasks whether or not quoted fields hold line breaks;
    ``multi_line=False`` says that none does."""
    files = csv_files(spark, path, breaks=multi_line is not False)
    rows = _cells(spark, path, files, null_tokens)
    # schema-level metadata: one row per distinct list of names
    names = [list(r["names"]) for r in files.groupBy("names").agg(F.min("header").alias("h")).orderBy("h").collect()]
    columns = list(dict.fromkeys(n for own in names for n in own))
    if len(names) == 1:
        return rows.select(*[F.get("_cells", F.lit(names[0].index(n))).alias(n) for n in columns], ORDER_COL)
    rows = _of_file(rows, files.select("_f", "names"))
    at = lambda n: F.array_position("names", F.lit(n)).cast("int")
    return rows.select(*[F.when(at(n) > 0, F.get("_cells", at(n) - 1)).alias(n) for n in columns], ORDER_COL)


def read_csv_uploads(spark: SparkSession, path, null_tokens=CSV_NULL_TOKENS, multi_line: bool | None = None,
                     per_file: bool = False) -> DataFrame:
    """(text, id, source, date) of CSV files whose headers name them differently:
    P1 to P6 are decided for each header, not for the union of all columns. A
    header without a known text column takes the longest, over all files of
    that header, or over the file itself if ``per_file``. Of names that are
    alike after normalising, the first counts. No header reaches the driver."""
    files = csv_files(spark, path, breaks=multi_line is not False)
    rows = _cells(spark, path, files, null_tokens)
    norm = F.transform("names", lambda n: F.lower(py_strip(n)))
    found = files.withColumn("_norm", norm)

    def first_of(candidates):
        return F.coalesce(*[F.nullif(F.array_position("_norm", F.lit(c)), F.lit(0).cast("long")) for c in candidates]).cast("int")

    found = cut_lineage(found.select("_f", "header", F.size("names").alias("width"), *[
        first_of(c).alias(n) for n, c in (("_text", TEXT_CANDIDATES), ("_id", ID_CANDIDATES), ("_source", SOURCE_CANDIDATES),
                                          ("_date", DATE_CANDIDATES))]))
    known = found.agg(F.max("width").alias("w"), F.bool_or(F.col("_text").isNull()).alias("unknown")).first()
    if known["unknown"]:
        key = "_f" if per_file else "_key"
        unnamed = found.where("_text is null").select("_f", "header", "width", F.xxhash64("header").alias("_key"))
        means = [F.avg(F.when(F.col("width") > i, F.coalesce(F.length(F.get("_cells", F.lit(i))), F.lit(3)))).alias(f"_m{i}")
                 for i in range(known["w"])]
        longest = _of_file(rows, unnamed.drop("header")).groupBy(key).agg(*means)
        mean = F.array(*[F.coalesce(f"_m{i}", F.lit(-1.0)) for i in range(known["w"])])
        longest = longest.select(key, F.array_position(mean, F.array_max(mean)).cast("int").alias("_longest"))
        found = cut_lineage(found.withColumn("_key", F.xxhash64("header")).join(longest, key, "left").withColumn(
            "_text", F.coalesce("_text", "_longest")).drop("_key", "_longest"))
    rows = _of_file(rows, found.drop("header", "width"))
    cell = lambda n: F.when(F.col(n).isNotNull(), F.get("_cells", F.col(n) - 1))
    source = F.when(F.col("_source").isNull(), F.lit(NO_SOURCE)).otherwise(F.coalesce(cell("_source"), F.lit(UNKNOWN_SOURCE)))
    return rows.select(cell("_text").alias("text"), cell("_id").alias("id"), source.alias("source"), cell("_date").alias("date"),
                       ORDER_COL)


# --- S2 ----------------------------------------------------------------------------
def _records(doc):
    """JSON document -> array of records: a top-level list; else the first
    wrapper key holding a list; else an object is one record. Scalars fail."""
    v = F.try_parse_json(doc)
    cands = [F.try_variant_get(v, "$", "array<variant>")]
    cands += [F.try_variant_get(v, f"$.{k}", "array<variant>") for k in JSON_RECORD_KEYS]
    cands.append(F.when(F.try_variant_get(v, "$", "map<string,variant>").isNotNull(), F.array(v)))
    recs = F.coalesce(*cands)
    return F.when(recs.isNull(), F.raise_error(F.lit("a JSON text is neither a list nor an object"))).otherwise(recs)


def read_json_feedback(spark: SparkSession, path, layout: str = "document",
                       columns: list[str] | None = None) -> DataFrame:
    """``layout='document'``: each file is one JSON document (list, wrapper
    object or single object). ``layout='lines'``: each line is such a
    document (JSON Lines is the case of one object per line; splittable, the
    form for large inputs); blank lines are skipped. ``layout='split'``: each
    file is one document that is a list of objects, or an object whose only key
    is a record key with such a list; a file of any size is read by many tasks
    (:mod:`murmur.sources.json_records`). Values are text.

    Columns: the given ``columns``; by default the record keys that the
    standardiser knows, and the key with the longest mean text -- at most that
    many names reach the driver, however many distinct keys there are."""
    if layout == "split":
        records = json_records(spark, path, JSON_RECORD_KEYS)
        order = F.struct(F.col("_f").alias("f"), F.col("_b").alias("b"), F.col("_r").alias("r"), F.lit(0).alias("i"))
        rows = cut_lineage(records.select(order.alias(ORDER_COL), F.try_variant_get(
            F.parse_json("value"), "$", "map<string,variant>").alias("_m")))
        return _named_keys(rows, columns)
    # text()'s own wholetext argument overrides an option of the same name
    docs = spark.read.text(path, wholetext=(layout == "document")).select("value", _order_key().alias("_o"))
    docs = docs.where(F.length(py_strip(F.col("value"))) > 0)
    rows = docs.select("_o", F.posexplode(_records(F.col("value"))).alias("_i", "_rec"))
    rows = rows.select(
        F.struct(F.col("_o.f"), F.col("_o.b"), F.col("_o.r"), F.col("_i").alias("i")).alias(ORDER_COL),
        F.try_variant_get("_rec", "$", "map<string,variant>").alias("_m"),
    )
    # parsed once: key discovery, row numbering and the output all read it
    return _named_keys(cut_lineage(rows), columns)


def _named_keys(rows: DataFrame, columns: list[str] | None) -> DataFrame:
    names = columns or _needed_keys(rows)
    return rows.select(
        *[F.try_variant_get(F.col("_m").getItem(k), "$", "string").alias(k) for k in names],
        ORDER_COL,
    )


def _needed_keys(rows: DataFrame) -> list[str]:
    """Keys whose normalised name is a known column, and the key with the
    longest mean text (a missing value counts as 3 characters), by first
    appearance."""
    known = (*TEXT_CANDIDATES, *ID_CANDIDATES, *SOURCE_CANDIDATES, *DATE_CANDIDATES)
    text = F.try_variant_get("value", "$", "string")
    keys = cut_lineage(
        rows.select(ORDER_COL, F.posexplode("_m").alias("_k", "key", "value"))
        .groupBy("key").agg(F.min(F.struct(ORDER_COL, "_k")).alias("_first"), F.count(text).alias("n"),
                            F.sum(F.length(text)).alias("chars")))
    total = rows.count()
    mean = F.coalesce("chars", F.lit(0)) + 3 * (F.lit(total) - F.col("n"))
    named = keys.where(F.lower(py_strip(F.col("key"))).isin(*known))
    longest = keys.orderBy(mean.desc(), "_first").limit(1)
    found = named.unionByName(longest).dropDuplicates(["key"]).orderBy("_first").select("key")
    return [r["key"] for r in found.collect()]


# --- S3 for files ----------------------------------------------------------------------
# line boundaries of Python's splitlines() beyond the \n, \r\n and \r that
# Spark's line reader already splits on
_EXTRA_LINE_BREAKS = "[\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]"


def read_text_feedback(spark: SparkSession, path: str, ingest_ts=None, dataset_col: str | None = None,
                       layout: str = "lines") -> DataFrame:
    """``.txt`` files: every non-blank line (Python ``splitlines``) is a
    feedback row, stripped; ids 1..n per file after blank lines are dropped;
    ``pos`` in (file, line) order over all files.

    ``layout='lines'`` (default) reads files line by line, so one huge file
    splits across tasks; kept lines are numbered from per-split counts (a
    prefix sum joined on the split) plus a row number inside each split
    (bounded by the split size). ``layout='whole'`` reads each file as one row."""
    from murmur.functions.indexing import with_ordinal
    from murmur.sources.segment import _ingest, _stripped_nonblank, text_lines_feedback

    if layout == "whole":
        docs = spark.read.text(path, wholetext=True).select(
            F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))
        lines = text_lines_feedback(docs, doc_col="doc_id", ingest_ts=ingest_ts)
        lines = with_ordinal(lines.withColumn("_line", F.col("id").cast("long")), "pos",
                             ["doc_id", "_line"]).drop("_line")
        return lines.withColumnRenamed("doc_id", dataset_col) if dataset_col else lines

    raw = spark.read.text(path).select(_order_key().alias("_o"), "value")
    kept = raw.select(F.col("_o.f").alias("_f"), F.col("_o.b").alias("_b"), F.col("_o.r").alias("_r"),
                      F.posexplode(_stripped_nonblank(F.split("value", _EXTRA_LINE_BREAKS))).alias("_k", "text"))
    kept = cut_lineage(kept)
    splits = kept.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"))
    table = with_sum_before(splits, "_n", ["_f", "_b"], "_pre")
    first = table.groupBy("_f").agg(F.min("_pre").alias("_fstart"))
    offsets = table.join(first, "_f").select("_f", "_b", "_pre", (F.col("_pre") - F.col("_fstart")).alias("_fpre"))
    inside = F.row_number().over(Window.partitionBy("_f", "_b").orderBy("_r", "_k"))
    numbered = kept.withColumn("_i", inside).join(offsets, ["_f", "_b"])
    return numbered.select(
        F.col("_f").alias(dataset_col or "doc_id"),
        (F.col("_pre") + F.col("_i") - 1).alias("pos"),
        (F.col("_fpre") + F.col("_i")).cast("string").alias("id"),
        "text",
        F.lit("text_file").alias("source"),
        _ingest(ingest_ts).alias("date"),
    )


# --- S6 ----------------------------------------------------------------------------
def read_feedback(spark: SparkSession, path, format: str | None = None, ingest_ts=None,
                  layout: str | None = None, multi_line: bool | None = None, **options) -> DataFrame:
    """Dispatch on the (lower-cased) extension or an explicit ``format``, then
    standardise. ``path`` may be a list of one format, read as one table; CSV
    files may name their columns differently (:func:`read_csv_uploads`).
    ``layout`` (JSON, text) and ``multi_line`` (CSV) go to the reader. Other
    formats raise ``ValueError``."""
    paths = [path] if isinstance(path, str) else list(path)
    kinds = {(format and "." + format.lower().lstrip(".")) or os.path.splitext(p.rstrip("/"))[1].lower() for p in paths}
    if len(kinds) != 1:
        raise ValueError(f"one format at a time, not {sorted(kinds)}")
    ext = kinds.pop()
    if ext == ".csv":
        if options.get("text_col"):
            raw = read_csv_feedback(spark, paths, multi_line=multi_line)
        else:
            raw = read_csv_uploads(spark, paths, multi_line=multi_line, per_file=options.get("dataset_col") is not None)
    elif ext in (".json", ".jsonl"):
        raw = read_json_feedback(spark, paths, layout=layout or ("lines" if ext == ".jsonl" else "document"))
    elif ext == ".txt":
        return read_text_feedback(spark, paths, ingest_ts=ingest_ts, dataset_col=options.get("dataset_col"),
                                  layout=layout or "lines")
    else:
        raise ValueError(f"no reader for {ext!r}; there are readers for {', '.join(SUPPORTED_EXTENSIONS)}")
    return standardize_feedback(raw, ingest_ts=ingest_ts, **options)
