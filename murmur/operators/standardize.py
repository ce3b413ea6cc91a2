"""Standardisation to the feedback schema ``pos, id, text, source, date``
(P1-P9).

Column choices (P1-P6) are decided on the driver from the schema alone -- no
job runs -- except P3 (one aggregate over the string columns). Row work is
one narrow projection plus a filter. ``pos`` is the row's position in the
input before blank rows are dropped; generated ids are ``pos + 1``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.functions.indexing import with_file_order_index, with_sum_before
from murmur.functions.text import py_strip
from murmur.session import cut_lineage

# --- fixed values: accepted column names, in priority order -------------------
TEXT_CANDIDATES = ("text", "feedback", "comment", "comments", "review", "reviews", "message",
                   "content", "description", "transcript", "note", "notes")
ID_CANDIDATES = ("id", "feedback_id", "review_id", "ticket_id")
SOURCE_CANDIDATES = ("source", "channel", "type", "feedback_source")
DATE_CANDIDATES = ("date", "timestamp", "created_at", "created", "datetime")
# formats tried in order, per row, after the ISO forms
DATE_FORMATS = ("yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy/MM/dd")
MONTH_FIRST_FORMATS = ("MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm", "MM/dd/yyyy")
DAY_FIRST_FORMATS = ("dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy")
ISO_SHAPE = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([T ].*)?$"
NULL_TEXTS = ("", "nan")
REQUIRED_COLUMNS = ("id", "text", "source", "date")
UNKNOWN_SOURCE = "unknown"
NO_SOURCE = "uploaded_file"
# ------------------------------------------------------------------------------

ORDER_COL = "_order"   # optional struct column set by the file readers: input order


# --- P1 ----------------------------------------------------------------------------
def normalize_headers(df: DataFrame) -> DataFrame:
    """Strip and lower-case every column name; colliding names are an error."""
    names = [c if c == ORDER_COL else str(c).strip().lower() for c in df.columns]
    dup = sorted({n for n in names if names.count(n) > 1})
    if dup:
        raise ValueError(f"column names collide after normalising: {dup}")
    return df.toDF(*names)


def _first_present(df: DataFrame, candidates) -> str | None:
    return next((c for c in candidates if c in df.columns), None)


# --- P2 / P3 -------------------------------------------------------------------------
def longest_text_column(df: DataFrame) -> str:
    """String column with the greatest mean length (a missing value counts as
    3 characters, like the text ``nan``); the first column wins ties."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != ORDER_COL]
    if not cols:
        raise ValueError("no string column to take the texts from")
    means = df.agg(*[F.avg(F.coalesce(F.length(F.col(f"`{c}`")), F.lit(3))).alias(f"m{i}")
                     for i, c in enumerate(cols)]).first()
    best, best_val = None, None
    for i, c in enumerate(cols):
        v = means[f"m{i}"]
        if v is not None and (best_val is None or v > best_val):
            best, best_val = c, v
    return best or cols[0]


def resolve_text_column(df: DataFrame) -> str:
    return _first_present(df, TEXT_CANDIDATES) or longest_text_column(df)


# --- P4 ------------------------------------------------------------------------------
FILE_POS = "_fpos"   # position inside the input file (per-file mode)
FILE_COL = "_file"   # input file path (per-file mode)


def position_in_splits(df: DataFrame, per_file: bool = False) -> DataFrame:
    """``pos`` from a reader's (file, split start, row id[, element]) key. The
    rows are read once and checkpointed; counts and numbers both come from
    that copy, so no row depends on two scans being split alike. Splits get
    their offsets by a distributed prefix sum over the split table (one row a
    split) and a join on (file, split); rows are numbered inside their split
    (bounded by its size). ``per_file`` adds the position inside each file
    and the file path."""
    elements = "i" in df.schema[ORDER_COL].dataType.fieldNames()
    key = {f"_{x}": F.col(f"{ORDER_COL}.{x}") for x in (("f", "b", "r", "i") if elements else ("f", "b", "r"))}
    rows = cut_lineage(df.withColumns(key).drop(ORDER_COL))
    splits = rows.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_r").alias("_r0"))
    table = with_sum_before(splits, "_n", ["_f", "_b"], "_pre")
    if per_file:
        first = table.groupBy("_f").agg(F.min("_pre").alias("_fpre"))
        table = table.join(first, "_f")
    out = rows.join(table, ["_f", "_b"])
    if elements:
        inside = F.row_number().over(Window.partitionBy("_f", "_b").orderBy("_r", "_i")) - 1
    else:
        inside = F.col("_r") - F.col("_r0")
    out = out.withColumn("pos", F.col("_pre") + inside)
    if per_file:
        out = out.withColumns({FILE_POS: F.col("pos") - F.col("_fpre"), FILE_COL: F.col("_f")}).drop("_fpre")
    return out.drop(*key, "_n", "_r0", "_pre")


def with_input_position(df: DataFrame, per_file: bool = False) -> DataFrame:
    """Adds ``pos``: 0-based input order, from the reader's order key when
    present, else from the current partition order. ``per_file`` adds the
    position inside each input file and the path."""
    if ORDER_COL in df.columns:
        return position_in_splits(df, per_file)
    if per_file:
        raise ValueError("positions per file need the order key of a file reader")
    return with_file_order_index(df, "pos", start=0)


def assign_ids(df: DataFrame, id_col: str | None = None) -> Column:
    """Id column as string: the first present candidate, else the input
    position + 1 -- inside each file in per-file mode (assigned before blank
    rows are dropped, so gaps are possible). An empty id cell gets the
    position too, so ids are never null."""
    id_col = id_col or _first_present(df, ID_CANDIDATES)
    position = (F.col(FILE_POS if FILE_POS in df.columns else "pos") + 1).cast("string")
    if id_col:
        return F.coalesce(F.col(f"`{id_col}`").cast("string"), position)
    return position


# --- P5 ------------------------------------------------------------------------------
def resolve_source(df: DataFrame, source_col: str | None = None) -> Column:
    source_col = source_col or _first_present(df, SOURCE_CANDIDATES)
    if source_col:
        return F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(UNKNOWN_SOURCE))
    return F.lit(NO_SOURCE)


# --- P6 ------------------------------------------------------------------------------
def _epoch(c: Column, unit: str) -> Column:
    """Integer time since 1970 in s, ms, us or ns (floored to microseconds)."""
    wide = c.cast("decimal(38,0)")
    micros = {"s": wide * 1_000_000, "ms": wide * 1_000, "us": wide,
              "ns": F.floor(wide / F.lit(1000))}[unit]
    return F.timestamp_micros(micros.cast("long"))


def parse_date(c: Column, dtype: T.DataType, formats=DATE_FORMATS, epoch_unit: str = "ns",
               day_first: bool = False) -> Column:
    """Timestamp, or null where no rule fits. Text: whole numbers are epochs
    in ``epoch_unit``; ISO dates and times with or without fraction, ``Z`` or
    offset; then ``formats`` in order. ``dd/MM`` and ``MM/dd`` are told apart
    by ``day_first``; the other reading is tried where the first is no date."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return c.cast("timestamp")
    if isinstance(dtype, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return _epoch(c, epoch_unit)
    s = py_strip(c.cast("string"))
    slashed = DAY_FIRST_FORMATS + MONTH_FIRST_FORMATS if day_first else MONTH_FIRST_FORMATS + DAY_FIRST_FORMATS
    number = F.when(s.rlike(r"^[+-]?[0-9]{1,19}$"), s).cast("decimal(38,0)")
    tries = [_epoch(number, epoch_unit),
             F.when(s.rlike(ISO_SHAPE), F.try_to_timestamp(s))]
    tries += [F.try_to_timestamp(s, F.lit(fmt)) for fmt in (*formats, *slashed)]
    return F.coalesce(*tries)


def parsed_date(df: DataFrame, date_col: str | None = None, formats=DATE_FORMATS, epoch_unit: str = "ns",
                day_first: bool = False) -> Column:
    """The date column parsed; null where it is missing or no rule fits."""
    date_col = date_col or _first_present(df, DATE_CANDIDATES)
    if not date_col:
        return F.lit(None).cast("timestamp")
    return parse_date(F.col(f"`{date_col}`"), df.schema[date_col].dataType, formats, epoch_unit, day_first)


def resolve_date(df: DataFrame, ingest_ts: Column, date_col: str | None = None, formats=DATE_FORMATS,
                 epoch_unit: str = "ns", day_first: bool = False) -> Column:
    """Parsed date; unparseable or missing values, and a missing column, get
    ``ingest_ts`` (one value per run)."""
    return F.coalesce(parsed_date(df, date_col, formats, epoch_unit, day_first), ingest_ts)


# --- P7 ------------------------------------------------------------------------------
def clean_text(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Strip (Python whitespace), drop null, empty and ``nan`` texts."""
    t = py_strip(F.col(text_col).cast("string"))
    return df.withColumn(text_col, t).where(F.col(text_col).isNotNull() & ~F.col(text_col).isin(*NULL_TEXTS))


# --- P8 ------------------------------------------------------------------------------
def _ingest_literal(ingest_ts) -> Column:
    if ingest_ts is None:
        return F.current_timestamp()
    if isinstance(ingest_ts, Column):
        return ingest_ts
    return F.lit(str(ingest_ts)).cast("timestamp")


def standardize_feedback(df: DataFrame, ingest_ts=None, date_formats=DATE_FORMATS, epoch_unit: str = "ns",
                         text_col: str | None = None, dataset_col: str | None = None,
                         day_first: bool = False, date_flag_col: str | None = None,
                         pos_col: str | None = None) -> DataFrame:
    """P1..P7 composed: ``pos, id, text, source, date``. With ``dataset_col``
    every input file is its own dataset (an upload): the column holds the
    file path and generated ids restart at 1 in each file; ``pos`` stays
    unique over all files. ``date_flag_col`` adds whether the date was parsed
    (false: it is the ingest time). ``pos_col`` names a column that already
    holds unique input positions; then nothing is copied to number rows.
    Only the columns that are used are carried through the numbering."""
    if not df.columns or df.isEmpty():
        raise ValueError("There are no rows in the input.")
    df = normalize_headers(df)
    text_col = text_col or resolve_text_column(df)
    picked = [_first_present(df, c) for c in (ID_CANDIDATES, SOURCE_CANDIDATES, DATE_CANDIDATES)]
    used = dict.fromkeys([text_col, *[c for c in picked if c], *([ORDER_COL] if ORDER_COL in df.columns else []),
                          *([pos_col] if pos_col else [])])
    df = df.select(*[F.col(f"`{c}`") for c in used])
    if pos_col:
        df = df.withColumn("pos", F.col(f"`{pos_col}`").cast("long"))
    else:
        df = with_input_position(df, per_file=dataset_col is not None)
    ts = _ingest_literal(ingest_ts)
    date = parsed_date(df, formats=date_formats, epoch_unit=epoch_unit, day_first=day_first)
    out = df.select(
        *([F.col(FILE_COL).alias(dataset_col)] if dataset_col else []),
        "pos",
        assign_ids(df).alias("id"),
        F.col(f"`{text_col}`").alias("text"),
        resolve_source(df).alias("source"),
        F.coalesce(date, ts).alias("date"),
        *([date.isNotNull().alias(date_flag_col)] if date_flag_col else []),
    )
    return clean_text(out)


# --- P9 ------------------------------------------------------------------------------
def validate_feedback(df: DataFrame) -> DataFrame:
    """Raise on missing required columns (listed sorted) or zero rows."""
    missing = sorted(set(REQUIRED_COLUMNS) - set(df.columns))
    if missing:
        raise ValueError(f"columns missing: {missing}")
    if df.isEmpty():
        raise ValueError("the table has no rows")
    return df


def feedback_violations(df: DataFrame) -> DataFrame:
    """DataFrame form of P9: one row per violated rule (``rule, detail``);
    empty when the table is valid. The row check is one aggregate."""
    spark = df.sparkSession
    missing = sorted(set(REQUIRED_COLUMNS) - set(df.columns))
    schema = "rule string, detail string"
    rows = [("missing_columns", ", ".join(missing))] if missing else []
    missing_df = spark.createDataFrame(rows, schema)
    empty = df.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(
        F.lit("no_rows").alias("rule"), F.lit("the table has no rows").alias("detail"))
    return missing_df.unionByName(empty)
