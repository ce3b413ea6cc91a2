"""Text segmenters (S3-S5): one feedback row per line, paragraph or cleaned
sentence of a ``(doc_id, text)`` table.

Each document is split with array higher-order functions inside its own row
(split -> transform -> filter), then ``posexplode`` numbers the pieces; ids
therefore need no window and no shuffle, however large one document is.
Only S5 combines pages of one document, through a per-page count table
and a distributed prefix sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions.indexing import with_sum_before
from murmur.session import cut_lineage
from murmur.functions.text import PY_LINE_BREAK_REGEX, PY_WS_CLASS, py_strip

# --- fixed values --------------------------------------------------------------
# a paragraph break: a line break, then whitespace-only lines, then a line break
PARAGRAPH_BREAK_REGEX = f"(?:\\r\\n|\\n|\\r){PY_WS_CLASS}*(?:\\r\\n|\\n|\\r)"
# leading bullet characters and the whitespace after them
BULLET_REGEX = f"^[•●▪◦‣\\-–—]+{PY_WS_CLASS}*"
# leading numbering such as "1." or "2)"
NUMBERING_REGEX = f"^\\p{{Nd}}+[.)]{PY_WS_CLASS}*"
# sentence boundary: whitespace after . ! or ? and before a capital A-Z
SENTENCE_BREAK_REGEX = f"(?<=[.!?]){PY_WS_CLASS}+(?=[A-Z])"
MIN_LINE_CHARS = 8
TEXT_SOURCE = "text_file"
PARAGRAPH_SOURCE = "docx"
PAGE_SOURCE_PREFIX = "pdf_page_"
# --------------------------------------------------------------------------------


def _ingest(ingest_ts) -> Column:
    if ingest_ts is None:
        return F.current_timestamp()
    if isinstance(ingest_ts, Column):
        return ingest_ts
    return F.lit(str(ingest_ts)).cast("timestamp")


def _explode_pieces(docs: DataFrame, doc_col: str, pieces: Column, source, ingest_ts) -> DataFrame:
    src = source if isinstance(source, Column) else F.lit(source)
    out = docs.select(F.col(doc_col).alias("doc_id"), src.alias("source"),
                      F.posexplode(pieces).alias("_i", "text"))
    return out.select("doc_id", (F.col("_i") + 1).cast("string").alias("id"), "text", "source",
                      _ingest(ingest_ts).alias("date"))


def _stripped_nonblank(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda x: py_strip(x)), lambda x: x != "")


# --- S3 ----------------------------------------------------------------------------
def text_lines_feedback(docs: DataFrame, text_col: str = "text", doc_col: str = "doc_id",
                        source=TEXT_SOURCE, ingest_ts=None) -> DataFrame:
    """Every non-blank line (Python ``splitlines`` boundaries), stripped;
    ids 1..n per document after blank lines are dropped."""
    pieces = _stripped_nonblank(F.split(F.col(text_col), PY_LINE_BREAK_REGEX))
    return _explode_pieces(docs, doc_col, pieces, source, ingest_ts)


# --- S4 ----------------------------------------------------------------------------
def paragraph_feedback(docs: DataFrame, text_col: str = "text", doc_col: str = "doc_id",
                       source=PARAGRAPH_SOURCE, ingest_ts=None, break_regex: str = PARAGRAPH_BREAK_REGEX) -> DataFrame:
    """Every non-blank paragraph (blank-line separated), stripped; ids 1..n
    per document."""
    pieces = _stripped_nonblank(F.split(F.col(text_col), break_regex))
    return _explode_pieces(docs, doc_col, pieces, source, ingest_ts)


# --- S5 ----------------------------------------------------------------------------
def clean_page_lines(text: Column) -> Column:
    """Cleaned sentences of one page, in order (array<string>)."""
    norm = F.regexp_replace(F.regexp_replace(text, "\\r\\n", "\n"), "\\r", "\n")
    lines = F.transform(F.split(norm, "\n"), lambda x: py_strip(x))
    lines = F.filter(lines, lambda x: (x != "") & (F.length(x) >= MIN_LINE_CHARS))
    lines = F.transform(lines, lambda x: py_strip(F.regexp_replace(
        py_strip(F.regexp_replace(x, BULLET_REGEX, "")), NUMBERING_REGEX, "")))
    lines = F.filter(lines, lambda x: x != "")
    sentences = F.flatten(F.transform(lines, lambda x: F.split(x, SENTENCE_BREAK_REGEX)))
    return F.filter(F.transform(sentences, lambda x: py_strip(x)), lambda x: F.length(x) >= MIN_LINE_CHARS)


def page_line_feedback(pages: DataFrame, text_col: str = "text", doc_col: str = "doc_id",
                       page_col: str = "page_no", ingest_ts=None) -> DataFrame:
    """Extracted page text -> cleaned sentences. Ids run across the pages of
    a document in (page, line, sentence) order; source ``pdf_page_<n>``."""
    per_page = pages.select(F.col(doc_col).alias("doc_id"), F.col(page_col).alias("page_no"),
                            clean_page_lines(F.col(text_col)).alias("_s"))
    # cleaned once: the counts and the output both read it
    per_page = cut_lineage(per_page.withColumn("_n", F.size("_s")))
    # offsets from a one-row-per-page count table: a distributed prefix sum
    # over (doc, page), minus the doc's own start, so a document with very
    # many pages never lands in one task
    counts = with_sum_before(per_page.select("doc_id", "page_no", "_n"), "_n", ["doc_id", "page_no"], "_before")
    starts = counts.groupBy("doc_id").agg(F.min("_before").alias("_start"))
    offsets = counts.join(starts, "doc_id").select("doc_id", "page_no", (F.col("_before") - F.col("_start")).alias("_off"))
    joined = per_page.join(offsets, ["doc_id", "page_no"])
    out = joined.select("doc_id", "page_no", "_off", F.posexplode("_s").alias("_i", "text"))
    return out.select(
        "doc_id",
        (F.col("_off") + F.col("_i") + 1).cast("string").alias("id"),
        "text",
        F.concat(F.lit(PAGE_SOURCE_PREFIX), F.col("page_no").cast("string")).alias("source"),
        _ingest(ingest_ts).alias("date"),
    )
