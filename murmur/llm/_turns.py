"""Conversations as ordered rows: numbering that needs no task per conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions.indexing import with_file_order_index

#: A word: characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def text_hash(*cols, salt: int = 0) -> Column:
    """64-bit hash of some columns; different salts give independent hashes."""
    return F.xxhash64(F.lit(salt), *cols)


def numbered(rows: DataFrame, order: list, keep: list, name: str = "g") -> DataFrame:
    """The columns ``keep`` of ``rows`` with their number in ``order``, stored:
    sorted by ranges, so a long conversation is spread over many tasks."""
    return with_file_order_index(rows.orderBy(*order).select(*keep), name, start=0)
