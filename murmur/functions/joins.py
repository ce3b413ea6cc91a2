"""Joins with a table of values by key where a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.session import cut_lineage

#: A lookup table is broadcast whole up to this size; else only its heaviest keys are.
WHOLE_ROWS, WHOLE_CHARS = 500_000, 8 << 20
HEAVY_KEYS = 10_000


def lookup_of(lookup: DataFrame, keys: list[str], values: list[str], weight: str, whole_rows: int = WHOLE_ROWS,
              heavy_keys: int = HEAVY_KEYS) -> Callable[[DataFrame], DataFrame]:
    """A function that joins rows (inner) with ``lookup`` (unique by ``keys``,
    columns ``values`` and ``weight``: how many rows a key has, about), which is
    stored once for all its calls. A small table is broadcast. Of a larger one
    the ``heavy_keys`` heaviest keys are: their rows, mostly most of all, stay
    where they are, and only the rest is shuffled by key, so no key is hot. The
    rows are read twice then."""
    lookup = cut_lineage(lookup.select(*keys, *values, weight))
    size = lookup.agg(F.count(F.lit(1)).alias("n"),
                      F.sum(sum((F.length(F.col(k).cast("string")) for k in keys), F.lit(0))).alias("c")).first()
    if size["n"] <= whole_rows and (size["c"] or 0) <= WHOLE_CHARS:
        return lambda rows: rows.join(F.broadcast(lookup.drop(weight)), keys).select(*rows.columns, *values)
    heavy = F.broadcast(cut_lineage(lookup.orderBy(F.desc(weight), *keys).limit(heavy_keys).drop(weight)))
    light = lookup.drop(weight).join(heavy.select(*keys), keys, "left_anti")

    def find(rows: DataFrame) -> DataFrame:
        rest = rows.join(heavy.select(*keys), keys, "left_anti")
        return rows.join(heavy, keys).select(*rows.columns, *values).unionByName(
            rest.join(light, keys).select(*rows.columns, *values))
    return find


def lookup_join(rows: DataFrame, lookup: DataFrame, keys: list[str], values: list[str], weight: str,
                spread: Column | None = None, whole_rows: int = WHOLE_ROWS, heavy_keys: int = HEAVY_KEYS) -> DataFrame:
    """:func:`lookup_of` for one call. ``spread`` is not needed any more: rows
    of heavy keys are not moved, so they need not be dealt out."""
    return lookup_of(lookup, keys, values, weight, whole_rows, heavy_keys)(rows)
