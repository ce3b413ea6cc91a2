"""Numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def np_round(c: Column | str, digits: int = 3) -> Column:
    """numpy-style rounding (round half to even on the scaled value):
    ``rint(x * 10^d) / 10^d``. Spark's ``round`` rounds half up."""
    c = F.col(c) if isinstance(c, str) else c
    scale = float(10 ** digits)
    return F.rint(c * F.lit(scale)) / F.lit(scale)


def whole_days_between(first: Column, last: Column) -> Column:
    """Whole elapsed days, floored (a timedelta's ``.days``), not calendar days."""
    micros = F.unix_micros(last) - F.unix_micros(first)
    return F.floor(micros / F.lit(86_400_000_000)).cast("int")
