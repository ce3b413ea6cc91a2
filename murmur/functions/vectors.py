"""Vector expressions over ``array<float|double>`` columns, JVM-side
(higher-order functions; no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def as_double(v) -> Column:
    return _c(v).cast("array<double>")


def dot(u, v) -> Column:
    prods = F.zip_with(as_double(u), as_double(v), lambda x, y: x * y)
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def l2_norm(v) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0).cast("double"), lambda acc, x: acc + x * x))


def l2_normalize(v) -> Column:
    """Unit-norm vector in double; a zero vector stays zero."""
    vd = as_double(v)
    n = l2_norm(vd)
    return F.when(n > 0, F.transform(vd, lambda x: x / n)).otherwise(vd)


def cosine(u, v) -> Column:
    """Cosine similarity; 0 when either vector is zero."""
    nu, nv = l2_norm(u), l2_norm(v)
    return F.when((nu > 0) & (nv > 0), dot(u, v) / (nu * nv)).otherwise(F.lit(0.0))
