"""Opt-in approximate form of the cosine join (C1) by hash bands.

Each table draws ``bits`` random hyperplanes; rows on the same sides of all of
them share a bucket. Two rows at angle t share a table's bucket with
probability ``(1 - t / pi) ** bits``, so the number of tables that finds a pair
at the threshold with probability ``recall`` is known, and closer pairs are
found more often. Rows meet inside buckets only, block against block, and every
pair is checked exactly: nothing wrong is returned, a pair is returned once
(by the first table that holds both), and distances equal the exact join's. The
exact way is ``cosine_eps_join``. A hot bucket is many blocks, not one task."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.operators.cluster import (_PAIR_SCHEMA, _neighbour_tiles, _replicate, _split_pair, _unit_matrix, _units,
                                      block_rows_for, cosine_eps_join)
from murmur.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_BITS = 30


def tables_for(eps: float, bits: int, recall: float) -> int:
    """Tables that find a pair at cosine distance ``eps`` with probability
    ``recall``."""
    share = (1.0 - math.acos(1.0 - eps) / math.pi) ** bits
    return max(1, math.ceil(math.log1p(-recall) / math.log1p(-share)))


def _banding(bits: int, tables: int, seed: int):
    """For mapInArrow: rows with their bucket in every table (``_b``)."""
    def band(batches):
        planes = None
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(1)
            u = _units(v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1))
            if planes is None:
                planes = np.random.default_rng(seed).normal(size=(u.shape[1], tables * bits))
            sides = (u @ planes > 0).reshape(len(u), tables, bits)
            codes = (sides * (1 << np.arange(bits))).sum(axis=2).astype(np.int32)
            at = pa.array(np.arange(0, codes.size + 1, tables, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(at, pa.array(codes.ravel()))],
                                             names=["_id", "_v", "_b"])
    return band


def approx_cosine_join(df: DataFrame, id_col: str, vec_col: str, eps: float = 0.35, recall: float = 0.95,
                       bits: int | None = None, block_rows: int | None = None, seed: int = 17) -> DataFrame:
    """Pairs (src < dst, distance) within cosine distance ``eps``, each found with
    probability ``recall`` or more. ``bits`` (default: buckets of about a block of
    rows) trades tables for smaller buckets. Null vectors and zero vectors have
    no neighbours; an empty table has no pairs."""
    if not 0 < eps < 1 or not 0 < recall < 1:
        raise ValueError("eps and recall must be between 0 and 1; use cosine_eps_join for all pairs")
    base = cut_lineage(df.select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).cast("array<float>").alias("_v"))
                       .where(F.exists("_v", lambda x: x != 0)))
    stats = base.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_v")).alias("d")).first()
    rows = block_rows or block_rows_for(stats["d"] or 1)
    bits = bits or min(MAX_BITS, max(4, math.ceil(math.log2(max(1, stats["n"]) / rows)) if stats["n"] else 4))
    tables = tables_for(eps, bits, recall)
    banded = cut_lineage(base.mapInArrow(_banding(bits, tables, seed), "_id long, _v array<float>, _b array<int>"))
    spread = banded.select("*", F.posexplode("_b").alias("_table", "_bucket"))
    sizes = spread.groupBy("_table", "_bucket").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(
        "_table", "_bucket", F.ceil(F.col("_n") / F.lit(rows)).cast("int").alias("_nb"))
    none = F.array().cast("array<struct<cell:int,nb:int,blk:int>>")
    # one row a bucket: AQE broadcasts it if small and splits a hot bucket otherwise
    laid = spread.join(sizes, ["_table", "_bucket"]).withColumns(
        {"_cell": F.lit(0), "_nx": F.lit(0), "_halos": none,
         "_blk": F.pmod(F.xxhash64("_id"), F.col("_nb")).cast("int")})

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pdf = pa.Table.from_batches(list(batches)).to_pandas()
        a, b, same = _split_pair(pdf)
        t = int(pdf["_table"].iloc[0])
        ida, idb = a["_id"].to_numpy(), b["_id"].to_numpy()
        before_a, before_b = (np.array([x[:t] for x in p["_b"]], dtype=np.int32).reshape(len(p), t) for p in (a, b))
        ua, ub = _unit_matrix(a["_v"].tolist()), _unit_matrix(b["_v"].tolist())
        for i, j, d in _neighbour_tiles(ua, ub, eps, same, exact=True):
            first = ~(before_a[i] == before_b[j]).any(axis=1)   # no earlier table holds both
            i, j, d = i[first], j[first], d[first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(ida[i], idb[j])), pa.array(np.maximum(ida[i], idb[j])), pa.array(d)],
                names=["src", "dst", "distance"])

    return _replicate(laid).groupBy("_table", "_bucket", "_cell", "_lo", "_hi").applyInArrow(pairs, _PAIR_SCHEMA)


def join_recall(df: DataFrame, id_col: str, vec_col: str, eps: float = 0.35, recall: float = 0.95, **how) -> DataFrame:
    """One row that holds the approximate join against the exact one:
    ``exact_pairs``, ``wrong_pairs`` (found but not exact), ``repeated_pairs`` and
    ``measured_recall`` (1 where there are no pairs)."""
    exact = cosine_eps_join(df, id_col, vec_col, eps).select("src", "dst", F.lit(1).alias("_e"))
    found = approx_cosine_join(df, id_col, vec_col, eps, recall, **how).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("_f"))
    both = exact.join(found, ["src", "dst"], "full")
    pairs, hits = F.count("_e"), F.count_if(F.col("_e").isNotNull() & F.col("_f").isNotNull())
    return both.agg(pairs.alias("exact_pairs"), F.count_if(F.col("_e").isNull()).alias("wrong_pairs"),
                    F.count_if(F.col("_f") > 1).alias("repeated_pairs"),
                    F.when(pairs == 0, F.lit(1.0)).otherwise(hits / pairs).alias("measured_recall"))
