"""Density clustering over batches of uploads (C3 kept up to date).

Labels after any number of batches equal those of one run of ``dbscan_cosine``
over all rows. The state is two tables: the *classes* of equal vectors, each
with its rows (weight), neighbouring rows (degree), component if it is core,
and otherwise its core neighbours (fewer than ``min_samples``); and the *rows*
with their class. A batch compares only what it changes: first the classes
that gained rows with all classes (degrees), then the new classes and those
that became core with all classes (links). Stored classes are never compared
with each other; stored components join the new links as one edge a core class.
A batch of b classes on n stored ones compares b * n pairs, fewer in cells."""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.operators.cluster import (_Forest, _LINK_SCHEMA, _links_frame, _neighbour_tiles, _sample_units, _unit_matrix,
                                      block_rows_for, choose_pivots, connected_components, number_clusters, place_in_cells,
                                      shipped_rows)
from murmur.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class ClusterState:
    """``rows``: (pos, class). ``classes``: (id, v, w, degree, component, near);
    ``id`` is the class's first row, ``component`` its smallest core class (null:
    not core), ``near`` the core neighbours of a class that is not core."""
    rows: DataFrame
    classes: DataFrame


# --- comparing some classes with all ---------------------------------------------
def _against(classes: DataFrame, probe: Column, eps: float, block_rows: int | None, cells: int | None, fn, schema: str):
    """``fn`` over groups of a block of the ``probe`` classes (``_side`` 0) and a
    block of all classes (``_side`` 1) of a cell; see ``_meetings``."""
    base = classes.withColumn("_probe", probe)
    stats = base.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_v")).alias("d")).first()
    dim = stats["d"] or 1
    rows = shipped_rows(block_rows or block_rows_for(dim), stats["n"], dim)
    pivots = None
    if cells is not None or stats["n"] > rows:
        pivots = choose_pivots(_sample_units(base), stats["n"], eps, rows, cells)
    if pivots is None:
        placed = base.withColumns({"_cell": F.lit(0), "_near": F.array().cast("array<int>")})
    else:
        placed = place_in_cells(base, pivots, eps)
    copies = placed.withColumn("_at", F.explode(F.concat(
        F.array(F.struct(F.col("_cell").alias("cell"), F.lit(True).alias("home"))),
        F.transform("_near", lambda c: F.struct(c.alias("cell"), F.lit(False).alias("home")))))).withColumns(
        {"_cell": F.col("_at.cell"), "_home": F.col("_at.home")}).drop("_at", "_near")
    # at most one row a pivot
    sizes = {r["_cell"]: r for r in copies.groupBy("_cell").agg(
        F.count(F.lit(1)).alias("a"), F.count_if("_probe").alias("f")).collect()}
    cells_n = len(pivots) if pivots is not None else 1
    blocks = {k: F.get(F.array(*[F.lit(math.ceil(sizes[c][k] / rows) if c in sizes else 0) for c in range(cells_n)]),
                       F.col("_cell")) for k in "af"}
    hashed = F.xxhash64("_id")
    met = copies.withColumns({"_nf": blocks["f"], "_na": blocks["a"]}).where("_nf > 0")
    own_f, own_a = F.pmod(hashed, F.col("_nf")).cast("int"), F.pmod(hashed, F.col("_na")).cast("int")

    def task(f, a, side):
        return F.struct(f.alias("f"), a.alias("a"), F.lit(side).alias("side"))

    as_any = F.transform(F.sequence(F.lit(0), F.col("_nf") - 1), lambda k: task(k, own_a, 1))
    as_probe = F.transform(F.sequence(F.lit(0), F.col("_na") - 1), lambda k: task(own_f, k, 0))
    tasks = met.withColumn("_t", F.explode(F.concat(
        as_any, F.when(F.col("_probe"), as_probe).otherwise(F.slice(as_probe, 1, 0))))).withColumns(
        {"_f": F.col("_t.f"), "_a": F.col("_t.a"), "_side": F.col("_t.side")}).drop("_t", "_nf", "_na")
    return tasks.groupBy("_cell", "_f", "_a").applyInPandas(fn, schema)


def _meetings(pdf: pd.DataFrame, eps: float):
    """The two sides of a group and an iterator of their neighbour pairs (i, j):
    every pair with a probe class in it meets once over all groups."""
    f, a = (pdf[pdf["_side"] == s].sort_values("_id") for s in (0, 1))
    idf, ida = f["_id"].to_numpy(), a["_id"].to_numpy()
    home_f, home_a = f["_home"].to_numpy(bool), a["_home"].to_numpy(bool)
    probe_a = a["_probe"].to_numpy(bool)

    def pairs():
        for i, j, _ in _neighbour_tiles(_unit_matrix(f["_v"].tolist()), _unit_matrix(a["_v"].tolist()), eps, False):
            ok = (home_f[i] | home_a[j]) & (~probe_a[j] | (idf[i] < ida[j]))
            yield i[ok], j[ok]
    return f, a, pairs()


def _gain_fn(eps: float):
    """Rows that each class's neighbourhood gained: all rows of its neighbours
    if the class is new, else their new ones."""
    def gains(pdf: pd.DataFrame) -> pd.DataFrame:
        f, a, pairs = _meetings(pdf, eps)
        (wf, df, nf), (wa, da, na) = ((x["_w"].to_numpy(), x["_dw"].to_numpy(), x["_new"].to_numpy(bool)) for x in (f, a))
        gf, ga = np.zeros(len(f), dtype=np.int64), np.zeros(len(a), dtype=np.int64)
        for i, j in pairs:
            np.add.at(gf, i, np.where(nf[i], wa[j], da[j]))
            np.add.at(ga, j, np.where(na[j], wf[i], df[i]))
        ids, cnt = np.concatenate([f["_id"].to_numpy(), a["_id"].to_numpy()]), np.concatenate([gf, ga])
        return pd.DataFrame({"_id": ids[cnt > 0], "cnt": cnt[cnt > 0]})
    return gains


def _touch_fn(eps: float):
    """A forest of the core-core pairs, and (not core, core) pairs."""
    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        f, a, pairs = _meetings(pdf, eps)
        idf, ida = f["_id"].to_numpy(), a["_id"].to_numpy()
        core_f, core_a = f["_core"].to_numpy(bool), a["_core"].to_numpy(bool)
        forest, parts = _Forest(len(f) + len(a)), []
        for i, j in pairs:
            both = core_f[i] & core_a[j]
            forest.add(i[both], j[both] + len(f))
            for one, x, y in ((~core_f[i] & core_a[j], idf[i], ida[j]), (core_f[i] & ~core_a[j], ida[j], idf[i])):
                if one.any():
                    parts.append(pd.DataFrame({"kind": 1, "a": x[one], "b": y[one]}))
        child, root = forest.edges()
        ids = np.concatenate([idf, ida])
        if len(child):
            parts.append(pd.DataFrame({"kind": 0, "a": ids[child], "b": ids[root]}))
        return _links_frame(parts)
    return links


# --- batches -----------------------------------------------------------------------
_CLASSES = "id long, v array<float>, w long, degree long, component long, near array<long>"


def add_batch(state: ClusterState | None, batch: DataFrame, pos_col: str = "pos", vec_col: str = "embedding",
              eps: float = 0.35, min_samples: int = 2, block_rows: int | None = None, cells: int | None = None) -> ClusterState:
    """The state after ``batch`` (``None``: no rows yet), stored. ``eps`` is in
    (0, 1) and must be that of the state, like ``min_samples``. Positions are
    unique and greater than all stored ones, as uploads arrive in order; else a
    ValueError. An empty batch changes nothing."""
    if not 0 < eps < 1:
        raise ValueError("eps must be between 0 and 1")
    spark = batch.sparkSession
    new = cut_lineage(batch.select(F.col(pos_col).cast("long").alias("pos"), F.col(vec_col).cast("array<float>").alias("v")))
    seen = new.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pos").alias("ids"), F.min("pos").alias("first")).first()
    if seen["n"] != seen["ids"]:
        raise ValueError(f"{pos_col} must be unique and not null: {seen['n']} rows, {seen['ids']} values")
    old = state.classes if state else spark.createDataFrame([], _CLASSES)
    if state and seen["n"]:
        last = state.rows.agg(F.max("pos")).first()[0]
        if last is not None and seen["first"] <= last:
            raise ValueError(f"{pos_col} of a batch must be greater than those stored: {seen['first']}, {last}")

    gained = new.groupBy("v").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("dw"))
    classes = cut_lineage(old.join(gained, "v", "full").select(
        F.coalesce("id", "first").alias("_id"), F.col("v").alias("_v"), F.col("id").isNull().alias("_new"),
        (F.coalesce("w", F.lit(0)) + F.coalesce("dw", F.lit(0))).alias("_w"), F.coalesce("dw", F.lit(0)).alias("_dw"),
        F.coalesce("degree", F.lit(0)).alias("degree"), "component", "near"))
    # a row goes to the class of its vector; AQE splits a vector that many share
    members = new.join(classes.where("_dw > 0").select(F.col("_v").alias("v"), F.col("_id").alias("class")), "v").select("pos", "class")

    slim = classes.select("_id", "_v", "_new", "_w", "_dw")
    gains = _against(slim, F.col("_dw") > 0, eps, block_rows, cells, _gain_fn(eps), "_id long, cnt long")
    nonzero = F.exists("_v", lambda x: x != 0)          # a zero vector is not its own neighbour
    flagged = cut_lineage(classes.join(gains.groupBy("_id").agg(F.sum("cnt").alias("cnt")), "_id", "left").withColumn(
        "degree", F.col("degree") + F.coalesce("cnt", F.lit(0)) + F.when(nonzero, F.col("_dw")).otherwise(0)).withColumn(
        "_core", F.col("degree") >= min_samples).drop("cnt"))
    touched = F.col("_new") | (F.col("_core") & F.col("component").isNull())
    links = cut_lineage(_against(flagged.select("_id", "_v", "_core", touched.alias("_touched")), F.col("_touched"),
                                 eps, block_rows, cells, _touch_fn(eps), _LINK_SCHEMA))

    stored = flagged.where("component is not null").select(F.col("_id").alias("a"), F.col("component").alias("b"))
    cores = flagged.where("_core").select(F.col("_id").alias("id"))
    comp = connected_components(cores, links.where("kind = 0").select("a", "b").unionByName(stored), src="a", dst="b")
    # fewer than min_samples a class
    near = links.where("kind = 1").groupBy(F.col("a").alias("id")).agg(F.collect_set("b").alias("_more"))
    none = F.array().cast("array<long>")
    after = flagged.drop("component").withColumnRenamed("_id", "id").join(comp, "id", "left").join(near, "id", "left")
    kept = after.select(
        "id", F.col("_v").alias("v"), F.col("_w").alias("w"), "degree", "component",
        F.when(F.col("_core"), none).otherwise(F.array_union(F.coalesce("near", none), F.coalesce("_more", none))).alias("near"))
    rows = state.rows.unionByName(members) if state else members
    return ClusterState(cut_lineage(rows), cut_lineage(kept))


def batch_labels(state: ClusterState, out_col: str = "cluster") -> DataFrame:
    """(pos, cluster): numbers in order of each cluster's first core row, -1 is
    noise; a border row is in the first of the clusters it touches."""
    core = state.classes.where("component is not null").select("id", "component")
    border = (state.classes.where("component is null").select("id", F.explode("near").alias("b"))
              .join(core.select(F.col("id").alias("b"), "component"), "b")
              .groupBy("id").agg(F.min("component").alias("component")))
    numbered = number_clusters(core.unionByName(border), out_col=out_col).withColumnRenamed("id", "class")
    return state.rows.join(numbered, "class", "left").select("pos", F.coalesce(out_col, F.lit(-1)).alias(out_col))
