"""Similarity and density clustering on cosine distance.

C1 ``cosine_eps_join``    all pairs within cosine distance ``eps`` (exact).
C2 ``connected_components`` iterative large-star / small-star on DataFrames.
C3 ``dbscan_cosine``      density clustering (core / border / noise).
C4 ``number_clusters``    labels 0..k-1 in order of each cluster's first core row.

Exact neighbour search compares rows inside *metric cells*. Unit vectors within
cosine distance ``eps`` are within the chord ``sqrt(2 eps)``. Every row is at
home in the cell of its nearest pivot (pivots come from a bounded sample). The
points of another cell lie on the other side of the hyperplane half way between
the two pivots, so a row is copied to a later cell only if it is within the
chord of that hyperplane; every pair meets in exactly one cell. Cells are cut in
blocks by a hash of the id, and a *pair of blocks* is one group of at most two
blocks of vectors. Where the cells of a sample would not save comparisons
(``eps`` wide for the data, few rows), all rows are one cell: plain block pairs.

DBSCAN never materialises all neighbour pairs (a dense region of m rows has
m^2 of them). Pass 1 emits, per row and block pair, only a neighbour *count*
(summed into the exact degree). Pass 2 emits, per block pair, a spanning
forest of the core-core neighbour graph (at most one edge per core row) and
the core neighbours of non-core rows (fewer than ``min_samples`` each, by
definition). Global connectivity then runs on that sparse edge set."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.functions.indexing import with_ordinal
from murmur.session import cut_lineage

# the block-pair functions run in Python workers: ship them by value, so the
# workers need no copy of this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# --- block layout --------------------------------------------------------------
TASK_MEMORY_BYTES = 256 << 20   # working memory one block-pair group may use
TILE_ROWS = 512                 # rows of the left block per matrix tile
TILE_COLS = 8192                # rows of the right block per matrix tile
MAX_BLOCKS = 24                 # blocks a cell, and so copies of a row, while they fit the memory
RECHECK_PAIRS = 16_384          # pairs compared in float64 at a time


def block_rows_for(dim: int, task_memory_bytes: int = TASK_MEMORY_BYTES) -> int:
    """Rows per block so that one group (two blocks shipped as float32, read as
    arrays, their float64 unit copies and float32 copies) and one similarity
    tile fit the budget."""
    per_row = 2 * (dim * (4 + 4 + 8 + 4) + 160)
    tile = (4 + 2 + 16) * TILE_ROWS * TILE_COLS
    return int(min(131072, max(1024, (task_memory_bytes - tile) // per_row)))


def shipped_rows(rows: int, n: int, dim: int) -> int:
    """Rows per block when ``n`` rows are shipped in blocks of ``rows`` or more:
    every row is shipped once per block, so their number is held at
    ``MAX_BLOCKS`` as long as a block fits the memory, and what is shuffled
    grows with the rows, not with their square."""
    return max(rows, min(math.ceil(n / MAX_BLOCKS), block_rows_for(dim)))


SAMPLE_ROWS = 16_384            # rows the pivots and the estimate come from
CELL_COUNTS = (16, 64, 256, 1024)


def _units(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def _near_cells(u: np.ndarray, pivots: np.ndarray, eps: float):
    """Home cell of every unit vector, and (row, cell) of the later cells whose
    border it is within the chord of. Zero vectors have no neighbours."""
    sim = u @ pivots.T
    home = sim.argmax(axis=1)
    gap = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))
    # signed distance to the half-way hyperplane of home and other pivot
    far = (sim[np.arange(len(u)), home][:, None] - sim) / np.maximum(gap[home], 1e-12)
    near = (far <= math.sqrt(2 * eps) + 1e-6) & (np.arange(len(pivots))[None, :] > home[:, None]) & u.any(axis=1)[:, None]
    row, cell = np.nonzero(near)
    return home, row, cell


def _pivots(sample: np.ndarray, k: int) -> np.ndarray:
    """Unit pivots: some rows, moved to the middle of their cells three times."""
    rng = np.random.default_rng(k)
    at = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(3):
        home = (sample @ at.T).argmax(axis=1)
        total = np.zeros_like(at)
        np.add.at(total, home, sample)
        moved = _units(total)
        at = np.where(moved.any(axis=1, keepdims=True), moved, at)
    return at


def _work(homes: np.ndarray, halos: np.ndarray, rows: int) -> tuple[float, float]:
    """(pairs compared, rows shipped) of cells with such numbers of rows."""
    nb, nx = np.maximum(1, np.ceil(homes / rows)), np.ceil(halos / rows)
    return float((homes * (homes / 2 + halos)).sum()), float((homes * (nb + nx) + halos * nb).sum())


def choose_pivots(sample: np.ndarray, n: int, eps: float, rows: int, cells: int | None = None):
    """The pivots that compare fewest pairs, estimated on a sample of unit
    vectors; None where plain blocks are as good. ``cells`` fixes their number
    (0: blocks)."""
    if cells == 0 or eps >= 1 or not len(sample) or (cells is None and n <= rows):
        return None
    scale, best, chosen = n / len(sample), sum(w * c for w, c in zip(_work(np.array([n]), np.array([0]), rows), (0.7, 2000))), None
    for k in CELL_COUNTS if cells is None else (min(cells, len(sample)),):
        if cells is None and k * 16 > len(sample):
            break
        pivots = _pivots(sample, k)
        home, _, cell = _near_cells(sample, pivots, eps)
        pairs, shipped = _work(np.bincount(home, minlength=k) * scale, np.bincount(cell, minlength=k) * scale, rows)
        if cells is not None or pairs + 2000 * shipped < best:
            best, chosen = pairs + 2000 * shipped, pivots
    return chosen


def _placing(pivots: np.ndarray, eps: float):
    """For mapInArrow: rows with their home cell and the later cells (``_near``)
    they are copied to."""
    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(batch.schema.get_field_index("_v"))
            u = _units(v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1))
            home, row, cell = _near_cells(u, pivots, eps)
            starts = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            near = pa.ListArray.from_arrays(pa.array(starts), pa.array(cell.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int32)), near],
                                             names=[*batch.schema.names, "_cell", "_near"])
    return place


def _sample_units(base: DataFrame) -> np.ndarray:
    """Unit vectors of a bounded sample of ``base`` (``_id``, ``_v``)."""
    taken = base.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_ROWS).select("_v").collect()
    return _units(np.array([r["_v"] for r in taken], dtype=np.float64).reshape(len(taken), -1))


def place_in_cells(base: DataFrame, pivots: np.ndarray, eps: float) -> DataFrame:
    """``base`` with ``_cell`` and ``_near``, stored."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema.fields)
    return cut_lineage(base.mapInArrow(_placing(pivots, eps), f"{kinds}, _cell int, _near array<int>"))


def _layout(df: DataFrame, id_col: str, vec_col: str, eps: float, block_rows: int | None, materialize: bool = False,
            group_col: str | None = None, cells: int | None = None):
    """Rows with their cell and block, the blocks of that cell, and their blocks
    in other cells (``_halos``). ``block_rows=None`` sizes blocks from the vector
    dimension. With ``materialize`` the projection is checkpointed first, so
    the counts and every later pass read it instead of re-running the upstream
    plan. With ``group_col`` every group is a cell of its own and cells never mix
    groups. Returns the frame and the grouping keys of a block pair."""
    cols = [F.col(id_col).cast("long").alias("_id"), F.col(vec_col).cast("array<float>").alias("_v")]
    if group_col:
        cols.append(F.col(group_col).alias("_g"))
    if "_w" in df.columns:
        cols.append(F.col("_w"))
    base = df.select(*cols)
    if materialize:
        base = cut_lineage(base)
    stats = base.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_v")).alias("d")).first()
    dim = stats["d"] or 1
    rows = shipped_rows(block_rows or block_rows_for(dim), stats["n"], dim)
    keys = (["_g"] if group_col else []) + ["_cell", "_lo", "_hi"]
    no_halos = F.array().cast("array<struct<cell:int,nb:int,blk:int>>")
    hashed = F.xxhash64("_id")
    if group_col:
        # one row per group; AQE broadcasts it when small, else a skew-split join
        sizes = base.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")).select(
            "_g", F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(rows))).cast("int").alias("_nb"))
        base = base.join(sizes, "_g").withColumns({"_cell": F.lit(0), "_nx": F.lit(0), "_halos": no_halos})
        return base.withColumn("_blk", F.pmod(hashed, F.col("_nb")).cast("int")), keys
    pivots = None
    if cells is not None or stats["n"] > rows:
        pivots = choose_pivots(_sample_units(base), stats["n"], eps, rows, cells)
    if pivots is None:
        nb = max(1, math.ceil(stats["n"] / rows))
        return base.withColumns({"_cell": F.lit(0), "_nb": F.lit(nb), "_nx": F.lit(0), "_halos": no_halos,
                                 "_blk": F.pmod(hashed, F.lit(nb)).cast("int")}), keys

    placed = place_in_cells(base, pivots, eps)
    # at most as many rows as there are pivots
    homes = {r["_cell"]: r["n"] for r in placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    halos = {r["c"]: r["n"] for r in placed.select(F.explode("_near").alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    nb = F.array(*[F.lit(max(1, math.ceil(homes.get(c, 0) / rows))) for c in range(len(pivots))])
    nx = F.array(*[F.lit(math.ceil(halos.get(c, 0) / rows)) for c in range(len(pivots))])
    copies = F.transform("_near", lambda c: F.struct(
        c.alias("cell"), F.get(nb, c).alias("nb"), (F.get(nb, c) + F.pmod(hashed, F.get(nx, c)).cast("int")).alias("blk")))
    return placed.withColumns({"_nb": F.get(nb, F.col("_cell")), "_nx": F.get(nx, F.col("_cell")), "_halos": copies}).withColumn(
        "_blk", F.pmod(hashed, F.col("_nb")).cast("int")).drop("_near"), keys


def _replicate(prepared: DataFrame) -> DataFrame:
    """Each row to every block pair that it takes part in: at home with all
    blocks of its cell, as a copy with the home blocks of the other cell."""
    def task(cell, lo, hi, blk):
        return F.struct(cell.alias("cell"), lo.alias("lo"), hi.alias("hi"), blk.alias("blk"))

    cell, blk, nb, nx = F.col("_cell"), F.col("_blk"), F.col("_nb"), F.col("_nx")
    home = F.transform(F.sequence(F.lit(0), nb - 1), lambda k: task(cell, F.least(blk, k), F.greatest(blk, k), blk))
    others = F.transform(F.sequence(nb, nb + nx - 1), lambda x: task(cell, blk, x, blk))
    away = F.flatten(F.transform("_halos", lambda h: F.transform(
        F.sequence(F.lit(0), h["nb"] - 1), lambda a: task(h["cell"], a, h["blk"], h["blk"]))))
    tasks = F.concat(home, F.when(nx > 0, others).otherwise(F.slice(home, 1, 0)), away)
    return prepared.withColumn("_t", F.explode(tasks)).withColumns({
        "_cell": F.col("_t.cell"), "_lo": F.col("_t.lo"), "_hi": F.col("_t.hi"), "_blk": F.col("_t.blk")}).drop(
        "_t", "_halos", "_nb", "_nx")


def _unit_matrix(vectors) -> np.ndarray:
    if len(vectors) == 0:
        return np.zeros((0, 0))
    return _units(np.stack([np.asarray(v, dtype=np.float64) for v in vectors]))


def _split_pair(pdf: pd.DataFrame):
    """Rows of the lower and the upper block of a block pair (same rows when
    both blocks are one), each sorted by id."""
    lo = int(pdf["_lo"].iloc[0])
    hi = int(pdf["_hi"].iloc[0])
    a = pdf[pdf["_blk"] == lo].sort_values("_id")
    b = a if lo == hi else pdf[pdf["_blk"] == hi].sort_values("_id")
    return a, b, lo == hi


def _f32_margin(dim: int) -> float:
    """Safe bound on the float32 error of a unit-vector dot product."""
    return max(1e-4, 4.0 * dim * float(np.finfo(np.float32).eps))


def _exact_pairs(ua: np.ndarray, ub: np.ndarray, near: np.ndarray, start: int, left: int, eps: float):
    """``(i, j, dist)`` of the marked pairs of a tile that are within eps in
    float64, RECHECK_PAIRS at a time."""
    i, j = np.nonzero(near)
    for k in range(0, len(i), RECHECK_PAIRS):
        a, b = i[k:k + RECHECK_PAIRS] + start, j[k:k + RECHECK_PAIRS] + left
        dist = 1.0 - np.einsum("ij,ij->i", ua[a], ub[b])
        ok = dist <= eps
        yield a[ok], b[ok], dist[ok]


def _neighbour_tiles(ua: np.ndarray, ub: np.ndarray, eps: float, same: bool, exact: bool = False):
    """Yield ``(i, j, dist)`` index arrays of all pairs with cosine distance
    <= eps, tile by tile. A float32 product decides pairs that are clear of
    the threshold by more than its error (``dist`` is None there); only the
    pairs inside the error band are re-checked in float64, a bounded number
    at a time, so memory does not grow with the density. ``exact`` re-checks
    all and always gives distances. With ``same`` only i < j is yielded."""
    if ua.size == 0 or ub.size == 0:
        return
    ceiling = (1.0 - eps) + _f32_margin(ua.shape[1])
    a32, b32 = ua.astype(np.float32), ub.astype(np.float32)
    floor = (1.0 - eps) - _f32_margin(ua.shape[1])
    for start in range(0, len(ua), TILE_ROWS):
        rows = a32[start:start + TILE_ROWS]
        # with ``same``, tiles left of the diagonal hold no i < j
        for left in range(start if same else 0, len(ub), TILE_COLS):
            sim = rows @ b32[left:left + TILE_COLS].T
            near = sim >= floor
            if same and left == start:
                near &= np.triu(np.ones(near.shape, dtype=bool), 1)
            if exact:
                yield from _exact_pairs(ua, ub, near, start, left, eps)
                continue
            # clear of the threshold by more than the float32 error: no re-check
            sure = near & (sim >= ceiling)
            i, j = np.nonzero(sure)
            if len(i):
                yield i + start, j + left, None
            yield from _exact_pairs(ua, ub, near & ~sure, start, left, eps)


def _self_neighbour(u: np.ndarray, eps: float) -> np.ndarray:
    """Whether each row is within eps of itself (false only for zero vectors)."""
    return (1.0 - np.einsum("ij,ij->i", u, u)) <= eps


# --- C1 --------------------------------------------------------------------------
_PAIR_SCHEMA = "src long, dst long, distance double"


def cosine_eps_join(df: DataFrame, id_col: str, vec_col: str, eps: float = 0.35,
                    block_rows: int | None = None, input_materialized: bool = False,
                    cells: int | None = None) -> DataFrame:
    """All pairs (src < dst) whose cosine distance ``1 - cos`` is <= eps.
    The output is as large as the answer; clustering does not call this. Pairs
    leave their task in batches, so dense data needs no more memory.
    The (id, vector) projection is checkpointed unless ``input_materialized``
    (a stored table or a checkpoint), so vectors are computed once. ``cells``
    fixes the number of metric cells (0: plain blocks)."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pdf = pa.Table.from_batches(list(batches)).to_pandas()
        a, b, same = _split_pair(pdf)
        ua, ub = _unit_matrix(a["_v"].tolist()), _unit_matrix(b["_v"].tolist())
        ida, idb = a["_id"].to_numpy(), b["_id"].to_numpy()
        for i, j, d in _neighbour_tiles(ua, ub, eps, same, exact=True):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(ida[i], idb[j])), pa.array(np.maximum(ida[i], idb[j])), pa.array(d)],
                names=["src", "dst", "distance"])

    prepared, keys = _layout(df, id_col, vec_col, eps, block_rows, materialize=not input_materialized, cells=cells)
    return _replicate(prepared).groupBy(*keys).applyInArrow(pairs, _PAIR_SCHEMA)


# --- C2 --------------------------------------------------------------------------
def _orient(edges: DataFrame) -> DataFrame:
    """(child, parent) with parent < child, no self loops, no duplicates."""
    return (
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .where(F.col("u") != F.col("v"))
        .distinct()
    )


def _large_star(e: DataFrame) -> DataFrame:
    # every node links its larger neighbours to the smallest of its closed neighbourhood
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _orient(both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(e: DataFrame) -> DataFrame:
    # every node links itself and its smaller neighbours to the smallest of them
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _orient(moved.unionByName(low.select("u", F.col("m").alias("v"))))


def _is_star_forest(e: DataFrame) -> bool:
    """Converged when every child has one parent and no parent is a child
    (one job: either kind of violation makes the union non-empty)."""
    two_parents = e.groupBy("u").count().where(F.col("count") > 1).select("u")
    parent_is_child = e.join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u")
    return two_parents.unionByName(parent_is_child).isEmpty()


def connected_components(vertices: DataFrame | None, edges: DataFrame, id_col: str = "id", src: str = "src",
                         dst: str = "dst") -> DataFrame:
    """``(id, component)`` where component is the smallest id in the
    component. Alternating large-star / small-star rounds (O(log^2 n) rounds),
    with a reliable checkpoint each round to cut lineage. ``vertices=None``
    means the nodes of ``edges``."""
    e = cut_lineage(_orient(edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v"))))
    if vertices is None:
        ids = e.select("u").unionByName(e.select(F.col("v").alias("u"))).distinct()
    else:
        ids = vertices.select(F.col(id_col).cast("long").alias("u")).distinct()
    while not _is_star_forest(e):   # every round merges until the structure is reached
        e = cut_lineage(_small_star(_large_star(e)))
    return ids.join(e, "u", "left").select(
        F.col("u").alias(id_col), F.coalesce(F.col("v"), F.col("u")).alias("component"))


# --- C3 / C4 -----------------------------------------------------------------------
class _Forest:
    """Union-find over n local nodes, fed edge arrays tile by tile; roots are
    the smallest index of each component."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def add(self, ii: np.ndarray, jj: np.ndarray) -> None:
        parent = self.parent
        while len(ii):
            ri, rj = parent[ii], parent[jj]
            diff = ri != rj
            if not diff.any():
                break
            ii, jj = ii[diff], jj[diff]
            np.minimum.at(parent, np.maximum(ri[diff], rj[diff]), np.minimum(ri[diff], rj[diff]))
            while True:
                nxt = parent[parent]
                if np.array_equal(nxt, parent):
                    break
                parent = nxt
        self.parent = parent

    def edges(self):
        """(child, root) for every non-root node: a spanning forest."""
        child = np.nonzero(self.parent != np.arange(len(self.parent)))[0]
        return child, self.parent[child]


def _pair_vectors(pdf: pd.DataFrame):
    a, b, same = _split_pair(pdf)
    ua = _unit_matrix(a["_v"].tolist())
    ub = ua if same else _unit_matrix(b["_v"].tolist())
    return a, b, same, ua, ub


def _degree_fn(eps: float):
    """Pass 1: per class of equal vectors, the number of neighbouring rows in
    the other block of the pair (both directions; the class's own rows are
    counted in the diagonal pair)."""
    def degrees(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, same, ua, ub = _pair_vectors(pdf)
        wa, wb = a["_w"].to_numpy(), b["_w"].to_numpy()
        ca, cb = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        for i, j, _ in _neighbour_tiles(ua, ub, eps, same):
            ca += np.bincount(i, weights=wb[j], minlength=len(a)).astype(np.int64)
            cb += np.bincount(j, weights=wa[i], minlength=len(b)).astype(np.int64)
        if same:
            cnt, ids = ca + cb + _self_neighbour(ua, eps) * wa, a["_id"].to_numpy()
        else:
            cnt = np.concatenate([ca, cb])
            ids = np.concatenate([a["_id"].to_numpy(), b["_id"].to_numpy()])
        keep = cnt > 0
        return pd.DataFrame({"_id": ids[keep], "cnt": cnt[keep]})
    return degrees


_LINK_SCHEMA = "kind int, a long, b long"   # kind 0: core-core forest edge, 1: non-core -> core


def _links_frame(parts) -> pd.DataFrame:
    if not parts:
        return pd.DataFrame({"kind": pd.Series([], dtype="int32"), "a": pd.Series([], dtype="int64"),
                             "b": pd.Series([], dtype="int64")})
    return pd.concat(parts, ignore_index=True).astype({"kind": "int32", "a": "int64", "b": "int64"})


def _link_fn(eps: float, all_core: bool):
    """Pass 2: a spanning forest of core-core neighbour edges in this block
    pair, plus each non-core row's core neighbours (fewer than min_samples).
    ``all_core``: every row with a neighbour is core (min_samples <= 2)."""
    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, same, ua, ub = _pair_vectors(pdf)
        ida, idb = a["_id"].to_numpy(), b["_id"].to_numpy()
        if all_core:
            core_a = np.ones(len(a), dtype=bool)
        else:
            core_a = a["_core"].to_numpy().astype(bool)
        core_b = core_a if same else (np.ones(len(b), dtype=bool) if all_core else b["_core"].to_numpy().astype(bool))
        # local node numbering: rows of a, then rows of b (when distinct)
        off = 0 if same else len(a)
        forest = _Forest(len(a) if same else len(a) + len(b))
        parts = []
        for i, j, _ in _neighbour_tiles(ua, ub, eps, same):
            cc = core_a[i] & core_b[j]
            forest.add(i[cc], j[cc] + off)
            if not all_core:
                nb = ~core_a[i] & core_b[j]
                if nb.any():
                    parts.append(pd.DataFrame({"kind": 1, "a": ida[i[nb]], "b": idb[j[nb]]}))
                bn = core_a[i] & ~core_b[j]
                if bn.any():
                    parts.append(pd.DataFrame({"kind": 1, "a": idb[j[bn]], "b": ida[i[bn]]}))
        node_ids = ida if same else np.concatenate([ida, idb])
        child, root = forest.edges()
        if len(child):
            parts.append(pd.DataFrame({"kind": 0, "a": node_ids[child], "b": node_ids[root]}))
        return _links_frame(parts)
    return links


def number_clusters(assign: DataFrame, id_col: str = "id", label_col: str = "component",
                    out_col: str = "cluster", groups: DataFrame | None = None) -> DataFrame:
    """Renumber component labels to 0..k-1 in label order (labels are the
    smallest core position of each cluster, so this is first-core order).
    With ``groups`` (``id, _g``: the group of each id) numbering restarts in
    every group: a distributed ordinal over (group, label) minus the group's
    first ordinal."""
    labels = assign.select(label_col).distinct()
    if groups is None:
        numbered = with_ordinal(labels, "_num", [label_col], start=0)
    else:
        labels = labels.join(groups.select(F.col(id_col).alias(label_col), "_g"), label_col)
        ordered = with_ordinal(labels, "_o", ["_g", label_col], start=0)
        first = ordered.groupBy("_g").agg(F.min("_o").alias("_o0"))
        numbered = ordered.join(first, "_g").select(label_col, (F.col("_o") - F.col("_o0")).alias("_num"))
    return assign.join(numbered, label_col).select(id_col, F.col("_num").cast("int").alias(out_col))


def dbscan_cosine(df: DataFrame, pos_col: str = "pos", vec_col: str = "embedding", eps: float = 0.35,
                  min_samples: int = 2, block_rows: int | None = None, out_col: str = "cluster",
                  core_col: str | None = None, group_col: str | None = None,
                  input_materialized: bool = False, cells: int | None = None) -> DataFrame:
    """Adds ``cluster`` (int, -1 = noise). A point counts itself as a
    neighbour; core = at least ``min_samples`` neighbours within ``eps``;
    clusters are connected cores; a non-core point within eps of a core is a
    border point of the lowest-numbered such cluster; clusters are numbered
    in order of their first core point by ``pos_col``. ``core_col`` adds
    the core flag. With ``group_col`` every group (dataset) is clustered on
    its own, all groups in the same jobs; ``pos_col`` must be unique overall
    and cluster numbers restart in each group. ``input_materialized`` says
    ``df`` is already checkpointed, so its vectors are not copied again.
    ``cells`` fixes the number of metric cells (0: plain blocks)."""
    base = df.select(F.col(pos_col).cast("long").alias("_id"), F.col(vec_col).cast("array<float>").alias("_v"),
                     *([F.col(group_col).alias("_g")] if group_col else []))
    if not input_materialized:
        base = cut_lineage(base)
    rows = base.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_id").alias("ids")).first()
    if rows["n"] != rows["ids"]:
        raise ValueError(f"{pos_col} must be unique and not null: {rows['n']} rows, {rows['ids']} values")
    # equal vectors are one class of weight _w, known by its first row: they
    # are neighbours of the same rows and core together, so only classes are
    # compared, however often a vector repeats
    same_vec = ["_v"] + (["_g"] if group_col else [])
    classes = cut_lineage(base.groupBy(*same_vec).agg(F.min("_id").alias("_id"), F.count(F.lit(1)).alias("_w")))
    prepared, keys = _layout(classes, "_id", "_v", eps, block_rows, group_col="_g" if group_col else None, cells=cells)
    ids = prepared.select("_id")
    # with min_samples <= 2 and eps < 1 any neighbour pair makes both rows
    # core, so one pass suffices; zero vectors have no neighbours
    fast = min_samples <= 2 and eps < 1.0

    if fast:
        # one pass; components checkpoints the edges and, for min_samples 2,
        # takes the cores as the nodes of those edges
        edges = _replicate(prepared).groupBy(*keys).applyInPandas(
            _link_fn(eps, all_core=True), _LINK_SCHEMA).where("kind = 0")
        if min_samples <= 0:
            cores = ids.select(F.col("_id").alias("id"))
        elif min_samples == 1:
            # only a zero vector is not its own neighbour
            nonzero = F.exists("_v", lambda x: x != 0)
            cores = prepared.where(nonzero).select(F.col("_id").alias("id"))
        else:
            edges = cut_lineage(edges)
            nonzero = F.exists("_v", lambda x: x != 0)
            cores = (prepared.where(nonzero & (F.col("_w") > 1)).select(F.col("_id").alias("id"))
                     .unionByName(edges.select(F.col("a").alias("id")))
                     .unionByName(edges.select(F.col("b").alias("id"))).distinct())
    else:
        # pass 1: exact degree (including self)
        partial = _replicate(prepared).groupBy(*keys).applyInPandas(
            _degree_fn(eps), "_id long, cnt long")
        degree = partial.groupBy("_id").agg(F.sum("cnt").alias("degree"))
        flagged = prepared.join(degree, "_id", "left").withColumn(
            "_core", F.coalesce(F.col("degree"), F.lit(0)) >= F.lit(min_samples)).drop("degree")
        flagged = cut_lineage(flagged)
        # pass 2: sparse links
        links = _replicate(flagged).groupBy(*keys).applyInPandas(
            _link_fn(eps, all_core=False), _LINK_SCHEMA)
        links = cut_lineage(links)
        edges = links.where("kind = 0")
        cores = flagged.where("_core").select(F.col("_id").alias("id"))

    comp = connected_components(cores, edges, id_col="id", src="a", dst="b")
    assigned = comp
    if not fast:
        border = (
            links.where("kind = 1")
            .join(comp.withColumnRenamed("id", "b"), "b")
            .groupBy(F.col("a").alias("id")).agg(F.min("component").alias("component"))
        )
        assigned = comp.unionByName(border)
    groups = prepared.select(F.col("_id").alias("id"), "_g") if group_col else None
    numbered = number_clusters(assigned, id_col="id", label_col="component", out_col=out_col, groups=groups)
    labels = ids.join(numbered.withColumnRenamed("id", "_id"), "_id", "left").select(
        F.col("_id").alias("_class"), F.coalesce(F.col(out_col), F.lit(-1)).alias(out_col))
    if core_col:
        flags = cores.select(F.col("id").alias("_class"), F.lit(True).alias(core_col))
        labels = labels.join(flags, "_class", "left").withColumn(core_col, F.coalesce(F.col(core_col), F.lit(False)))
    # rows back to their class; a vector that many rows share is a skewed key
    # of this join, which AQE splits
    hashed = F.xxhash64(*same_vec)
    of_class = classes.select(F.col("_id").alias("_class"), "_v", *same_vec[1:]).withColumn("_h", hashed)
    member = base.withColumn("_h", hashed).join(of_class, ["_h", *same_vec]).select(
        F.col("_id").alias("_pos_key"), "_class")
    labels = member.join(labels, "_class").drop("_class")
    return df.join(labels, F.col(pos_col).cast("long") == F.col("_pos_key"), "left").drop("_pos_key")
