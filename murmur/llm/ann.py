"""Approximate nearest neighbours by a forest of random-projection trees.

Trees are fitted on a bounded sample (``sample_rows``): each node splits its
sample at the median of the projection on the line through two of its points.
Every row of the table is then put into one leaf of every tree. A query
descends all trees through one shared priority queue, ordered by how far it
lies on the wrong side of the splits on its way, until ``search_share`` of all
leaves that hold rows are reached and one tree's hold k rows of other ids; the
rows of these leaves are ranked by exact distance.

Leaves are read in groups of neighbours, large groups cut by a hash of the
id, so no task's size depends on how many rows share a leaf. Of the ids with one
and the same vector only the k + 1 smallest can be among any k nearest; the
others are not put into leaves, which loses nothing.

Recall against brute force: tests/llm and README; about 0.99 on the given
tables.

Input cases: vectors that are null, zero or hold null or non-finite
components, and rows with a null id, take no part; shorter vectors are filled
with zeros; a row is no candidate of a query with its id; where there are fewer
than k candidates all are returned; ties go to the smaller id; rows that repeat
an id with other vectors are rows of that id, queries too; an empty table gives no
rows; further input columns are ignored."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm._common import by_value, parts
from murmur.llm._vectors import best, matrix, padded, usable_vectors
from murmur.session import cut_lineage

by_value(__name__)

K = 10
TREES = 8
SAMPLE_ROWS = 16_384
LEAF_SAMPLE = 32        # sample points a leaf
SEARCH_SHARE = 0.2      # of all leaves of the forest
GROUP_LEAVES = 16
GROUP_ROWS = 8_192
SEED = 7


class Forest:
    """Complete binary trees of one depth: per inner node a unit direction
    and a threshold."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        inner, dim = (1 << depth) - 1, sample.shape[1]
        self.depth, self.inner = depth, inner
        self.direction, self.threshold = np.zeros((trees, inner, dim)), np.zeros((trees, inner))
        for t in range(trees):
            rows = {0: np.arange(len(sample))}
            for node in range(inner):
                own = rows.pop(node)
                d = np.zeros(dim)
                if len(own) > 1:
                    i, j = rng.choice(own, 2, replace=False)
                    d = sample[i] - sample[j]
                if not d.any():
                    d = rng.standard_normal(dim)
                d = d / np.linalg.norm(d)
                p = sample[own] @ d
                cut = float(np.median(p)) if len(own) else 0.0
                self.direction[t, node], self.threshold[t, node] = d, cut
                rows[2 * node + 1], rows[2 * node + 2] = own[p <= cut], own[p > cut]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row in every tree."""
        out = np.zeros((len(x), len(self.direction)), dtype=np.int32)
        for t in range(len(self.direction)):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", x, self.direction[t][node]) > self.threshold[t][node]
                node = 2 * node + 1 + side
            out[:, t] = node - self.inner
        return out

    def search(self, q: np.ndarray, most: int, sizes: np.ndarray | None = None, rows: int = 0) -> list[tuple[int, int]]:
        """The first ``most`` (tree, leaf) of one queue over all trees, and on
        until a tree's leaves hold ``rows`` rows. ``sizes`` are the rows of every
        leaf; leaves without any are passed over."""
        margin = [(self.direction[t] @ q - self.threshold[t]).tolist() for t in range(len(self.direction))]
        queue = [(0.0, t, 0) for t in range(len(margin))]
        out: list[tuple[int, int]] = []
        held = [0] * len(margin)
        while queue and (len(out) < most or max(held) < rows):
            far, t, node = heapq.heappop(queue)
            if node >= self.inner:
                leaf = node - self.inner
                if sizes is None or sizes[t][leaf]:
                    out.append((t, leaf))
                    held[t] += int(sizes[t][leaf]) if sizes is not None else 0
            else:
                m = margin[t][node]
                heapq.heappush(queue, (max(far, m), t, 2 * node + 1))
                heapq.heappush(queue, (max(far, -m), t, 2 * node + 2))
        return out


def _tile_best(q, qid, v, vid, k: int):
    """(query number, row number, distance) of the k nearest of some rows,
    by differences in double precision."""
    out = [[], [], []]
    step = max(1, (1 << 21) // max(1, v.size))
    for i in range(0, len(q), step):
        d = np.sqrt(((q[i:i + step, None, :] - v[None, :, :]) ** 2).sum(axis=2))
        d[qid[i:i + step, None] == vid[None, :]] = np.inf
        if d.shape[1] > k:
            near = d <= np.partition(d, k - 1, axis=1)[:, k - 1:k]
        else:
            near = np.ones(d.shape, dtype=bool)
        a, b = np.nonzero(near & np.isfinite(d))
        out[0].append(a + i)
        out[1].append(b)
        out[2].append(d[a, b])
    return [np.concatenate(x) for x in out]


def nearest_neighbours(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding",
                       k: int = K, trees: int = TREES, sample_rows: int = SAMPLE_ROWS,
                       leaf_sample: int = LEAF_SAMPLE, search_share: float = SEARCH_SHARE,
                       group_rows: int = GROUP_ROWS, seed: int = SEED) -> DataFrame:
    """(query_id, rank, id, score): the k nearest found of every row for which
    ``is_query`` (over column ``id``) holds; score is the Euclidean distance."""
    rows = usable_vectors(vectors, id_col, vec_col).where(F.exists("vec", lambda x: x != 0))
    dim = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    rows = rows.withColumn("vec", padded(F.col("vec"), dim, 0.0))
    # at most sample_rows vectors
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).collect()
    if not sample:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), "id", F.lit(0.0).alias("score"))
    points = np.array([r["vec"] for r in sample], dtype=np.float64).reshape(len(sample), dim)
    depth = max(1, int(math.log2(max(2.0, len(points) / leaf_sample))))
    forest = Forest(points, trees, depth, seed)

    def put(batches):
        for batch in batches:
            for some in parts(batch, 2048):
                leaf = forest.leaves(matrix(some.column("vec"), dim))
                yield pa.RecordBatch.from_arrays(
                    [some.column("id"), some.column("vec"), pa.array(list(leaf), pa.list_(pa.int32()))],
                    names=["id", "vec", "leaf"])

    def route(batches):
        for batch in batches:
            for some in parts(batch, 256):
                got = [forest.search(q, most, sizes, enough) for q in matrix(some.column("vec"), dim)]
                at = np.repeat(np.arange(len(got)), [len(g) for g in got])
                flat = np.array([x for g in got for x in g], dtype=np.int32).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [some.column("id").take(pa.array(at)), some.column("vec").take(pa.array(at)),
                     pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["id", "vec", "tree", "leaf"])

    copy = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    # stored once: leaf sizes, ids and the search read it
    distinct = cut_lineage(rows.distinct().withColumn("copy", copy).where(F.col("copy") <= k + 1).select("id", "vec"))
    index = distinct.mapInArrow(put, "id long, vec array<double>, leaf array<int>").select(
        "id", "vec", F.posexplode("leaf").alias("tree", "leaf"))
    # at most trees * 2^depth rows
    sizes = np.zeros((trees, 1 << depth), dtype=np.int64)
    for r in index.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r["tree"], r["leaf"]] = r["n"]
    # k rows and those with the query's own id
    enough = k + (distinct.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0)
    most = max(1, math.ceil(search_share * int((sizes > 0).sum())))
    asked = rows.where(is_query).distinct().mapInArrow(route, "id long, vec array<double>, tree int, leaf int")
    group = F.floor(F.col("leaf") / F.lit(GROUP_LEAVES)).cast("int")
    held = np.add.reduceat(sizes, np.arange(0, 1 << depth, GROUP_LEAVES), axis=1)
    cuts = {(t, g): math.ceil(int(held[t, g]) / group_rows) or 1 for t, g in np.ndindex(held.shape)}
    groups = math.ceil((1 << depth) / GROUP_LEAVES)
    table = F.array(*[F.lit(cuts.get((t, g), 1)) for t in range(trees) for g in range(groups)])

    def placed(df: DataFrame, ask: bool) -> DataFrame:
        n = F.get(table, F.col("tree") * F.lit(groups) + F.col("grp"))
        part = F.explode(F.sequence(F.lit(0), n - 1)) if ask else F.pmod(F.xxhash64("id"), n).cast("int")
        return df.withColumn("grp", group).select(
            F.lit(ask).alias("query"), "tree", "grp", part.alias("part"), "leaf", "id", "vec")

    def rank(table: pa.Table) -> pa.Table:
        asks, leaf = table.column("query").to_numpy(), table.column("leaf").to_numpy()
        ids, vec = table.column("id").to_numpy(), matrix(table.column("vec"), dim)
        found = [[np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0)]]
        order = np.argsort(leaf, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1):
            a, c = own[asks[own]], own[~asks[own]]
            if len(a) and len(c):
                at, got, far = _tile_best(vec[a], ids[a], vec[c], ids[c], k)
                for f, x in zip(found, (ids[a][at], ids[c][got], far)):
                    f.append(x)
        q, i, s = (np.concatenate(f) for f in found)
        keep = best(q, s, i, k, largest=False)
        return pa.table([pa.array(q[keep], pa.int64()), pa.array(i[keep], pa.int64()), pa.array(s[keep])],
                        names=["query_id", "id", "score"])

    found = placed(index, False).unionByName(placed(asked, True)).groupBy("tree", "grp", "part").applyInArrow(
        rank, "query_id long, id long, score double").distinct()
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return found.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
