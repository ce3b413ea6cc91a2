"""Exact top-k inner-product search on an impact-ordered index.

Components are quantised to integers. A block of candidates is indexed by
posting segments: per dimension, the rows whose component lies in one range
of values. As every vector has a component in every dimension, a segment is
stored as a 0/1 column and segments are added up for many queries at once. For
a query, a segment's impact is the most its range can contribute; segments are
processed in bands of descending impact. After a band, a row's score is at
most its processed impacts plus, per open dimension, the highest impact not
yet processed. A row is out once this bound is below the k-th best score known
exactly. A query stops when few rows are left or all segments are processed;
these rows are scored exactly. Nothing else is left out, so the result is
exact.

Candidates are dealt to blocks by a hash of the id, queries to chunks; each
(block, chunk) is a task-sized group. Every query meets every block, as an
exact search by bounds must.

Input cases: vectors that are null or hold null or non-finite components, and
rows with a null id, take no part; shorter vectors are filled with zeros;
rows with equal ids and vectors both count, and none is a candidate of a query
with its id; fewer than k candidates give all; ties go to the smaller id; an
empty table gives no rows; further input columns are ignored."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm._common import by_value
from murmur.llm._vectors import best, matrix, padded, usable_vectors

by_value(__name__)

K = 20
SCALE = 64
BLOCK_ROWS = 8_192
CHUNK_ROWS = 4_096
RANGES = 8            # value ranges a dimension
BANDS = (0.5, 1.0)    # share of the segments processed after each band
FEW = 0.15            # stop once so small a share of a block's rows is left


class ImpactIndex:
    """Posting segments of one block: ``member[row, segment]`` in 0/1, and
    each segment's dimension and lowest and highest value."""

    def __init__(self, values: np.ndarray, ranges: int = RANGES):
        n, dim = values.shape
        self.values, columns, dims, low, high = values, [], [], [], []
        for d in range(dim):
            v = values[:, d]
            edges = np.unique(np.quantile(v, np.arange(1, ranges) / ranges, method="lower"))
            code = np.searchsorted(edges, v, side="left")
            for c in np.unique(code):
                inside = code == c
                columns.append(inside)
                dims.append(d)
                low.append(v[inside].min())
                high.append(v[inside].max())
        self.member = np.stack(columns, axis=1).astype(np.float32)
        self.dims, self.low, self.high = np.array(dims), np.array(low), np.array(high)
        self.first = np.searchsorted(self.dims, np.arange(dim))   # a dimension's first segment

    def possible(self, queries: np.ndarray, floor: np.ndarray, bands=BANDS, few: float = FEW):
        """Per query, the rows whose score may reach its ``floor``."""
        n = len(self.values)
        q = queries[:, self.dims]
        impact = np.maximum(q * self.low, q * self.high)                    # queries x segments
        order = np.argsort(-impact, axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
        rows: list[np.ndarray | None] = [None] * len(queries)
        going = np.arange(len(queries))
        exact32 = np.abs(impact).max(initial=0) * queries.shape[1] < 2 ** 23
        kind = np.float32 if exact32 else np.float64
        member = self.member if exact32 else self.member.astype(np.float64)
        for share in bands:
            done = place[going] < math.ceil(share * impact.shape[1])
            own = impact[going]
            rest = np.where(done, np.iinfo(np.int64).min, own)
            rest = np.maximum.reduceat(rest, self.first, axis=1)             # most an open dimension can add
            rest = np.where(rest == np.iinfo(np.int64).min, 0, rest)
            weight = np.where(done, own - rest[:, self.dims], 0).astype(kind)
            bound = (weight @ member.T).astype(np.float64) + rest.sum(axis=1)[:, None]
            near = bound >= floor[going][:, None]
            left = near.sum(axis=1)
            stop = (left <= few * n) | (share == bands[-1])
            for i in np.flatnonzero(stop):
                rows[going[i]] = np.flatnonzero(near[i])
            going = going[~stop]
            if not len(going):
                break
        return rows


def search_block(query_ids, queries, ids, values, k: int = K, tile: int = 256):
    """(query row, candidate row, score) of the k best of a block per query."""
    index = ImpactIndex(values)
    seed = values[:512]
    found = [[], [], []]
    for i in range(0, len(queries), tile):
        q, qid = queries[i:i + tile], query_ids[i:i + tile]
        first = q @ seed.T
        first = np.where(ids[None, :512] == qid[:, None], np.iinfo(np.int64).min, first)
        # the k-th best of some candidates is at most the k-th best of all
        floor = (np.partition(first, -k, axis=1)[:, -k] if first.shape[1] > k
                 else np.full(len(q), np.iinfo(np.int64).min)).astype(np.float64)
        for j, rows in enumerate(index.possible(q, floor)):
            rows = rows[ids[rows] != qid[j]]
            score = values[rows] @ q[j]
            if len(rows) > 4 * k:
                cut = np.partition(score, -k)[-k]
                rows, score = rows[score >= cut], score[score >= cut]
            keep = np.lexsort((ids[rows], -score))[:k]
            found[0].append(np.full(len(keep), i + j))
            found[1].append(rows[keep])
            found[2].append(score[keep])
    none = [np.zeros(0, dtype=np.int64)]
    return [np.concatenate(f or none) for f in found]


def quantised(vec: Column, scale: int) -> Column:
    return F.transform(vec, lambda x: F.floor(x * F.lit(float(scale))).cast("long"))


def exact_top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding",
                k: int = K, scale: int = SCALE, block_rows: int = BLOCK_ROWS,
                chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(query_id, rank, id, score): the k best candidates of every row for
    which ``is_query`` (over column ``id``) holds."""
    rows = usable_vectors(vectors, id_col, vec_col).select("id", quantised(F.col("vec"), scale).alias("vec"))
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q"), F.max(F.size("vec")).alias("d")).first()
    dim, blocks, chunks = stats["d"] or 0, max(1, math.ceil(stats["n"] / block_rows)), max(1, math.ceil(stats["q"] / chunk_rows))
    rows = rows.withColumn("vec", padded(F.col("vec"), dim, 0))
    spread = F.xxhash64("id")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select(F.lit(False).alias("query"), F.pmod(spread, F.lit(blocks)).cast("int").alias("block"),
                             numbers(chunks).alias("chunk"), "id", "vec")
    queries = rows.where(is_query).select(F.lit(True).alias("query"), numbers(blocks).alias("block"),
                                          F.pmod(spread, F.lit(chunks)).cast("int").alias("chunk"), "id", "vec")

    def search(group: pa.Table) -> pa.Table:
        asks = group.column("query").to_numpy()
        ids, vec = group.column("id").to_numpy(), matrix(group.column("vec"), dim)
        order = np.argsort(ids, kind="stable")
        a, c = order[asks[order]], order[~asks[order]]
        if len(a) and len(c):
            at, got, score = search_block(ids[a], vec[a], ids[c], vec[c], k)
            out = [ids[a][at], ids[c][got], score]
        else:
            out = [np.zeros(0, dtype=np.int64)] * 3
        return pa.table([pa.array(x, pa.int64()) for x in out], names=["query_id", "id", "score"])

    found = candidates.unionByName(queries).groupBy("block", "chunk").applyInArrow(
        search, "query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
