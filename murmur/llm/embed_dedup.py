"""Embedding near-duplicates by robust-pruned flat graphs on cluster shards.

Vectors are cut into overlapping shards: centroids are fitted on a bounded sample
of a shard, every vector goes to its ``overlap`` nearest, and shards that are
still too large are cut again, level by level. Each shard's vectors get a flat
graph (nearest and some far candidates, robustly pruned, edges both ways); the
adjacency lists that a vector has in its shards are put together. Each shard is
then searched with these lists: a greedy beam search for every vector, starting
from medoids, whose range is expanded over the graph from every vector found
within the threshold. What is found is verified by the cosine in double
precision. A pair that shares several shards counts in the first of them only.

A shard whose vectors are all close to each other cannot be cut by centroids
without losing links. It is dealt out in blocks by a hash, and the vectors of
each block search the graphs of all blocks. Links are counted and merged inside
the task (a spanning forest); pairs are never emitted.

Recall is audited against brute force on a bounded sample of rows; below the
target the vectors are dealt to one more shard each and searched again. Equal
vectors are one class with a weight.

Input cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing and stand for themselves; vectors of different
lengths are compared as if filled with zeros; rows with a null id take part in
links, have no say in the smallest id, and are kept only where nothing with an id
links to them; repeated ids are rows of their own; an empty table gives no rows;
further input columns are ignored."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm._common import by_value, narrow, parts
from murmur.llm._vectors import finite, matrix, padded
from murmur.operators.cluster import connected_components
from murmur.session import cut_lineage

by_value(__name__)

MIN_COSINE = 0.9
SHARD_ROWS = 2048
SAMPLE_ROWS = 4096      # of a shard, for its centroids
BRANCH = 64             # shards a shard is cut into at most, at once
LEVELS = 8
OVERLAP = 2
DEGREE = 16
NEAREST, FAR = 32, 16   # candidates of a vector
ALPHA = 1.2
BEAM = 24
MEDOIDS = 32
AUDIT_ROWS = 512
RECALL = 0.98           # below this the search is widened
SEED = 11


# --- graph of one block ------------------------------------------------------------
def kmeans(x: np.ndarray, k: int, rounds: int = 4, seed: int = SEED) -> np.ndarray:
    """Unit centroids of unit vectors."""
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = (x @ centre.T).argmax(axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(norm > 0, total / np.maximum(norm, 1e-30), centre)
    return centre


def medoids(x: np.ndarray, k: int = MEDOIDS) -> np.ndarray:
    """The rows nearest to some centroids, each once."""
    return np.unique((kmeans(x, k, 2) @ x.T).argmax(axis=1))


def robust_prune(x: np.ndarray, at: np.ndarray, cand: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Out-edges of the rows ``at`` from their candidates (row numbers, -1 for
    none): the nearest stays and rules out those nearer to it, by ``alpha``,
    than to the row; and so on. -1 fills up."""
    own, far = x[at], np.float32(np.inf)
    vec = x[cand]
    dist = np.sqrt(np.maximum(2 - 2 * np.einsum("qcd,qd->qc", vec, own), 0))
    dist[(cand < 0) | (cand == at[:, None])] = far
    out = np.full((len(at), degree), -1, dtype=np.int64)
    rows = np.arange(len(at))
    for d in range(degree):
        best = dist.argmin(axis=1)
        some = np.isfinite(dist[rows, best])
        if not some.any():
            break
        out[some, d] = cand[rows, best][some]
        between = np.sqrt(np.maximum(2 - 2 * np.einsum("qcd,qd->qc", vec, x[cand[rows, best]]), 0))
        dist[(alpha * between <= dist) & some[:, None]] = far
        dist[rows, best] = far
    return out


def build_graph(x: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Directed edges (from, to), every one in both directions."""
    n = len(x)
    rng = np.random.default_rng(seed)
    tails, heads = [], []
    for i in range(0, n, 512):
        at = np.arange(i, min(n, i + 512))
        sim = x[at] @ x.T
        sim[np.arange(len(at)), at] = -2
        near = np.argpartition(-sim, min(NEAREST, n - 1) - 1, axis=1)[:, :NEAREST] if n > 1 else np.zeros((1, 0), dtype=np.int64)
        cand = np.concatenate([near, rng.integers(0, n, (len(at), FAR))], axis=1)
        out = robust_prune(x, at, cand)
        a, b = np.nonzero(out >= 0)
        tails.append(at[a])
        heads.append(out[a, b])
    t, h = np.concatenate(tails), np.concatenate(heads)
    return np.concatenate([t, h]), np.concatenate([h, t])


def lists(n: int, tail: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges as adjacency lists: starts, and heads in order of tail, each once."""
    if len(tail):
        both = np.unique(tail * n + head)
        tail, head = both // n, both % n
    return np.searchsorted(tail, np.arange(n + 1)), head


def _neighbours(start: np.ndarray, head: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number in ``nodes``, neighbour) of some nodes."""
    size = start[nodes + 1] - start[nodes]
    of = np.repeat(np.arange(len(nodes)), size)
    at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start[nodes], size)
    return of, head[at]


def range_search(x: np.ndarray, start: np.ndarray, head: np.ndarray, entry: np.ndarray, q: np.ndarray,
                 least: float, beam: int = BEAM) -> np.ndarray:
    """Whether each row of ``x`` is found within ``least`` of each query: greedy
    beam search from the entries, then breadth first from all in range."""
    asked, n = len(q), len(x)
    beam = min(beam, n)
    sims = np.full((asked, n), -2, dtype=np.float32)      # -2: not seen
    sims[:, entry] = q @ x[entry].T
    done = np.zeros((asked, n), dtype=bool)
    rows = np.arange(asked)

    def look(a: np.ndarray, nodes: np.ndarray):
        """Similarities of the unseen neighbours of (query, node) pairs."""
        for i in range(0, len(nodes), 8192):
            of, to = _neighbours(start, head, nodes[i:i + 8192])
            who = a[i:i + 8192][of]
            new = sims[who, to] == -2
            who, to = who[new], to[new]
            for j in range(0, len(to), 1 << 16):
                w, t = who[j:j + (1 << 16)], to[j:j + (1 << 16)]
                sims[w, t] = np.einsum("ij,ij->i", q[w], x[t])

    active = rows
    while len(active):
        own = sims[active]
        if n > beam:
            top = np.argpartition(-own, beam - 1, axis=1)[:, :beam]
        else:
            top = np.broadcast_to(np.arange(n), (len(active), n))
        s = np.take_along_axis(own, top, axis=1)
        s = np.where(np.take_along_axis(done[active], top, axis=1), -2, s)
        pick = np.argpartition(-s, min(3, s.shape[1] - 1), axis=1)[:, :4]      # up to four nodes at a time
        a, c = np.nonzero(np.take_along_axis(s, pick, axis=1) > -2)
        nodes, who = top[a, pick[a, c]], active[a]
        done[who, nodes] = True
        look(who, nodes)
        active = np.unique(who)
    while True:
        a, nodes = np.nonzero((sims >= least) & ~done)
        if not len(a):
            return sims >= least
        done[a, nodes] = True
        look(a, nodes)


# --- shards ----------------------------------------------------------------------
def _nearest_shards(x: np.ndarray, centre: np.ndarray, most: int) -> np.ndarray:
    s = x @ centre.T
    most = min(most, centre.shape[0])
    return np.argsort(-s, axis=1, kind="stable")[:, :most]


def cut_shards(vectors: DataFrame, dim: int, overlap: int = OVERLAP, shard_rows: int = SHARD_ROWS,
               min_cosine: float = MIN_COSINE) -> DataFrame:
    """(uid, vec, cells): the shards of every vector, as paths of centroid
    numbers. ``vec`` are unit vectors. At every cut a vector goes to the
    ``overlap`` nearest parts of the shard it is nearest to so far, and to one
    part of its others, so its shards grow in number with the levels only."""
    none = F.array().cast("array<string>")
    rows = vectors.select("uid", "vec", F.array(F.lit("")).alias("cells"), F.lit("").alias("main"), F.lit(True).alias("open"))
    for _ in range(LEVELS):
        live = rows.where("open").select("uid", "vec", "main", F.explode("cells").alias("cell"), F.xxhash64("uid").alias("h"))
        sizes = live.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > shard_rows)
        sizes = cut_lineage(sizes)
        if sizes.isEmpty():
            break
        # a sample of every large shard, of bounded expected size: hashes below a share
        share = F.lit(float(SAMPLE_ROWS)) / F.col("size")
        sample = live.join(F.broadcast(sizes) if sizes.count() <= 10_000 else sizes, "cell").where(
            F.pmod("h", F.lit(1 << 20)) < share * F.lit(1 << 20))

        def fit(table: pa.Table) -> pa.Table:
            x = matrix(table.column("vec"), dim)
            size, cell = table.column("size")[0].as_py(), table.column("cell")[0].as_py()
            whole = x.mean(axis=0)
            near = x @ (whole / max(np.linalg.norm(whole), 1e-30))
            # vectors nearer to the middle than the threshold asks for: not cut
            if np.median(near) >= min_cosine:
                return pa.table({"cell": pa.array([], pa.string()), "centre": pa.array([], pa.list_(pa.list_(pa.float64())))})
            k = int(min(BRANCH, max(2, math.ceil(2 * size / shard_rows))))
            return pa.table({"cell": pa.array([cell]), "centre": pa.array([kmeans(x, k).tolist()], pa.list_(pa.list_(pa.float64())))})

        fitted = cut_lineage(sample.groupBy("cell").applyInArrow(fit, "cell string, centre array<array<double>>"))
        if fitted.isEmpty():
            break
        # vectors meet their shard's centroids by (shard, salt): no hot key
        salts = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / F.lit(4 * shard_rows)).cast("long") - 1))
        plans = fitted.join(sizes, "cell").select("cell", "size", "centre", salts.alias("salt"))
        of_cell = fitted.join(sizes, "cell").select("cell", F.ceil(F.col("size") / F.lit(4 * shard_rows)).cast("long").alias("salts"))
        dealt = live.join(F.broadcast(of_cell) if fitted.count() <= 10_000 else of_cell, "cell").withColumn(
            "salt", F.pmod("h", F.col("salts")))

        def route(left: pa.Table, right: pa.Table) -> pa.Table:
            names = ["uid", "cell", "sub"]
            if not left.num_rows or not right.num_rows:
                return pa.table([pa.array([], pa.int64()), pa.array([], pa.string()), pa.array([], pa.list_(pa.string()))], names=names)
            cell = right.column("cell")[0].as_py()
            got = _nearest_shards(matrix(left.column("vec"), dim), np.array(right.column("centre")[0].as_py()), overlap)
            main = left.column("main").to_pylist()
            sub = [[f"{cell}/{c}" for c in (own if m == cell else own[:1])] for own, m in zip(got.tolist(), main)]
            return pa.table([left.column("uid"), left.column("cell"), pa.array(sub, pa.list_(pa.string()))], names=names)

        moved = dealt.select("uid", "cell", "main", "vec", "salt").groupBy("cell", "salt").cogroup(
            plans.groupBy("cell", "salt")).applyInArrow(route, "uid long, cell string, sub array<string>")
        moved = moved.groupBy("uid").agg(F.flatten(F.collect_list("sub")).alias("sub"),
                                         F.map_from_entries(F.collect_list(F.struct("cell", F.get("sub", F.lit(0))))).alias("to"))
        kept = F.array_except("cells", F.coalesce(F.map_keys("to"), none))
        rows = cut_lineage(rows.join(moved, "uid", "left").select(
            "uid", "vec", F.array_sort(F.concat(kept, F.coalesce("sub", none))).alias("cells"),
            F.coalesce(F.try_element_at("to", F.col("main")), F.col("main")).alias("main"),
            F.col("sub").isNotNull().alias("open")))
    return rows.select("uid", "vec", "cells")


def _blocks(rows: DataFrame, shard_rows: int) -> DataFrame:
    """(uid, vec, w, cells, cell, blk, nb): shards with more rows than
    ``shard_rows`` in blocks by a hash."""
    placed = rows.withColumn("cell", F.explode("cells"))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(shard_rows)).cast("int").alias("nb"))
    # one row a shard; large shards are keys of this join that skew splitting or the broadcast takes care of
    sizes = cut_lineage(sizes)
    few = sizes.count() <= 10_000
    return placed.join(F.broadcast(sizes) if few else sizes, "cell").withColumn(
        "blk", F.pmod(F.xxhash64("uid"), F.col("nb")).cast("int"))


def shard_links(rows: DataFrame, dim: int, min_cosine: float = MIN_COSINE, shard_rows: int = SHARD_ROWS,
                beam: int = BEAM) -> DataFrame:
    """(a, b, n): b null: ``n`` vectors linked to a; else a link of a spanning
    forest. ``rows``: (uid, vec, w, cells)."""
    placed = cut_lineage(_blocks(rows, shard_rows))

    def build(table: pa.Table) -> pa.Table:
        x, uid = matrix(table.column("vec"), dim).astype(np.float32), table.column("uid").to_numpy()
        tail, head = build_graph(x)
        return pa.table([uid[tail], uid[head]], names=["uid", "to"])

    # adjacency lists of all shards a vector is in, put together
    adjacency = placed.select("cell", "blk", "uid", "vec").groupBy("cell", "blk").applyInArrow(
        build, "uid long, to long").groupBy("uid").agg(F.collect_set("to").alias("to"))
    nodes = cut_lineage(placed.join(adjacency, "uid", "left"))
    pairs = nodes.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumns({
        "lo": F.least("blk", "k"), "hi": F.greatest("blk", "k")}).drop("k", "nb")
    margin = 1e-4

    def search(table: pa.Table) -> pa.Table:
        blk, uid = table.column("blk").to_numpy(), table.column("uid").to_numpy()
        exact, w = matrix(table.column("vec"), dim), table.column("w").to_numpy()
        cells = [set(c) for c in table.column("cells").to_pylist()]
        several = np.array([len(c) > 1 for c in cells])
        here = table.column("cell")[0].as_py()
        x = exact.astype(np.float32)
        sides = [np.flatnonzero(blk == table.column(c)[0].as_py()) for c in ("lo", "hi")]
        same = table.column("lo")[0].as_py() == table.column("hi")[0].as_py()
        to = table.column("to").combine_chunks()
        tails = np.repeat(np.arange(len(uid)), np.diff(to.offsets.to_numpy()))
        order = np.argsort(uid)
        flat = to.flatten().to_numpy()
        at = np.searchsorted(uid[order], flat)
        known = (at < len(uid)) & (uid[order][np.minimum(at, len(uid) - 1)] == flat)
        heads = order[at[known]]
        tails = tails[known]

        def found(asks: np.ndarray, own: np.ndarray) -> np.ndarray:
            place = np.full(len(uid), -1)
            place[own] = np.arange(len(own))
            inside = (place[tails] >= 0) & (place[heads] >= 0)
            start, head = lists(len(own), place[tails[inside]], place[heads[inside]])
            entry = medoids(x[own])
            return np.concatenate([range_search(x[own], start, head, entry, x[asks[i:i + 512]], min_cosine - margin, beam)
                                   for i in range(0, len(asks), 512)])

        lo, hi = sides
        hit = found(lo, hi)
        hit |= hit.T if same else found(hi, lo).T
        if same:
            hit &= np.triu(np.ones(hit.shape, dtype=bool), 1)
        count, a_out, b_out = np.zeros(len(uid), dtype=np.int64), [], []
        root = np.arange(len(uid))
        rows_a, rows_b = np.nonzero(hit)
        for i in range(0, len(rows_a), 1 << 16):
            a, b = lo[rows_a[i:i + (1 << 16)]], hi[rows_b[i:i + (1 << 16)]]
            ok = np.einsum("ij,ij->i", exact[a], exact[b]) >= min_cosine
            a, b = a[ok], b[ok]
            # a pair that shares several shards counts in the first
            first = np.ones(len(a), dtype=bool)
            for j in np.flatnonzero(several[a] & several[b]).tolist():
                first[j] = min(cells[a[j]] & cells[b[j]]) == here
            a, b = a[first], b[first]
            np.add.at(count, a, w[b])
            np.add.at(count, b, w[a])
            while True:
                ra, rb = root[a], root[b]
                off = ra != rb
                if not off.any():
                    break
                np.minimum.at(root, np.maximum(ra, rb)[off], np.minimum(ra, rb)[off])
                while not np.array_equal(root, up := root[root]):
                    root = up
        linked, child = np.flatnonzero(count), np.flatnonzero(root != np.arange(len(uid)))
        return pa.table([pa.array(np.concatenate([uid[linked], uid[child]])),
                         pa.array(np.concatenate([np.zeros(len(linked), dtype=np.int64), uid[root[child]]]),
                                  mask=np.arange(len(linked) + len(child)) < len(linked)),
                         pa.array(np.concatenate([count[linked], np.zeros(len(child), dtype=np.int64)]))], names=["a", "b", "n"])

    return pairs.groupBy("cell", "lo", "hi").applyInArrow(search, "a long, b long, n long")


def brute_force_links(classes: DataFrame, dim: int, rows: int = AUDIT_ROWS, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(uid, n): the links of some rows (at most ``rows``, by smallest hash),
    counted against all rows."""
    asked = classes.orderBy(F.xxhash64("uid", F.lit(SEED)), "uid").limit(rows).select("uid", "vec").collect()   # bounded
    ids = np.array([r["uid"] for r in asked], dtype=np.int64)
    q = np.array([r["vec"] for r in asked], dtype=np.float64).reshape(len(ids), dim)

    def count(batches):
        total = np.zeros(len(ids), dtype=np.int64)
        for batch in batches:
            for some in parts(batch, 4096):
                w, uid = some.column("w").to_numpy(), some.column("uid").to_numpy()
                hit = (q @ matrix(some.column("vec"), dim).T >= min_cosine) & (ids[:, None] != uid[None, :])
                total += hit @ w
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["uid", "n"])

    return classes.select("uid", "vec", "w").mapInArrow(count, "uid long, n long").groupBy("uid").agg(F.sum("n").alias("n"))


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                           min_cosine: float = MIN_COSINE, shard_rows: int = SHARD_ROWS, overlap: int = OVERLAP,
                           beam: int = BEAM, recall: float = RECALL, audit_rows: int = AUDIT_ROWS,
                           most_overlap: int = 8) -> DataFrame:
    """(id, n_links, component_id, kept, audited_recall): every row with the
    number of other rows linked to it, and the smallest id it reaches by links;
    kept where that is its own."""
    rows = narrow(vectors, id=F.col(id_col).cast("long"), vec=F.col(vec_col).cast("array<double>"))
    good = F.coalesce(finite(F.col("vec")) & F.exists("vec", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("good", good)
    used = rows.where("good")
    dim = used.agg(F.max(F.size("vec"))).first()[0] or 0
    filled = padded(F.col("vec"), dim, 0.0)
    classes = used.select(filled.alias("vec"), "id").groupBy("vec").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("w"))
    classes = cut_lineage(classes.withColumn("uid", F.monotonically_increasing_id()))
    # scaled by the largest component first, so that squares neither overflow nor vanish
    top = F.array_max(F.transform("vec", lambda x: F.abs(x)))
    scaled = classes.withColumn("top", top).withColumn("s", F.transform("vec", lambda x: x / F.col("top")))
    norm = F.sqrt(F.aggregate("s", F.lit(0.0), lambda t, x: t + x * x))
    unit = cut_lineage(scaled.withColumn("norm", norm).select(
        "uid", "w", F.transform("s", lambda x: x / F.col("norm")).alias("vec")))

    found, measured = None, 1.0
    if dim:
        truth = cut_lineage(brute_force_links(unit, dim, audit_rows, min_cosine))
        while True:
            cells = cut_shards(unit, dim, overlap, shard_rows, min_cosine).join(unit.select("uid", "w"), "uid")
            found = cut_lineage(shard_links(cells, dim, min_cosine, shard_rows, beam))
            got = found.where("b is null").groupBy(F.col("a").alias("uid")).agg(F.sum("n").alias("got"))
            audit = truth.join(got, "uid", "left").agg(F.sum("n").alias("n"), F.sum(F.coalesce("got", F.lit(0))).alias("got")).first()
            measured = audit["got"] / audit["n"] if audit["n"] else 1.0
            if measured >= recall or overlap >= most_overlap:
                break
            overlap, beam = overlap + 1, 2 * beam
    if found is None:
        found = classes.sparkSession.createDataFrame([], "a long, b long, n long")

    counted = found.where("b is null").groupBy(F.col("a").alias("uid")).agg(F.sum("n").alias("n"))
    joined = connected_components(None, found.where("b is not null"), id_col="uid", src="a", dst="b")
    # a component or vector that many rows share is spread over salts
    salts = 16

    def salt(of: str):
        return F.pmod(F.xxhash64(of), F.lit(salts))

    every = F.transform(F.sequence(F.lit(0), F.lit(salts - 1)), lambda i: i.cast("long"))
    member = joined.join(classes.select("uid", "least"), "uid")
    least = member.groupBy("component").agg(F.min("least").alias("component_id")).withColumn("salt", F.explode(every))
    reached = member.withColumn("salt", salt("uid")).join(least, ["component", "salt"]).select(
        "uid", "component_id", F.lit(True).alias("linked"))
    state = classes.join(reached, "uid", "left").join(counted, "uid", "left").select(
        "vec", "least", "w", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"),
        (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"))
    # rows back to their class by its vector
    spread = state.withColumn("salt", F.explode(F.when(F.col("w") == 1, F.array(salt("least"))).otherwise(every))).drop("least", "w")
    linked = used.select("id", filled.alias("vec")).withColumn("salt", salt("id")).join(spread, ["vec", "salt"]).select(
        "id", "n_links", "component_id")
    alone = rows.where("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        "id", "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
        F.lit(float(measured)).alias("audited_recall"))
