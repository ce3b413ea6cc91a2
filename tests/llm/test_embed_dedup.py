import math

import numpy as np
import pytest

from murmur.llm import embed_dedup as ed

NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, "x") for i, v in rows],
                                 "vec_id long, embedding array<double>, id int, n int, cell string").repartition(3)


def brute(rows):
    """Per row its links, and the smallest id reached."""
    good = [v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    dim = max([len(v) for (_, v), g in zip(rows, good) if g], default=0)
    u = np.zeros((len(rows), dim))
    for i, (_, v) in enumerate(rows):
        if good[i]:
            top = max(abs(x) for x in v)
            u[i, :len(v)] = [x / top for x in v]
            u[i] /= np.linalg.norm(u[i])
    near = (u @ u.T >= 0.9) & ~np.eye(len(rows), dtype=bool)
    out = []
    for i, (own, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = set(np.flatnonzero(near[todo.pop()]).tolist()) - seen
            seen |= new
            todo += new
        least = min([rows[j][0] for j in seen if rows[j][0] is not None], default=None)
        out.append((own, int(near[i].sum()), least, own == least))
    return sorted(out, key=str)


def got(df, **how):
    return sorted(((r["id"], r["n_links"], r["component_id"], r["kept"]) for r in ed.near_duplicate_vectors(df, **how).collect()), key=str)


ODD = [(1, None), (2, [1.0, NAN]), (3, [INF, 0.0]), (4, [None, 1.0]), (5, []), (6, [0.0, 0.0]), (7, [0.5]), (8, [0.5, -0.2]),
       (8, [1.0, 2.0]), (9, [2.0, 4.0]), (10, [0.5, -0.2]), (10, [0.5, -0.2]), (None, [3.0, 6.0]), (None, [-1.0, 0.1]),
       (11, [1e200, 2e200]), (12, [1e-200, 2e-200]), (13, [1.0, 2.0, 0.0]), (14, [0.0, 0.0, 5.0]), (None, None), (15, [-2.0])]


def test_edge_rows(spark):
    assert got(frame(spark, ODD)) == brute(ODD)
    assert got(frame(spark, ODD).limit(0)) == []
    assert got(frame(spark, ODD[:5])) == brute(ODD[:5])


def clouds(rng, groups, dim=24, far=1500):
    """Unit vectors, some of them in groups of near copies."""
    x = [rng.standard_normal((far, dim))]
    for n, noise in groups:
        x.append(rng.standard_normal((1, dim)) + noise * rng.standard_normal((n, dim)))
    x = np.concatenate(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("shard_rows", [2048, 120])
def test_links_of_groups_and_copies(spark, shard_rows):
    rng = np.random.default_rng(6)
    x = clouds(rng, [(2, 0.1)] * 60 + [(40, 0.15), (250, 0.1)])
    x[:300] = x[0]                                   # one vector many rows share
    order = rng.permutation(len(x))
    rows = [(int(i), x[j].tolist()) for i, j in enumerate(order)]
    want, have = brute(rows), got(frame(spark, rows), shard_rows=shard_rows)
    assert [r[0] for r in want] == [r[0] for r in have]
    links = sum(r[1] for r in want)
    assert sum(min(a[1], b[1]) for a, b in zip(want, have)) >= 0.98 * links
    assert all(b[1] <= a[1] for a, b in zip(want, have))
    assert sum(a[2] == b[2] for a, b in zip(want, have)) >= 0.99 * len(rows)


def test_robust_prune_keeps_no_dominated_edge():
    rng = np.random.default_rng(7)
    x = clouds(rng, [(30, 0.2)], dim=8, far=100).astype(np.float32)
    at = np.arange(len(x))
    cand = rng.integers(0, len(x), (len(x), 40))
    out = ed.robust_prune(x, at, cand, degree=40)
    d = np.sqrt(np.maximum(2 - 2 * x @ x.T, 0))
    for i in at:
        kept = [j for j in out[i] if j >= 0]
        plain = []
        for j in sorted(set(cand[i].tolist()) - {int(i)}, key=lambda j: d[i, j]):
            if all(1.2 * d[p, j] > d[i, j] for p in plain):
                plain.append(j)
        assert [round(float(d[i, j]), 4) for j in kept] == [round(float(d[i, j]), 4) for j in plain]


def test_range_search_finds_what_is_in_range():
    rng = np.random.default_rng(8)
    x = clouds(rng, [(3, 0.1)] * 50 + [(200, 0.15)], dim=32).astype(np.float32)
    start, head = ed.lists(len(x), *ed.build_graph(x))
    hit = ed.range_search(x, start, head, ed.medoids(x), x, 0.9)
    true = x @ x.T >= 0.9
    assert not (hit & ~(x @ x.T >= 0.9 - 1e-5)).any()
    assert (hit & true).sum() >= 0.98 * true.sum()
