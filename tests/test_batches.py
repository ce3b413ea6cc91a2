"""Batch by batch equals one run; the approximate join equals the exact one
but for misses."""

import math

import numpy as np
import pytest

from murmur.operators.approx import approx_cosine_join, join_recall, tables_for
from murmur.operators.batches import add_batch, batch_labels
from murmur.operators.cluster import cosine_eps_join, dbscan_cosine
from test_cluster import _vectors, brute_dbscan


def frame(spark, X, start=0):
    return spark.createDataFrame([(start + i, [float(v) for v in x]) for i, x in enumerate(X)],
                                 "pos long, embedding array<float>")


def by_batches(spark, X, cuts, **how):
    state = None
    for lo, hi in zip([0, *cuts], [*cuts, len(X)]):
        state = add_batch(state, frame(spark, X[lo:hi], lo).repartition(3), **how)
    got = dict(tuple(r) for r in batch_labels(state).collect())
    assert sorted(got) == list(range(len(X)))
    return np.array([got[i] for i in range(len(X))]), state


@pytest.mark.parametrize("seed,eps,ms,cuts,block,cells", [
    (1, 0.05, 2, (100, 110), 50, None), (2, 0.08, 4, (80, 160), 37, 5), (3, 0.1, 5, (1, 120), None, None),
    (4, 0.03, 3, (239,), 23, 4), (5, 0.06, 1, (120, 120), None, 0)])
def test_batches_equal_one_run(spark, seed, eps, ms, cuts, block, cells):
    X = _vectors(seed)
    X[200:220] = X[20:40]           # later rows repeat stored vectors
    X[[5, 150, 230]] = 0            # zero vectors in several batches
    got, _ = by_batches(spark, X, cuts, eps=eps, min_samples=ms, block_rows=block, cells=cells)
    assert (got >= 0).any() and np.array_equal(got, brute_dbscan(X, eps, ms))


def test_a_batch_joins_two_clusters_and_wakes_old_rows(spark):
    def at(deg):
        return [math.cos(math.radians(deg)), math.sin(math.radians(deg))]
    eps = 1 - math.cos(math.radians(10.5))
    X = np.array([at(d) for d in (0, 10, 40, 50, 100, 20, 30, 110, 90)], dtype=np.float32)
    first, state = by_batches(spark, X[:5], (), eps=eps, min_samples=2)
    assert list(first) == [0, 0, 1, 1, -1]
    state = add_batch(state, frame(spark, X[5:], 5), eps=eps, min_samples=2)
    got = dict(tuple(r) for r in batch_labels(state).collect())
    assert [got[i] for i in range(9)] == [0, 0, 0, 0, 1, 0, 0, 1, 1]
    again = add_batch(state, frame(spark, X[:0]), eps=eps, min_samples=2)      # an empty batch
    assert dict(tuple(r) for r in batch_labels(again).collect()) == got
    for bad in (frame(spark, X[:1], 3), frame(spark, X[:2], 20).selectExpr("20L AS pos", "embedding")):
        with pytest.raises(ValueError):
            add_batch(state, bad, eps=eps, min_samples=2)
    with pytest.raises(ValueError):
        add_batch(None, frame(spark, X), eps=1.5)


def test_stored_classes_are_not_compared_again(spark, monkeypatch):
    """The groups of a batch of b classes ship n rows a block of b, not n²."""
    from murmur.operators import batches as m
    X = _vectors(6, n=200)
    _, state = by_batches(spark, X, (), eps=0.05, min_samples=3, block_rows=20)
    shipped = []
    monkeypatch.setattr(m, "_gain_fn", lambda eps: lambda pdf: pdf.assign(cnt=1)[["_id", "cnt"]])
    real = m._against

    def counted(*args):
        out = real(*args)
        if args[-1].startswith("_id"):
            shipped.append(out.count())
        return out
    monkeypatch.setattr(m, "_against", counted)
    m.add_batch(state, frame(spark, X[:5] + 1, 200), eps=0.05, min_samples=3, block_rows=20)
    assert shipped and shipped[0] <= 205 + 5 * 11       # every class once, the new ones once a block


def test_tables_reach_the_recall():
    for eps, bits, recall in ((0.1, 8, 0.9), (0.35, 4, 0.95), (0.02, 16, 0.99)):
        share = (1 - math.acos(1 - eps) / math.pi) ** bits
        t = tables_for(eps, bits, recall)
        assert 1 - (1 - share) ** t >= recall > 1 - (1 - share) ** (t - 1)


@pytest.mark.parametrize("bits,block", [(None, None), (6, 25)])
def test_approximate_join(spark, bits, block):
    X = _vectors(7, n=300)
    X[3], X[40:60] = 0, X[10]                            # a zero vector, a group of copies
    df = frame(spark, X).selectExpr("pos AS id", "embedding", "1 AS _table", "'x' AS distance")
    exact = {(r.src, r.dst): r.distance for r in cosine_eps_join(df, "id", "embedding", 0.1).collect()}
    rows = approx_cosine_join(df, "id", "embedding", 0.1, bits=bits, block_rows=block).collect()
    found = {(r.src, r.dst): r.distance for r in rows}
    assert len(found) == len(rows) and set(found) <= set(exact)
    assert all(abs(found[k] - exact[k]) < 1e-12 for k in found) and len(found) >= 0.9 * len(exact) > 0
    row = join_recall(df, "id", "embedding", 0.1, bits=bits, block_rows=block).first()
    assert (row.exact_pairs, row.wrong_pairs, row.repeated_pairs) == (len(exact), 0, 0)
    assert row.measured_recall == len(found) / len(exact)


def test_approximate_join_edges(spark):
    df = spark.createDataFrame([(1, None), (2, [0.0, 0.0])], "id long, embedding array<float>")
    assert approx_cosine_join(df, "id", "embedding").count() == 0
    assert approx_cosine_join(df.limit(0), "id", "embedding").count() == 0
    with pytest.raises(ValueError):
        approx_cosine_join(df, "id", "embedding", eps=1.0)
