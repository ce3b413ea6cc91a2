import numpy as np
import pytest
from pyspark.sql import functions as F


from murmur.operators.cluster import connected_components, cosine_eps_join, dbscan_cosine


def brute_dbscan(X, eps, min_samples):
    """Sequential reference: expansion in index order, cosine distance."""
    X = np.asarray(X, dtype=np.float64)
    n = np.linalg.norm(X, axis=1, keepdims=True)
    U = np.divide(X, n, out=np.zeros_like(X), where=n > 0)
    D = 1.0 - U @ U.T
    nb = [np.nonzero(D[i] <= eps)[0] for i in range(len(X))]
    core = np.array([len(x) >= min_samples for x in nb])
    labels = np.full(len(X), -1)
    k = 0
    for i in range(len(X)):
        if labels[i] != -1 or not core[i]:
            continue
        labels[i] = k
        stack = [i]
        while stack:
            j = stack.pop()
            if core[j]:
                for m in nb[j]:
                    if labels[m] == -1:
                        labels[m] = k
                        if core[m]:
                            stack.append(m)
        k += 1
    return labels


def _vectors(seed, n=240, dim=6, centers=7, spread=0.25):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centers, dim))
    pick = rng.integers(0, centers, size=n)
    X = c[pick] + spread * rng.normal(size=(n, dim))
    noise = rng.random(n) < 0.2
    X[noise] = rng.normal(size=(noise.sum(), dim)) * 2
    return X.astype(np.float32)


def _run(spark, X, eps, min_samples, block_rows, shuffle=False):
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(X)]
    if shuffle:
        rows = rows[::-1]
    df = spark.createDataFrame(rows, "pos long, embedding array<float>").repartition(5)
    out = dbscan_cosine(df, eps=eps, min_samples=min_samples, block_rows=block_rows)
    got = dict((r.pos, r.cluster) for r in out.collect())
    return np.array([got[i] for i in range(len(X))])


@pytest.mark.parametrize("seed,eps,ms,block", [(1, 0.05, 2, 50), (2, 0.08, 3, 37), (3, 0.1, 5, 1000), (4, 0.03, 4, 23)])
def test_dbscan_matches_brute_force(spark, seed, eps, ms, block):
    X = _vectors(seed)
    expected = brute_dbscan(X, eps, ms)
    assert (expected >= 0).sum() > 0
    assert np.array_equal(_run(spark, X, eps, ms, block), expected)


@pytest.mark.parametrize("seed,eps,ms,block,cells", [(1, 0.05, 2, 50, 9), (2, 0.08, 3, 37, 20), (3, 0.1, 5, 1000, 40),
                                                     (5, 0.4, 3, 60, 12), (6, 0.02, 1, 11, 30)])
def test_metric_cells_match_brute_force(spark, seed, eps, ms, block, cells):
    X = _vectors(seed)
    X[5] = X[17] = 0                                   # zero vectors
    X[30:40] = X[30]
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(X)]
    df = spark.createDataFrame(rows, "pos long, embedding array<float>").repartition(5)
    out = dbscan_cosine(df, eps=eps, min_samples=ms, block_rows=block, cells=cells)
    got = dict((r.pos, r.cluster) for r in out.collect())
    assert [got[i] for i in range(len(X))] == brute_dbscan(X, eps, ms).tolist()
    plain = {(r.src, r.dst): round(r.distance, 9) for r in cosine_eps_join(df, "pos", "embedding", eps, block, cells=0).collect()}
    pairs = cosine_eps_join(df, "pos", "embedding", eps, block, cells=cells).collect()
    assert len(pairs) == len(plain) and {(r.src, r.dst): round(r.distance, 9) for r in pairs} == plain


def _cell_work(x, eps, rows):
    """Pairs compared with the cells that are chosen, as a share of all pairs."""
    from murmur.operators import cluster as c
    pivots = c.choose_pivots(x[:c.SAMPLE_ROWS], len(x), eps, rows)
    if pivots is None:
        return 1.0
    home, _, cell = c._near_cells(x, pivots, eps)
    return c._work(np.bincount(home, minlength=len(pivots)), np.bincount(cell, minlength=len(pivots)), rows)[0] / (len(x) ** 2 / 2)


def test_cells_compare_far_fewer_pairs_than_all():
    """Grouped vectors: work per row hardly grows with their number."""
    rng = np.random.default_rng(9)
    share = []
    for n in (8_000, 32_000):
        c = rng.standard_normal((n // 20, 48))
        x = c[rng.integers(0, len(c), n)] + 0.3 * rng.standard_normal((n, 48))
        share.append(_cell_work(x / np.linalg.norm(x, axis=1, keepdims=True), 0.02, 2_000))
    assert share[0] < 0.5 and share[1] < 0.6 * share[0]
    # too wide a threshold for the data: plain blocks
    x = rng.standard_normal((9_000, 64))
    assert _cell_work(x / np.linalg.norm(x, axis=1, keepdims=True), 0.6, 2_000) == 1.0


def test_dbscan_invariant_to_row_order_and_blocks(spark):
    X = _vectors(7)
    a = _run(spark, X, 0.06, 3, 30)
    b = _run(spark, X, 0.06, 3, 500, shuffle=True)
    assert np.array_equal(a, b)


def test_contested_border_takes_lowest_cluster(spark):
    # two groups of 10 around e1 and e2 (all mutually within eps) and one
    # point between them, within eps of 3 cores of each group but with only
    # 7 neighbours itself: a border point reachable from both clusters
    t = np.linspace(0, 0.5, 10)
    a = [[1.0, 0.0, x] for x in t]
    b = [[0.0, 1.0, x] for x in t]
    X = np.array(b + a + [[1.0, 1.0, 0.0]], dtype=np.float32)
    eps, ms = 0.30, 8
    labels = brute_dbscan(X, eps, ms)
    assert labels[20] == 0 and set(labels[:10]) == {0} and set(labels[10:20]) == {1}
    assert np.array_equal(_run(spark, X, eps, ms, 4), labels)
    # reversed group order: the border point follows the lower label again
    X2 = np.array(a + b + [[1.0, 1.0, 0.0]], dtype=np.float32)
    assert np.array_equal(_run(spark, X2, eps, ms, 6), brute_dbscan(X2, eps, ms))


# FIXTURES.md, F-feedback-vec: (sf, min_samples, clusters, noise, largest, core, border)
FIXTURE_TABLE = [
    ("0.001", 2, 46, 388, 6, 112, 0),
    ("0.001", 3, 13, 454, 6, 18, 28),
    ("0.01", 2, 42, 401, 8, 99, 0),
    ("0.01", 3, 8, 469, 8, 16, 15),
    ("0.1", 2, 268, 819, 75, 1181, 0),
    ("0.1", 3, 130, 1095, 75, 482, 423),
    ("0.1", 4, 77, 1550, 27, 139, 311),
]


@pytest.mark.parametrize("sf,ms,clusters,noise,largest,core,border", FIXTURE_TABLE)
def test_fixture_counts(spark, sf, ms, clusters, noise, largest, core, border):
    from murmur.plans.fixtures import feedback_fixture, table
    vec = table(spark, f"/root/testdata/sf{sf}", "embeddings").select(F.col("vec_id").alias("pos"), "embedding")
    fb = feedback_fixture(spark, f"/root/testdata/sf{sf}").join(vec, "pos")
    d = dbscan_cosine(fb, eps=0.6, min_samples=ms, core_col="core").cache()
    st = d.agg(F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("k"),
               F.count_if(F.col("cluster") == -1).alias("noise"),
               F.count_if("core").alias("core"),
               F.count_if(~F.col("core") & (F.col("cluster") >= 0)).alias("border")).first()
    big = d.where("cluster >= 0").groupBy("cluster").count().agg(F.max("count")).first()[0]
    assert (st.k, st.noise, big, st.core, st.border) == (clusters, noise, largest, core, border)


def test_cosine_eps_join_brute_force(spark):
    X = _vectors(5, n=150)
    eps = 0.1
    U = X / np.linalg.norm(X, axis=1, keepdims=True)
    D = 1 - U.astype(np.float64) @ U.T.astype(np.float64)
    expected = {(i, j) for i in range(len(X)) for j in range(i + 1, len(X)) if D[i, j] <= eps}
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(X)], "id long, v array<float>")
    got = {(r.src, r.dst) for r in cosine_eps_join(df, "id", "v", eps=eps, block_rows=40).collect()}
    assert got == expected


def test_connected_components_long_chain(spark):
    chain = [(i, i + 1) for i in range(60)]
    other = [(100, 101), (101, 102), (102, 100)]
    edges = spark.createDataFrame(chain[::-1] + other, "src long, dst long")
    verts = spark.createDataFrame([(i,) for i in list(range(61)) + [100, 101, 102, 200]], "id long")
    comp = {r.id: r.component for r in connected_components(verts, edges).collect()}
    assert all(comp[i] == 0 for i in range(61))
    assert comp[100] == comp[101] == comp[102] == 100 and comp[200] == 200


def test_sf01_min4_labels_match_brute_force(spark):
    """The case with border rows reachable from more than one cluster."""
    from murmur.plans.fixtures import feedback_vec_fixture
    # one row a vector: events with a number below the 2,000 vectors
    fb = feedback_vec_fixture(spark, "/root/testdata/sf0.1").where("pos < 2000")
    rows = sorted((r.pos, r.embedding) for r in fb.select("pos", "embedding").collect())
    X = np.array([e for _, e in rows], dtype=np.float32)
    expected = brute_dbscan(X, 0.6, 4)
    got = {r.pos: r.cluster for r in dbscan_cosine(fb, eps=0.6, min_samples=4, block_rows=700).collect()}
    assert np.array_equal(np.array([got[p] for p, _ in rows]), expected)


@pytest.mark.parametrize("ms", [1, 2, 3])
def test_zero_vectors(spark, ms):
    X = _vectors(11, n=60)
    X[[3, 17, 40]] = 0.0
    expected = brute_dbscan(X, 0.08, ms)
    assert (expected[[3, 17, 40]] == -1).all()
    assert np.array_equal(_run(spark, X, 0.08, ms, 25), expected)


def test_grouped_dbscan_equals_separate_runs(spark):
    """Each group (dataset) is clustered on its own inside one set of jobs."""
    from murmur.plans.fixtures import feedback_vec_fixture
    fb = feedback_vec_fixture(spark, "/root/testdata/sf0.01").withColumn("ds", (F.col("pos") % 3).cast("int"))
    for ms in (2, 3):
        grouped = {r.pos: r.cluster for r in
                   dbscan_cosine(fb, eps=0.6, min_samples=ms, group_col="ds", block_rows=60).collect()}
        for g in range(3):
            part = fb.where(F.col("ds") == g)
            alone = {r.pos: r.cluster for r in dbscan_cosine(part, eps=0.6, min_samples=ms).collect()}
            assert {p: grouped[p] for p in alone} == alone


def test_equal_vectors_count_as_rows(spark):
    """A vector that many rows share: degrees, cores and labels are those of
    the rows, for every min_samples, with and without groups."""
    X = _vectors(11, n=60)
    rows = [(i, [float(np.float32(x)) for x in X[i % 7 if i % 3 == 0 else i % 60]]) for i in range(240)]
    rows += [(240 + i, [0.0] * len(X[0])) for i in range(3)]
    df = spark.createDataFrame(rows, "pos long, embedding array<float>")
    V = np.array([v for _, v in rows])
    U = np.divide(V, np.linalg.norm(V, axis=1, keepdims=True), out=np.zeros_like(V), where=V.any(axis=1, keepdims=True))
    near = 1.0 - U @ U.T <= 0.3
    for ms in (1, 2, 3, 9, 40):
        core = near.sum(axis=1) >= ms
        label = np.full(len(V), -1)
        k = 0
        for i in np.flatnonzero(core):
            if label[i] < 0:
                todo = [i]
                while todo:
                    j = todo.pop()
                    if label[j] < 0:
                        label[j] = k
                        if core[j]:
                            todo += [x for x in np.flatnonzero(near[j]) if label[x] < 0]
                k += 1
        got = dbscan_cosine(df, eps=0.3, min_samples=ms, block_rows=16).collect()
        assert len(got) == len(rows)
        assert {r.pos: r.cluster for r in got} == dict(enumerate(label.tolist()))
        twice = df.withColumn("g", F.lit(0)).unionByName(df.withColumns({"g": F.lit(1), "pos": F.col("pos") + 1000}))
        both = dbscan_cosine(twice, eps=0.3, min_samples=ms, block_rows=16, group_col="g").collect()
        assert {(r.g, r.pos % 1000): r.cluster for r in both} == {
            (g, i): int(c) for g in (0, 1) for i, c in enumerate(label)}


def test_positions_must_be_unique(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0])], "pos long, embedding array<float>")
    with pytest.raises(ValueError, match="unique"):
        dbscan_cosine(df)


def test_dense_tiles_stay_small():
    """A tile in which all pairs are neighbours never gathers all its pairs."""
    import tracemalloc

    from murmur.operators.cluster import _neighbour_tiles
    U = np.ones((2048, 64)) / 8.0
    tracemalloc.start()
    n = sum(len(i) for i, _, _ in _neighbour_tiles(U, U[:1024], 0.35, False))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 2048 * 1024 and peak < 64 << 20


def test_a_third_of_all_rows_alike(spark):
    """The hot vector is one class: no block pair ever sees its rows."""
    n = 30_000
    v = F.when(F.col("id") % 3 == 0, F.array(*[F.lit(1.0)] * 8)).otherwise(
        F.array(*[F.rand(i) - 0.5 for i in range(8)])).cast("array<float>")
    df = spark.range(n).select(F.col("id").alias("pos"), v.alias("embedding"))
    got = dbscan_cosine(df, eps=0.01, min_samples=5, block_rows=8192)
    sizes = {r.cluster: r["count"] for r in got.groupBy("cluster").count().collect()}
    assert sum(sizes.values()) == n and sizes[0] >= n // 3


def test_copies_of_a_row_do_not_grow_with_the_rows(spark):
    """Blocks are shipped once per block of their cell; there are at most MAX_BLOCKS."""
    from murmur.operators.cluster import MAX_BLOCKS, _layout, _replicate, block_rows_for, shipped_rows
    for n in (3000, 12000):
        df = spark.range(n).selectExpr("id", "array(float(id + 1), float(1)) as v")
        prepared, _ = _layout(df, "id", "v", 0.1, 10, cells=0)
        assert _replicate(prepared).count() == MAX_BLOCKS * n
    assert shipped_rows(10, 100, 2) == 10                                  # few rows: as asked
    assert shipped_rows(10, 10 ** 9, 64) == block_rows_for(64)             # never more than the memory holds
