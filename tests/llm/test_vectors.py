import math

import numpy as np
from conftest import SF001
from pyspark.sql import functions as F

from murmur.llm.ann import Forest, nearest_neighbours
from murmur.llm.topk import ImpactIndex, exact_top_k, search_block

NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, rank int, id int")


def usable(rows, dim):
    return [(i, [float(np.float32(x)) for x in v] + [0.0] * (dim - len(v))) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]


def brute_top(rows, dim, k, step):
    own = [(i, [math.floor(64 * x) for x in v]) for i, v in usable(rows, dim)]
    out = set()
    for qi, q in own:
        if qi % step == 0:
            best = sorted((-sum(a * b for a, b in zip(q, c)), ci) for ci, c in own if ci != qi)[:k]
            out |= {(qi, r + 1, ci, -s) for r, (s, ci) in enumerate(best)}
    return out


ODD = [(1, None), (2, [1.0, NAN]), (3, [INF, 0.0]), (4, [None, 1.0]), (None, [1.0, 1.0]), (5, []), (6, [0.0, 0.0]),
       (7, [0.5]), (8, [0.5, -0.25]), (10, [0.5, -0.25]), (12, [0.5, -0.25]), (14, [-1.5, 2.0])]


def as_rows(df):
    return {(r["query_id"], r["rank"], r["id"], r["score"]) for r in df.collect()}


def test_top_k_edge_rows(spark):
    df = frame(spark, ODD)
    for k in (2, 50):
        assert as_rows(exact_top_k(df, F.col("id") % 2 == 0, k=k)) == brute_top(ODD, 2, k, 2)
    assert as_rows(exact_top_k(df.limit(0), F.col("id") % 2 == 0)) == set()


def test_top_k_equals_brute_force_over_blocks(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((5, 24))
    x = centres[rng.integers(0, 5, 900)] + 0.4 * rng.standard_normal((900, 24))
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    x[100:400] = x[100]                               # one common vector
    rows = [(i, [float(np.float32(a)) for a in v]) for i, v in enumerate(x)]
    got = as_rows(exact_top_k(frame(spark, rows), F.col("id") % 20 == 0, k=7, block_rows=200, chunk_rows=16))
    assert got == brute_top(rows, 24, 7, 20)


def test_bounds_never_lose_a_member():
    rng = np.random.default_rng(3)
    values, queries = (np.floor(64 * rng.standard_normal((n, 16))).astype(np.int64) for n in (300, 20))
    scores = queries @ values.T
    floor = np.sort(scores, axis=1)[:, -5].astype(float)
    some_left = 0
    for few in (0.0, 0.15, 1.0):
        for rows, s, f in zip(ImpactIndex(values).possible(queries, floor, few=few), scores, floor):
            assert set(np.flatnonzero(s >= f)) <= set(rows)
            some_left += len(rows) < len(s)
    assert some_left       # bounds do rule rows out
    huge = values * (1 << 20)
    at, got, score = search_block(np.arange(3), queries[:3] * (1 << 5), np.arange(100, 400), huge, k=4)
    for i in range(3):
        want = np.sort((queries[i] * (1 << 5)) @ huge.T)[::-1][:4]
        assert np.array_equal(score[at == i], want)


def brute_near(rows, dim, k, step):
    own = [(i, np.array(v)) for i, v in usable(rows, dim) if any(v)]
    return {qi: sorted((math.dist(q, c), ci) for ci, c in own if ci != qi)[:k] for qi, q in own if qi % step == 0}


def test_neighbours_edge_rows(spark):
    df = frame(spark, ODD)
    for k in (3, 10):         # production parameters: all candidates, if fewer than k
        got = nearest_neighbours(df, F.col("id") % 2 == 0, k=k).collect()
        want = brute_near(ODD, 2, k, 2)
        assert {(r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in got} == {
            (q, n + 1, i, round(d, 9)) for q, best in want.items() for n, (d, i) in enumerate(best)}
    nine = [(i, [float(i % 5), float(i * i % 7), 1.0]) for i in range(9)]
    got = nearest_neighbours(frame(spark, nine), F.col("id") >= 0).collect()
    assert sorted((r["query_id"], r["id"]) for r in got) == [(a, b) for a in range(9) for b in range(9) if a != b]
    # one id on many copies of a vector hides no other id
    copies = [(1, [1.0, 2.0])] * 40 + [(i, [1.0, 2.0]) for i in range(2, 15)] + [(50, [9.0, 9.0])]
    got = nearest_neighbours(frame(spark, copies), F.col("id") == 1).collect()
    assert sorted(r["id"] for r in got) == list(range(2, 12)) and all(r["score"] == 0 for r in got)
    assert nearest_neighbours(df.limit(0), F.col("id") % 2 == 0).count() == 0


def test_whole_search_is_exact_with_copies_and_split_groups(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 8))
    x[50:300] = x[50]
    rows = [(i, [float(np.float32(a)) for a in v]) for i, v in enumerate(x)]
    got = nearest_neighbours(frame(spark, rows), F.col("id") % 25 == 0, k=5, trees=2, search_share=1.0, group_rows=50)
    want = brute_near(rows, 8, 5, 25)
    assert {(r["query_id"], r["rank"], r["id"]) for r in got.collect()} == {
        (q, n + 1, i) for q, best in want.items() for n, (_, i) in enumerate(best)}


def test_recall_on_the_table(spark):
    df = spark.read.parquet(f"{SF001}/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"])) for r in df.collect()]
    want = brute_near(rows, len(rows[0][1]), 10, 10)
    got = {}
    for r in nearest_neighbours(df, F.col("id") % 10 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["id"])
    hits = sum(len(got.get(q, set()) & {i for _, i in best}) for q, best in want.items())
    assert hits >= 0.9 * sum(len(b) for b in want.values())


def test_queue_visits_every_leaf_once():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((200, 6))
    forest = Forest(x, trees=3, depth=3)
    seen = forest.search(x[0], 100)
    assert len(seen) == len(set(seen)) == 24
    own = forest.leaves(x[:1])[0]
    first = {t: leaf for t, leaf in reversed(seen)}
    assert all(first[t] == own[t] for t in range(3))
