import random
import zlib

import numpy as np
import pytest
from conftest import SF01

from murmur.llm import toxicity as t

CLEAN, BAD = "the sun rises over calm hills and water".split(), "gronk zarbit fleebo".split()


def make(n=400, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = rng.choices(CLEAN, k=rng.randrange(5, 60))
        bad = i % 4 == 0
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(BAD).title())
        rows.append((i, " ".join(words), int(bad)))
    return rows


@pytest.fixture(scope="module")
def fitted(spark):
    rows = make()
    docs = spark.createDataFrame([(i, x, "s", 0.5) for i, x, _ in rows], "doc_id long, text string, y string, score double")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    return docs, labels, t.fit_toxicity(docs, labels), rows


def test_learns_and_scores_held_out_rows(spark, fitted):
    docs, _, model, rows = fitted
    held = {r["doc_id"]: r["h"] for r in docs.select("doc_id", t.held_out("doc_id").alias("h")).collect()}
    assert all(held[i] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    score = {r["doc_id"]: r["score"] for r in t.score_toxicity(docs, model).collect()}
    assert all((score[i] >= 0.5) == bool(y) for i, _, y in rows)
    kept = t.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _, y in rows if not y}


def test_labels_of_held_out_rows_change_nothing(spark, fitted):
    docs, labels, model, rows = fitted
    turned = spark.createDataFrame(
        [(i, 1, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows],
        "doc_id long, quality int, toxic int")
    again = t.fit_toxicity(docs, turned)
    assert np.array_equal(again.weight, model.weight) and again.intercept == model.intercept


def test_edge_rows(spark, fitted):
    _, _, model, _ = fitted
    rows = [(1, None), (None, ""), (2, "Fleebo"), (2, "Fleebo"), (3, "sun " * 400_000 + "zarbit")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], round(r["score"], 12)) for r in t.score_toxicity(df, model).collect()), key=str)
    assert len(got) == 5 and dict(got)[2] >= 0.5 and dict(got)[1] == dict(got)[None] < 0.5
    assert t.score_toxicity(df.limit(0), model).count() == 0


def test_long_texts_lose_no_ngram(monkeypatch):
    text, wanted = " ".join(CLEAN * 20) + " gronk", np.ones(len(t.SIZES) << t.BUCKET_BITS, dtype=bool)
    whole = t.present([text, "sun"], wanted)
    monkeypatch.setattr(t, "PIECE_CHARS", 20)
    cut = t.present([text, "sun"], wanted)
    assert all(np.array_equal(a, b) for a, b in zip(whole, cut))


def test_features_are_the_ngrams_of_one_text_only():
    wanted = np.ones(len(t.SIZES) << t.BUCKET_BITS, dtype=bool)
    doc, feature = t.present(["abc", "", "abc"], wanted)
    assert np.array_equal(feature[doc == 0], feature[doc == 2]) and not (doc == 1).any()
    # " abc ": three 3-grams, two 4-grams, one 5-gram
    assert (doc == 0).sum() == 6


def test_without_both_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for labels in ([], [(1, 0)], [(1, None)], [(None, 1)]):
        frame = spark.createDataFrame(labels, "doc_id long, toxic int")
        model = t.fit_toxicity(docs, frame)
        assert [r["score"] for r in t.score_toxicity(docs, model).collect()] == [0.0]


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{n}.parquet") for n in ("documents", "labels"))
    score = t.score_toxicity(docs, t.fit_toxicity(docs, labels))
    rows = score.join(labels, "doc_id").where(t.held_out("doc_id")).select("score", "toxic").collect()
    pos, neg = [r["score"] for r in rows if r["toxic"]], [r["score"] for r in rows if not r["toxic"]]
    auc = np.mean([[(p > n) + (p == n) / 2 for n in neg] for p in pos])
    assert auc > 0.75 and np.mean([n < 0.5 for n in neg]) > 0.95


def brute_scores(rows, learn, min_z, l2):
    """Ratios, features, weights and scores worked out plainly: n-grams from
    slices, a dense matrix, Newton steps."""
    def grams(text):
        line, out = f" {text.lower()} ", set()
        for n in t.SIZES:
            for i in range(len(line) - n + 1):
                h = ord(line[i])
                for c in line[i + 1:i + n]:
                    h = (h * 0x01000193 + ord(c)) % 2**32
                h = (h ^ (h >> 15)) * 0x9E3779B1 % 2**32 >> (32 - t.BUCKET_BITS)
                out.add((t.SIZES.index(n) << t.BUCKET_BITS) + h)
        return out

    held = [grams(x) for x, _ in rows]
    own = [i for i in range(len(rows)) if learn(i)]
    y = np.array([rows[i][1] for i in own], dtype=float)
    total = {1: y.sum() + 2, 0: (1 - y).sum() + 2}
    ratio = {}
    for f in set().union(*(held[i] for i in own)):
        a, b = (1 + sum(f in held[i] for i in own if rows[i][1] == k) for k in (1, 0))
        p, q = a / total[1], b / total[0]
        r = np.log(p / q)
        if abs(r) / np.sqrt((1 - p) / a + (1 - q) / b) >= min_z:
            ratio[f] = r
    names = sorted(ratio)
    x = np.array([[ratio[f] if f in h else 0.0 for f in names] + [1.0] for h in held])
    w, penalty = np.zeros(len(names) + 1), l2 * np.append(np.ones(len(names)), 0.0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x[own] @ w))
        w -= np.linalg.solve((x[own].T * (p * (1 - p))) @ x[own] + np.diag(penalty), x[own].T @ (p - y) + penalty * w)
    return names, 1 / (1 + np.exp(-x @ w))


def test_scores_equal_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        bad = i % 3 == 0
        words = rng.choices(CLEAN, k=rng.randrange(3, 15)) + ([rng.choice(BAD)] if rng.random() < (0.8 if bad else 0.1) else [])
        rows.append((" ".join(words), int(bad)))
    docs = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    names, want = brute_scores(rows, lambda i: zlib.crc32(str(i).encode()) % 5 != 0, 3.0, 1.0)
    model = t.fit_toxicity(docs, labels, min_z=3.0, l2=1.0)
    assert set(np.flatnonzero(model.weight)) == set(names) and len(names) > 20
    got = {r["doc_id"]: r["score"] for r in t.score_toxicity(docs, model).collect()}
    assert max(abs(got[i] - want[i]) for i in got) < 1e-3


def test_no_feature_is_certain(spark):
    """Without a certain feature every score is the base rate."""
    docs = spark.createDataFrame([(i, f"word {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)], "doc_id long, toxic int")
    model = t.fit_toxicity(docs, labels, min_z=50.0)
    learnt = [i % 4 == 0 for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    got = {round(r["score"], 9) for r in t.score_toxicity(docs, model).collect()}
    assert got == {round(sum(learnt) / len(learnt), 9)}


def test_regression_only_reads_stored_rows_by_id(spark, fitted, monkeypatch):
    """One task adds up the sample: it gets finished rows in the order of their
    ids, and neither makes nor sorts them, which would hold them all at once."""
    docs, labels, model, _ = fitted
    seen, fit = [], t.LogisticRegression.fit
    monkeypatch.setattr(t.LogisticRegression, "fit", lambda self, rows: seen.append(rows) or fit(self, rows))
    again = t.fit_toxicity(docs.repartition(7, "text"), labels.orderBy("quality"))
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "EvalPython" not in plan and "Exchange" not in plan
    ids = [r["id"] for r in seen[0].select("id").collect()]
    assert seen[0].rdd.getNumPartitions() == 1 and ids == sorted(ids) and len(set(ids)) == len(ids) > 100
    assert np.array_equal(again.weight, model.weight) and again.intercept == model.intercept
