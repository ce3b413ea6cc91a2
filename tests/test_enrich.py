import pytest
from pyspark.sql import functions as F

from conftest import SF001, SF01
from murmur.operators.enrich import detect_severity, score_sentiment, l2_normalize, cosine_to_vector
from murmur.plans.fixtures import FEEDBACK_TEMPLATES, feedback_fixture

# expected severity of each template (FIXTURES.md, F-feedback)
EXPECTED = ["HIGH", "HIGH", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "HIGH", "LOW",
            "HIGH", "LOW", "MEDIUM", "MEDIUM", "LOW", "LOW", "HIGH", "MEDIUM"]


def test_severity_rules(spark):
    df = spark.createDataFrame([(t,) for t in FEEDBACK_TEMPLATES], ["text"])
    got = [r.severity for r in detect_severity(df).collect()]
    assert got == EXPECTED


@pytest.mark.parametrize("text,label", [
    ("It crashes daily", "HIGH"),            # substring of a listed word
    ("I can’t log in", "LOW"),                # curly apostrophe does not match
    ("I can't log in", "HIGH"),
    ("waited 12 hours", "HIGH"),             # hours only via the regex
    ("waited hours", "LOW"),
    ("took ٣ days", "HIGH"),                 # Unicode digit, like Python's \d
    ("this fail is odd", "LOW"),             # bare fail is not listed
    ("takes too long to open", "MEDIUM"),
])
def test_severity_edges(spark, text, label):
    df = spark.createDataFrame([(text,)], ["text"])
    r = detect_severity(df).first()
    assert r.severity == label
    assert r.severity_score == {"HIGH": 1.0, "MEDIUM": 0.6, "LOW": 0.3}[label]


def test_fixture_counts(spark):
    fb = detect_severity(score_sentiment(feedback_fixture(spark, SF001)))
    sev = {r[0]: r[1] for r in fb.groupBy("severity").count().collect()}
    assert sev == {"HIGH": 439, "MEDIUM": 312, "LOW": 249}
    sen = {r[0]: r[1] for r in fb.groupBy("sentiment").count().collect()}
    assert sen == {"negative": 689, "positive": 311}
    fb2 = detect_severity(score_sentiment(feedback_fixture(spark, SF01)))
    sev2 = {r[0]: r[1] for r in fb2.groupBy("severity").count().collect()}
    assert sev2 == {"HIGH": 4375, "MEDIUM": 3125, "LOW": 2500}


def test_sentiment_score(spark):
    df = spark.createDataFrame([("love it but slow and boring",), ("nothing here",), ("great and easy",)], ["text"])
    rows = score_sentiment(df).collect()
    assert rows[0].sentiment == "negative" and rows[0].sentiment_score == pytest.approx(0.5 + 0.5 * 1 / 3)
    assert rows[1].sentiment == "positive" and rows[1].sentiment_score == 0.5
    assert rows[2].sentiment == "positive" and rows[2].sentiment_score == 1.0


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], ["v"])
    rows = cosine_to_vector(l2_normalize(df, "v", "u"), "v", [1.0, 0.0]).collect()
    assert rows[0].u == pytest.approx([0.6, 0.8]) and rows[0].similarity == pytest.approx(0.6)
    assert rows[1].u == [0.0, 0.0] and rows[1].similarity == 0.0


def test_embed_text_unit_norm_and_deterministic(spark):
    from murmur.operators.enrich import embed_text, fit_text_embedder
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    model = fit_text_embedder(docs, dim=128)
    a = {r.doc_id: r.embedding for r in embed_text(docs, model).collect()}
    b = {r.doc_id: r.embedding for r in embed_text(docs, model).collect()}
    assert a == b and all(len(v) == 128 for v in a.values())
    norms = [sum(x * x for x in v) ** 0.5 for v in a.values()]
    assert all(abs(n - 1) < 1e-5 or n == 0 for n in norms)


def test_predict_batch_hook(spark):
    import numpy as np
    from pyspark.sql import functions as F
    from pyspark.sql.types import FloatType
    from murmur.operators.enrich import predict_batch_scorer

    def make_predict_fn():
        threshold = 20.0   # "model" loaded once per Python worker

        def predict(lengths: np.ndarray) -> np.ndarray:
            return (lengths > threshold).astype(np.float32)
        return predict

    score = predict_batch_scorer(make_predict_fn, FloatType(), batch_size=64)
    df = spark.createDataFrame([("short",), ("a much longer comment than twenty characters",)], ["text"])
    got = [r.s for r in df.select(score(F.length("text").cast("float")).alias("s")).collect()]
    assert got == [0.0, 1.0]


def test_word2vec_embedder(spark):
    from murmur.operators.enrich import embed_text, fit_text_embedder
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    model = fit_text_embedder(docs, dim=32, method="word2vec", partitions=2)
    rows = embed_text(docs, model).collect()
    assert len(rows) == docs.count() and all(len(r.embedding) == 32 for r in rows)
    norms = [sum(x * x for x in r.embedding) ** 0.5 for r in rows]
    assert all(abs(n - 1) < 1e-4 or n == 0 for n in norms)


def test_models_read_the_named_text_column(spark):
    from murmur.operators.enrich import embed_text, fit_sentiment_model, fit_text_embedder, score_sentiment_model
    docs = spark.createDataFrame([(i, f"word{i % 3} common", f"other {i}", i % 2) for i in range(12)],
                                 "doc_id long, body string, text string, label int")
    embedder = fit_text_embedder(docs, text_col="body", dim=16)
    a = {r.doc_id: r.embedding for r in embed_text(docs, embedder, text_col="body").collect()}
    renamed = docs.select("doc_id", F.col("body").alias("text"))
    b = embed_text(renamed, embedder, text_col="text")
    assert b.columns == ["doc_id", "text", "embedding"]
    assert {r.doc_id: r.embedding for r in b.collect()} == a
    model = fit_sentiment_model(docs, text_col="body", num_features=64, max_iter=5)
    out = score_sentiment_model(docs.select("doc_id", "text", F.col("body").alias("note")), model, text_col="note")
    assert out.columns == ["doc_id", "text", "note", "sentiment", "sentiment_score"]
    assert {r.text for r in out.collect()} == {f"other {i}" for i in range(12)}


def test_closed_form_models_on_empty_and_odd_rows(spark):
    from murmur.operators.enrich import embed_terms, score_sentiment_bayes
    docs = spark.createDataFrame([(1, "bad bad thing"), (2, "good thing"), (3, None), (4, ""), (5, "unseen")],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (9, 1), (3, None)], "doc_id long, label int")
    got = {r.doc_id: r.sentiment for r in score_sentiment_bayes(docs, labels).collect()}
    assert got == {1: "negative", 2: "positive", 3: "positive", 4: "positive", 5: "positive"}
    none = score_sentiment_bayes(docs, labels.limit(0)).collect()
    assert len(none) == 5 and all(r.sentiment == "positive" for r in none)
    rows = embed_terms(docs).collect()
    norm = {}
    for r in rows:
        norm[r.doc_id] = norm.get(r.doc_id, 0.0) + r.weight ** 2
    assert set(norm) == {1, 2, 5} and all(abs(n - 1) < 1e-9 for n in norm.values())
    assert embed_terms(docs.limit(0)).count() == 0


def test_lookup_join_with_heavy_keys(spark):
    """A few keys with most rows: the same rows by broadcast and dealt out."""
    from pyspark.sql import functions as F

    from murmur.functions.joins import lookup_join
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 < 2, F.lit("the")).when(F.col("id") % 7 == 0, "of")
                                    .otherwise(F.concat(F.lit("w"), (F.col("id") % 100).cast("string"))).alias("term"))
    table = rows.where("term <> 'w17'").groupBy("term").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "v", F.when(F.col("term") == "w2", F.lit(None)).otherwise(F.length("term")))
    want = sorted((r.id, r.term, r.v) for r in rows.join(table.select("term", "v"), "term").collect() if r.id is not None)
    spread = F.concat(F.lit("\0"), F.xxhash64("id").cast("string"))
    for how in ({}, {"whole_rows": 0, "heavy_keys": 2}, {"whole_rows": 0, "heavy_keys": 1000}):
        got = lookup_join(rows, table, ["term"], ["v"], "n", spread, **how)
        assert sorted(((r.id, r.term, r.v) for r in got.collect()), key=str) == sorted(want, key=str)


def test_sketch_and_linear_model(spark):
    import hashlib
    import math

    from murmur.operators.enrich import embed_sketch, fit_sentiment_linear, score_sentiment_linear
    texts = {1: "good good service", 2: "bad service", 3: "bad bad delay", 4: "good value", 5: "", 6: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: list(r.embedding) for r in embed_sketch(docs, dim=16).collect()}
    df = {"good": 2, "bad": 2, "service": 2, "delay": 1, "value": 1}
    for i, t in texts.items():
        want = [0.0] * 16
        for w in (t or "").split():
            h = hashlib.md5(w.encode()).hexdigest()
            want[int(h[:7], 16) % 16] += (1 if int(h[7], 16) % 2 == 0 else -1) * math.log(7 / (df[w] + 1))
        n = math.sqrt(sum(x * x for x in want)) or 1.0
        assert [round(x, 9) for x in got[i]] == [round(x / n, 9) for x in want]
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 0)], "doc_id long, label int")
    vectors = embed_sketch(docs, dim=16)
    model = fit_sentiment_linear(vectors.join(labels, "doc_id"))
    said = {r.doc_id: r.sentiment for r in score_sentiment_linear(vectors, *model).collect()}
    assert [said[i] for i in (1, 2, 3, 4)] == ["positive", "negative", "negative", "positive"]


def test_terms_are_counted_without_a_shuffle(spark):
    """Rows with an id of their own never move; ids that repeat or are null are added up."""
    from collections import Counter

    from pyspark.sql import functions as F

    from murmur.operators.enrich import embed_terms, term_counts
    once = spark.createDataFrame([(1, "a b a"), (2, None), (3, "B_1 ü b")], "doc_id long, text string")
    counts = term_counts(once)
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in counts.collect()) == [(1, "a", 2), (1, "b", 1), (3, "b", 1), (3, "b_1", 1)]
    rows = [(1, "a b"), (1, "a c"), (None, "x y"), (None, "x"), (2, "a z"), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter((i, w) for i, t in rows for w in t.split())
    assert {(r.doc_id, r.term): r.tf for r in term_counts(docs).collect()} == want
    assert {(r.doc_id, r.term): round(r.weight, 9) for r in embed_terms(docs).collect()}.keys() == want.keys()
    norms = embed_terms(docs).groupBy("doc_id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert len(norms) == 3 and all(abs(r.n - 1) < 1e-9 for r in norms)


def test_rows_of_heavy_keys_stay_where_they_are(spark):
    from pyspark.sql import functions as F

    from murmur.functions.joins import lookup_join
    rows = spark.range(1000).select("id", F.when(F.col("id") % 10 < 9, "the").otherwise(F.col("id").cast("string")).alias("term"))
    table = rows.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("v"))
    out = lookup_join(rows.withColumn("part", F.spark_partition_id()), table, ["term"], ["v"], "n", whole_rows=0, heavy_keys=1)
    moved = out.where(F.spark_partition_id() != F.col("part")).groupBy("term").count().where("term = 'the'").count()
    assert out.count() == 1000 and moved == 0


def test_linear_fit_equals_numpy_over_many_dimensions(spark):
    import numpy as np

    from murmur.operators.enrich import fit_sentiment_linear
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(3000, 40)) / 6, rng.integers(0, 2, 3000)
    table = spark.createDataFrame([(list(map(float, a)), int(b)) for a, b in zip(x, y)] + [([0.5] * 40, 7)],
                                  "embedding array<double>, label int").repartition(3)
    weights, bias = fit_sentiment_linear(table, rounds=4, rate=8.0)
    w, b = np.zeros(40), 0.0
    for _ in range(4):
        off = 1 / (1 + np.exp(-(x @ w + b))) - y
        w, b = w - 8 / 3000 * (off @ x), b - 8 / 3000 * off.sum()
    assert np.allclose(weights, w) and abs(bias - b) < 1e-12
