"""Row enrichment: severity (E1), sentiment (E2), text embedding (E3),
unit-norm vectors (E4) and cosine to a vector (E5).

E1, the lexicon E2, E4 and E5 are native expressions inside whole-stage
codegen. The Spark ML variants of E2/E3 are pipelines fitted and applied as
distributed jobs; an external model plugs in through ``predict_batch_udf``."""

from __future__ import annotations

import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions import lexicon as lx
from murmur.functions import vectors as vx
from murmur.functions.joins import lookup_of
from murmur.functions.text import contains_any, count_present
from murmur.session import cut_lineage

# the vector functions run in Python workers: ship them by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# --- E1 ----------------------------------------------------------------------
def severity_label(text: Column, high_words=lx.HIGH_SEVERITY_WORDS, medium_words=lx.MEDIUM_SEVERITY_WORDS,
                   delay_pattern: str = lx.DELAY_PATTERN, delay_phrases=lx.DELAY_PHRASES) -> Column:
    t = F.lower(text)
    return (
        F.when(contains_any(t, high_words), F.lit("HIGH"))
        # (?U): Unicode \d and \b, as in Python's re
        .when(t.rlike("(?U)" + delay_pattern), F.lit("HIGH"))
        .when(contains_any(t, delay_phrases), F.lit("HIGH"))
        .when(contains_any(t, medium_words), F.lit("MEDIUM"))
        .otherwise(F.lit("LOW"))
    )


def severity_score_of(label: Column) -> Column:
    return (
        F.when(label == "HIGH", F.lit(lx.SEVERITY_SCORES["HIGH"]))
        .when(label == "MEDIUM", F.lit(lx.SEVERITY_SCORES["MEDIUM"]))
        .otherwise(F.lit(lx.SEVERITY_SCORES["LOW"]))
    )


def detect_severity(df: DataFrame, text_col: str = "text", **rules) -> DataFrame:
    """Adds ``severity`` (HIGH/MEDIUM/LOW) and ``severity_score`` (1.0/0.6/0.3)."""
    df = df.withColumn("severity", severity_label(F.col(text_col), **rules))
    return df.withColumn("severity_score", severity_score_of(F.col("severity")))


# --- E2 ----------------------------------------------------------------------
def score_sentiment(df: DataFrame, text_col: str = "text", negative_words=lx.NEGATIVE_WORDS,
                    positive_words=lx.POSITIVE_WORDS) -> DataFrame:
    """Default deterministic scorer: counts listed words present as substrings
    of the lower-cased text. ``negative`` when negatives outnumber positives,
    else ``positive``; confidence 0.5 + 0.5*|neg-pos|/(neg+pos), 0.5 on no hit."""
    t = F.lower(F.col(text_col))
    neg, pos = count_present(t, negative_words), count_present(t, positive_words)
    hits = neg + pos
    return df.withColumns({
        "sentiment": F.when(neg > pos, F.lit("negative")).otherwise(F.lit("positive")),
        "sentiment_score": F.when(hits > 0, F.lit(0.5) + F.lit(0.5) * F.abs(neg - pos) / hits)
        .otherwise(F.lit(0.5)),
    })


def fit_sentiment_model(train: DataFrame, text_col: str = "text", label_col: str = "label",
                        num_features: int = 1 << 18, max_iter: int = 50):
    """Spark ML scorer: Tokenizer -> HashingTF -> IDF -> LogisticRegression,
    fitted on a labelled table (label 1 = negative). Distributed fit."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer

    stages = [
        RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern="\\W+", toLowercase=True),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="_feat"),
        LogisticRegression(featuresCol="_feat", labelCol=label_col, maxIter=max_iter,
                           probabilityCol="_prob", rawPredictionCol="_raw", predictionCol="_pred"),
    ]
    return Pipeline(stages=stages).fit(train.select(text_col, F.col(label_col).cast("double").alias(label_col)))


def score_sentiment_model(df: DataFrame, model, text_col: str = "text") -> DataFrame:
    """Apply a fitted sentiment pipeline: ``sentiment`` = negative/positive,
    ``sentiment_score`` = probability of the chosen class."""
    from pyspark.ml.functions import vector_to_array

    out = _with_model_input(df, model, text_col, lambda d: model.transform(d))
    prob = vector_to_array(F.col("_prob"))
    out = out.withColumns({
        "sentiment": F.when(F.col("_pred") == 1.0, F.lit("negative")).otherwise(F.lit("positive")),
        "sentiment_score": F.array_max(prob),
    })
    return out.drop("_tok", "_tf", "_feat", "_prob", "_raw", "_pred")


def _with_model_input(df: DataFrame, model, text_col: str, apply) -> DataFrame:
    """Run a fitted text pipeline on ``text_col`` whatever the column was
    called when it was fitted; the caller's columns keep their names."""
    fitted = model.stages[0].getInputCol()
    if text_col == fitted:
        return apply(df)
    kept = [c for c in df.columns if c != fitted]
    aside = df.withColumnRenamed(fitted, "_aside") if fitted in df.columns else df
    out = apply(aside.withColumn(fitted, F.col(f"`{text_col}`"))).drop(fitted)
    out = out.withColumnRenamed("_aside", fitted) if fitted in df.columns else out
    return out.select(*df.columns, *[c for c in out.columns if c not in df.columns]) if kept else out


# --- closed-form text models: term counts as tables -----------------------------
HEAVY_TERMS = 100_000   # broadcast; over nine in ten of the term counts of a large corpus


def _row_counts(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...]) -> DataFrame:
    """(id, carried columns, term, tf) counted inside each row, without a shuffle."""
    kept = [id_col, *carry]
    words = re.compile("[a-z0-9_]+").findall

    def count(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                some = batch.slice(start, 256)
                at, terms, tf = [], [], []
                for i, text in enumerate(some.column("_text").to_pylist()):
                    found = Counter(words(text or ""))
                    at.extend([i] * len(found))
                    terms.extend(found)
                    tf.extend(found.values())
                rows = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [some.column(k).take(rows) for k in range(len(kept))]
                    + [pa.array(terms, pa.string()), pa.array(tf, pa.int64())], names=[*some.schema.names[:-1], "term", "tf"])

    own = docs.select(*[F.col(c).alias(f"_c{k}") for k, c in enumerate(kept)], F.lower(F.col(text_col)).alias("_text"))
    kinds = "".join(f"_c{k} {docs.schema[c].dataType.simpleString()}, " for k, c in enumerate(kept))
    return own.mapInArrow(count, kinds + "term string, tf long").select(
        *[F.col(f"_c{k}").alias(c) for k, c in enumerate(kept)], "term", "tf")


def _repeated_ids(docs: DataFrame, id_col: str) -> DataFrame | None:
    """The ids of several rows (``_again``), stored; None if there are none."""
    found = cut_lineage(docs.groupBy(F.col(id_col).alias("_again")).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1"))
    return None if found.isEmpty() else found


def term_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, term, tf): lower-cased runs of word characters, counted per id.
    ``carry`` adds columns that are equal in all rows of an id. Only rows that
    share their id are added up over a shuffle."""
    own = docs.select(id_col, text_col, *carry)
    repeated = _repeated_ids(own, id_col)
    if repeated is None:
        return _row_counts(own, id_col, text_col, carry).select(id_col, *carry, "term", "tf")
    marked = own.join(repeated, F.col(id_col).eqNullSafe(F.col("_again")), "left")
    once = _row_counts(marked.where("_rows is null"), id_col, text_col, carry)
    again = _row_counts(marked.where("_rows is not null"), id_col, text_col, carry)
    return once.unionByName(again.groupBy(id_col, *carry, "term").agg(F.sum("tf").alias("tf")))


def _weighted_terms(docs: DataFrame, id_col: str, text_col: str):
    """A function from term counts of these documents to their rows with ``w``,
    tf-idf with idf = ln((N + 1) / (df + 1)), without terms of weight zero
    (those in every row); and the counts."""
    counts = term_counts(docs, id_col, text_col)
    total = docs.select(F.count(F.lit(1))).scalar()
    spread = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((total + 1) / (F.col("df") + 1))
    find = lookup_of(spread.withColumn("idf", idf), ["term"], ["idf"], "df", heavy_keys=HEAVY_TERMS)
    return lambda c: find(c).withColumn("w", F.col("tf") * F.col("idf")).drop("tf", "idf").where("w > 0"), counts


def embed_terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """E3 in sparse form: (id, term, weight) of unit-norm tf-idf rows, idf =
    ln((N + 1) / (df + 1)). A term in every row weighs nothing and is left out.
    Norms are joined to the texts and the terms weighed again, so the long
    table of weights is never shuffled."""
    weigh, counts = _weighted_terms(docs, id_col, text_col)
    norms = cut_lineage(weigh(counts).groupBy(F.col(id_col).alias("_of")).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_n")))
    normed = docs.select(id_col, text_col).join(norms, F.col(id_col).eqNullSafe(F.col("_of")))
    return weigh(term_counts(normed, id_col, text_col, ("_n",))).select(
        id_col, "term", (F.col("w") / F.col("_n")).alias("weight"))


SKETCH_DIM = 384


def sketch_place(term: Column, dim: int) -> tuple[Column, Column]:
    """Dimension and sign of a term, from its MD5."""
    digest = F.md5(term)
    place = F.conv(F.substring(digest, 1, 7), 16, 10).cast("long") % dim
    sign = F.when(F.conv(F.substring(digest, 8, 1), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    return place.cast("int"), sign


def embed_sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dim: int = SKETCH_DIM,
                 out_col: str = "embedding") -> DataFrame:
    """E3 in dense form: (id, embedding) of every row, a unit-norm signed feature
    sketch of its tf-idf weights: each term adds its weight, with a sign, to one
    of ``dim`` dimensions, so dot products are unbiased. Rows without terms
    are zero vectors. Rows that repeat an id are one text."""
    place, sign = sketch_place(F.col("term"), dim)
    weigh, counts = _weighted_terms(docs, id_col, text_col)
    # one shuffle, by id, serves both sums and the join
    parts = weigh(counts).select(id_col, place.alias("_d"), (F.col("w") * sign).alias("_s")).repartition(id_col)
    filled = parts.groupBy(id_col, "_d").agg(F.sum("_s").alias("_s")).groupBy(id_col).agg(
        F.collect_list(F.struct("_d", "_s")).alias("_m"))

    def fill(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                places = some.column("_m")
                row = np.repeat(np.arange(some.num_rows), places.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                flat = places.flatten()
                dense = np.zeros((some.num_rows, dim))
                dense[row, flat.field("_d").to_numpy(zero_copy_only=False)] = flat.field("_s").to_numpy(zero_copy_only=False)
                norm = np.sqrt((dense * dense).sum(axis=1, keepdims=True))
                dense /= np.where(norm > 0, norm, 1.0)
                cuts = pa.array(np.arange(some.num_rows + 1, dtype=np.int32) * dim)
                yield pa.RecordBatch.from_arrays(
                    [some.column("_id"), pa.ListArray.from_arrays(cuts, pa.array(dense.ravel()))], names=["_id", "_e"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id")).distinct().join(filled.withColumnRenamed(id_col, "_id"), "_id", "left")
    return rows.mapInArrow(fill, f"_id {kind}, _e array<double>").select(
        F.col("_id").alias(id_col), F.col("_e").alias(out_col))


def fit_sentiment_linear(train: DataFrame, vec_col: str = "embedding", label_col: str = "label", rounds: int = 8,
                         rate: float = 32.0) -> tuple[list[float], float]:
    """Logistic regression by a fixed number of gradient steps, each one
    aggregate over all labelled rows, added up inside the tasks first:
    (weights, intercept). Only the weights reach the driver. Label 1 =
    negative; other labels take no part."""
    rows = cut_lineage(train.where(F.col(label_col).isin(0, 1)).select(
        F.col(vec_col).alias("_x"), F.col(label_col).cast("double").alias("_y")))
    n, dim = rows.agg(F.count(F.lit(1)), F.max(F.size("_x"))).first()
    weights, bias = np.zeros(dim or 0), 0.0

    def gradient(weights, bias):
        def run(batches):
            total = np.zeros(len(weights) + 1)
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    some = batch.slice(at, 1024)
                    x = some.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, len(weights))
                    off = 1.0 / (1.0 + np.exp(-(x @ weights + bias))) - some.column("_y").to_numpy(zero_copy_only=False)
                    total[:-1] += off @ x
                    total[-1] += off.sum()
            yield pa.RecordBatch.from_arrays([pa.array([total])], names=["g"])
        return run

    for _ in range(rounds if n else 0):
        steps = (rows.where("_x is not null").mapInArrow(gradient(weights, bias), "g array<double>")
                 .select(F.posexplode("g").alias("_d", "_v")).groupBy("_d").agg(F.sum("_v").alias("g"))
                 .collect())   # one row a dimension
        step = np.zeros(dim + 1)
        for r in steps:
            step[r["_d"]] = r["g"] * (rate / n)
        weights, bias = weights - step[:-1], bias - step[-1]
    return [float(w) for w in weights], float(bias)


def linear_probability(vec: Column, weights, bias: float) -> Column:
    """Probability of label 1 of a linear model."""
    products = F.zip_with(vec, F.array(*[F.lit(float(w)) for w in weights]), lambda x, w: x * w)
    return 1.0 / (1.0 + F.exp(-(F.aggregate(products, F.lit(0.0), lambda s, x: s + x) + F.lit(float(bias)))))


def score_sentiment_linear(df: DataFrame, weights, bias: float, vec_col: str = "embedding") -> DataFrame:
    """Adds ``sentiment`` and ``sentiment_score`` (probability of the chosen class)."""
    p = linear_probability(F.col(vec_col), weights, bias)
    return df.withColumn("_p", p).withColumns({
        "sentiment": F.when(F.col("_p") > 0.5, "negative").otherwise("positive"),
        "sentiment_score": F.greatest("_p", 1.0 - F.col("_p"))}).drop("_p")


def score_sentiment_bayes(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          label_col: str = "label") -> DataFrame:
    """E2 by multinomial naive Bayes with add-one smoothing, closed form over
    term counts: (id, sentiment, sentiment_score) of every row; ``labels``
    holds (id, label), 1 = negative. Terms never seen in training count for
    nothing; rows without terms get the prior."""
    known = labels.where(F.col(label_col).isin(0, 1)).select(id_col, F.col(label_col).alias("_y"))
    # labels go to the texts, before these become long tables of terms
    marks = known.groupBy(id_col).agg(F.count_if(F.col("_y") == 1).alias("_k1"), F.count_if(F.col("_y") == 0).alias("_k0"))
    by_term = cut_lineage(term_counts(docs.select(id_col, text_col).join(marks, id_col), id_col, text_col, ("_k1", "_k0"))
                          .groupBy("term").agg(F.sum(F.col("tf") * F.col("_k1")).alias("n1"),
                                               F.sum(F.col("tf") * F.col("_k0")).alias("n0"),
                                               F.sum(F.col("_k1") + F.col("_k0")).alias("rows")))
    totals = by_term.select(F.struct(F.sum("n1").alias("t1"), F.sum("n0").alias("t0"),
                                     F.count(F.lit(1)).alias("v"))).scalar()
    prior = known.join(docs.select(id_col), id_col).select(F.log(
        (F.sum("_y") + 1.0) / (F.count(F.lit(1)) - F.sum("_y") + 1.0))).scalar()
    ratio = (F.log((F.col("n1") + 1.0) / (totals["t1"] + totals["v"]))
             - F.log((F.col("n0") + 1.0) / (totals["t0"] + totals["v"])))
    find = lookup_of(by_term.withColumn("_r", ratio), ["term"], ["_r"], "rows", heavy_keys=HEAVY_TERMS)
    found = find(term_counts(docs, id_col, text_col))
    sums = found.groupBy(id_col).agg(F.sum(F.col("tf") * F.col("_r")).alias("_s"))
    p = 1.0 / (1.0 + F.exp(-F.col("_z")))
    return (docs.select(id_col).join(sums, id_col, "left")
            .withColumn("_z", F.coalesce("_s", F.lit(0.0)) + F.coalesce(prior, F.lit(0.0)))
            .select(id_col, F.when(F.col("_z") > 0, "negative").otherwise("positive").alias("sentiment"),
                    F.greatest(p, 1.0 - p).alias("sentiment_score")))


# --- E3 ----------------------------------------------------------------------
def fit_text_embedder(corpus: DataFrame, text_col: str = "text", dim: int = 384, method: str = "tfidf",
                      min_count: int = 2, partitions: int | None = None, seed: int = 42):
    """Spark ML embedder, no download, fitted on the corpus as distributed jobs.

    ``tfidf``: RegexTokenizer -> HashingTF(dim) -> IDF (document frequencies).
    ``word2vec``: RegexTokenizer -> Word2Vec(vectorSize=dim); a text's vector
    is the mean of its word vectors. ``partitions`` parallelises training
    (default: the session's default parallelism)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, Word2Vec

    tok = RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern="\\W+", toLowercase=True)
    if method == "tfidf":
        stages = [tok, HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim),
                  IDF(inputCol="_tf", outputCol="_vec")]
    elif method == "word2vec":
        parts = partitions or corpus.sparkSession.sparkContext.defaultParallelism
        stages = [tok, Word2Vec(inputCol="_tok", outputCol="_vec", vectorSize=dim, minCount=min_count,
                                numPartitions=parts, seed=seed)]
    else:
        raise ValueError(f"unknown embedding method: {method}")
    return Pipeline(stages=stages).fit(corpus.select(text_col))


def embed_text(df: DataFrame, model, text_col: str = "text", out_col: str = "embedding") -> DataFrame:
    """Adds a unit-norm ``array<float>`` embedding from a fitted embedder."""
    from pyspark.ml.functions import vector_to_array

    out = _with_model_input(df, model, text_col, lambda d: model.transform(d))
    out = out.withColumn(out_col, vx.l2_normalize(vector_to_array(F.col("_vec"))).cast("array<float>"))
    return out.drop("_tok", "_tf", "_vec")


def predict_batch_scorer(make_predict_fn, return_type, batch_size: int = 256, input_tensor_shapes=None):
    """Hook for an external model (sentiment or embedding): wraps
    ``pyspark.ml.functions.predict_batch_udf`` so the model is loaded once per
    Python worker and fed Arrow batches."""
    from pyspark.ml.functions import predict_batch_udf

    return predict_batch_udf(make_predict_fn, return_type=return_type, batch_size=batch_size,
                             input_tensor_shapes=input_tensor_shapes)


# --- E4 / E5 -------------------------------------------------------------------
def l2_normalize(df: DataFrame, vec_col: str = "embedding", out_col: str | None = None) -> DataFrame:
    """Unit-norm vectors (double); zero vectors stay zero."""
    return df.withColumn(out_col or vec_col, vx.l2_normalize(vec_col))


def cosine_to_vector(df: DataFrame, vec_col: str, target, out_col: str = "similarity") -> DataFrame:
    """Cosine similarity of each row's vector to one vector (a column or a
    Python sequence of numbers)."""
    if not isinstance(target, Column):
        target = F.array(*[F.lit(float(x)) for x in target])
    return df.withColumn(out_col, vx.cosine(vec_col, target))
