"""Toxicity by a character n-gram linear classifier with naive Bayes features.

Features are the character n-grams a lower-cased text holds (presence, not
counts), hashed to a fixed number of buckets per length. Their document
counts by label give smoothed log-count ratios; every feature whose ratio is
``min_z`` standard errors or more from 0 is kept, scaled by its ratio, and
weighted by Spark's L2 logistic regression on sparse rows; only weights, at
most one a bucket, reach the driver. All of it is learnt from labelled rows only, from a bounded sample
of them (``max_rows_per_label``, drawn by a hash of the id); every text is then
scored whole in one pass over the table, without a shuffle.

Input cases: null is empty text; an empty text has no features and its score
is the base rate's; very long texts are read piece by piece with overlap, and
no n-gram is lost; repeated ids among labels count once, with the highest label;
labels that are null are no labels; without rows of both labels every score is
0; an empty table gives no rows; further input columns are ignored by
:func:`score_toxicity` and kept by :func:`drop_toxic`."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from murmur.llm._common import by_value, narrow, parts, texts
from murmur.session import arrow_batches, cut_lineage

by_value(__name__)

SIZES = (3, 4, 5, 6)
BUCKET_BITS = 18
MAX_ROWS_PER_LABEL = 8_000
MIN_Z = 4.0
FIT_TASKS = 16
L2 = 1.0
PIECE_CHARS = 1 << 18
BATCH_ROWS = 512      # texts sent to a worker at a time
FOLDS = 5


def held_out(id_col: str) -> Column:
    """Rows whose label is never learnt from: crc32(id as text) mod 5 is 0."""
    return F.crc32(F.col(id_col).cast("string")) % FOLDS == 0


# --- features ----------------------------------------------------------------------
def _pieces(batch: list[str]):
    """(document number, characters) of texts, long ones cut with overlap,
    gathered to arrays of about PIECE_CHARS characters."""
    docs, lines, size = [], [], 0
    step = PIECE_CHARS - max(SIZES)
    for i, text in enumerate(batch):
        line = f" {text.lower()} "
        for at in range(0, max(1, len(line) - max(SIZES) + 1), step):
            cut = line[at:at + PIECE_CHARS]
            docs.append(i)
            lines.append(cut)
            size += len(cut)
            if size >= PIECE_CHARS:
                yield docs, lines
                docs, lines, size = [], [], 0
    if docs:
        yield docs, lines


def _hits(batch: list[str], wanted: np.ndarray | None):
    """(document number, feature) arrays: every n-gram, or those whose
    feature is ``wanted``; may repeat."""
    for docs, lines in _pieces(batch):
        chars = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ends = np.cumsum([len(x) for x in lines])
        docs = np.asarray(docs)
        rolled = chars.copy()
        for n in range(2, max(SIZES) + 1):
            if len(chars) < n:
                break
            rolled = rolled[:-1] * np.uint32(0x01000193) + chars[n - 1:]
            if n not in SIZES:
                continue
            feature = ((rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)
            feature = feature.astype(np.int32)
            base = SIZES.index(n) << BUCKET_BITS
            at = (np.arange(len(feature)) if wanted is None
                  else np.flatnonzero(wanted[base:base + (1 << BUCKET_BITS)][feature]))
            piece = np.searchsorted(ends, at, side="right")
            inside = at + n <= ends[piece]
            at, piece = at[inside], piece[inside]
            yield docs[piece], feature[at] + base


def present(batch: list[str], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document number, feature), each pair once, of the wanted features."""
    width = len(SIZES) << BUCKET_BITS
    keys = [np.unique(d.astype(np.int64) * width + f) for d, f in _hits(batch, wanted)]
    key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, dtype=np.int64)
    return key // width, (key % width).astype(np.int64)


# --- model -------------------------------------------------------------------------
@dataclass
class ToxicityModel:
    """Weight of every feature bucket (0: not used) and the intercept."""
    weight: np.ndarray
    intercept: float
    constant: float | None = None

    def scores(self, batch: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(batch), self.constant)
        doc, feature = present(batch, self.weight != 0)
        total = np.bincount(doc, weights=self.weight[feature], minlength=len(batch)) + self.intercept
        return 1.0 / (1.0 + np.exp(-np.clip(total, -500, 500)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 label_col: str = "toxic", max_rows_per_label: int = MAX_ROWS_PER_LABEL,
                 min_z: float = MIN_Z, l2: float = L2) -> ToxicityModel:
    """Learn from the labelled rows that are not held out. At most
    ``max_rows_per_label`` rows of each label are read for it (the bound that
    the contract allows for fitting a classifier). The regression adds up its
    bounded sample in one partition, so equal tables give equal weights."""
    with arrow_batches(docs.sparkSession, BATCH_ROWS):
        return _fit(docs, labels, id_col, text_col, label_col, max_rows_per_label, min_z, l2)


def _fit(docs, labels, id_col, text_col, label_col, max_rows_per_label, min_z, l2) -> ToxicityModel:
    known = narrow(labels, id=F.col(id_col).cast("long"), y=F.col(label_col).cast("int")).where(
        "id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y")).where(~held_out("id"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    width = len(SIZES) << BUCKET_BITS
    if len(sizes) < 2:
        return ToxicityModel(np.zeros(width), 0.0, constant=0.0)
    # bounded by 2 * max_rows_per_label ids
    drawn = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(max_rows_per_label) for y in (0, 1)]
    ids = drawn[0].unionByName(drawn[1])
    own = narrow(docs, id=F.col(id_col).cast("long"), text=F.coalesce(F.col(text_col), F.lit("")))
    # sorted here, while the rows are texts: the wide rows of the regression keep this order
    sample = cut_lineage(own.join(F.broadcast(ids), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
                         .repartitionByRange(FIT_TASKS, "id").sortWithinPartitions("id"))

    def count(batches):
        counts = np.zeros((2, width), dtype=np.int32)
        for batch in batches:
            ys = batch.column("y").to_pylist()
            for i, text in enumerate(texts(batch, "text")):
                seen = np.zeros(width, dtype=bool)
                for _, f in _hits([text], None):
                    seen[f] = True
                counts[ys[i]] += seen
        at = np.flatnonzero(counts.any(axis=0))
        for i in range(0, len(at), 1 << 16):
            k = at[i:i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(counts[1][k], pa.int32()),
                                              pa.array(counts[0][k], pa.int32())], names=["feature", "pos", "neg"])

    totals = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return ToxicityModel(np.zeros(width), 0.0, constant=0.0)
    p, q = (F.col("pos") + 1.0) / F.lit(totals[1] + 2.0), (F.col("neg") + 1.0) / F.lit(totals[0] + 2.0)
    ratio = F.log(p / q)
    z = ratio / F.sqrt((1 - p) / (F.col("pos") + 1.0) + (1 - q) / (F.col("neg") + 1.0))
    chosen = (sample.mapInArrow(count, "feature int, pos int, neg int").groupBy("feature")
              .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
              .select("feature", ratio.alias("r"), F.abs(z).alias("z")).where(F.col("z") >= min_z)
              .collect())   # at most one row a bucket
    scale = np.zeros(width)
    for r in chosen:
        scale[r["feature"]] = r["r"]
    wanted = scale != 0
    used = np.flatnonzero(wanted)
    weight = {y: sizes[y] / totals[y] for y in (0, 1)}   # back to the rates of all labels
    if not len(used):
        rate = sizes[1] / (sizes[0] + sizes[1])
        return ToxicityModel(np.zeros(width), float(np.log(rate / (1 - rate))))

    def features(batches):
        for batch in batches:
            for some in parts(batch, 256):
                doc, feature = present(texts(some, "text"), wanted)
                cut = pa.array(np.searchsorted(doc, np.arange(some.num_rows + 1)).astype(np.int32))
                at, value = np.searchsorted(used, feature).astype(np.int32), scale[feature]
                sparse = pa.StructArray.from_arrays(   # Spark's stored form of a sparse vector
                    [pa.array(np.zeros(some.num_rows, dtype=np.int8)),
                     pa.array(np.full(some.num_rows, len(used), dtype=np.int32)),
                     pa.ListArray.from_arrays(cut, pa.array(at)), pa.ListArray.from_arrays(cut, pa.array(value))],
                    names=["type", "size", "indices", "values"])
                yield pa.RecordBatch.from_arrays([some.column("id"), some.column("y"), sparse],
                                                 names=["id", "y", "features"])

    made = StructType([StructField("id", LongType()), StructField("y", IntegerType()),
                       StructField("features", VectorUDT())])
    # at most 2 * max_rows_per_label sparse rows, worked out in FIT_TASKS tasks and stored by id;
    # the regression's task reads them one after the other and holds no copy for a sort
    rows = cut_lineage(
        sample.mapInArrow(features, made)
        .select("id", F.col("y").cast("double").alias("label"), "features",
                F.when(F.col("y") == 1, weight[1]).otherwise(weight[0]).alias("weight"))).coalesce(1)
    fit = LogisticRegression(weightCol="weight", standardization=False, regParam=l2 / (sizes[0] + sizes[1]),
                             maxIter=200, tol=1e-7).fit(rows)
    full = np.zeros(width)
    full[used] = fit.coefficients.toArray() * scale[used]
    return ToxicityModel(full, float(fit.intercept))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row, from its text alone; stored."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for some in parts(batch, 512):
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), pa.array(model.scores(texts(some, "text")))], names=["doc_id", "score"])

    with arrow_batches(docs.sparkSession, BATCH_ROWS):
        return cut_lineage(narrow(docs, doc_id=id_col, text=text_col).mapInArrow(run, f"doc_id {kind}, score double"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, unchanged; stored."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for some in parts(batch, 512):
                old = ["" if t is None else t for t in some.column(at).to_pylist()]
                yield some.filter(pa.array(model.scores(old) < threshold))

    with arrow_batches(docs.sparkSession, BATCH_ROWS):
        return cut_lineage(docs.mapInArrow(run, docs.schema))
