"""The registered queries, against DuckDB where they have SQL, and the
pipeline against its stages run one by one."""

import glob
import os

import duckdb
import pytest
from conftest import SF001

import __spark_entry__ as ent
import corpus_pipeline as cp
from murmur.llm import pii, simhash
from murmur.llm.queries import ORACLE, QUERIES
from tools.oracle_check import _rows


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF001}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_registered():
    names = set(ent.queries())
    assert {f"op{i}" for i in range(1, 14)} == {n.split("_")[0] for n in QUERIES} and set(QUERIES) <= names
    assert "pipeline" in names and set(ORACLE) <= set(ent.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, name):
    got = QUERIES[name](spark, SF001)
    res = con.execute(ORACLE[name])
    cols = [d[0] for d in res.description]
    assert sorted(got.columns) == sorted(cols)
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(cols, res.fetchall())


def test_packed_sequences_follow_the_mixture(spark):
    """Prefixes of the sequences keep the target shares, in whatever order the
    documents are read."""
    rows = [(i, "word " * (99, 399, 699)[i % 3], "ab"[i >= 900], 1) for i in range(1200)]
    rows += [(None, "x", "a", 1), (5000, "word " * 5000, "b", 1), (5000, "", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = cp.packing(spark, docs, SF001).collect()
    ends = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 2048 and sorted(ends) == list(range(len(ends)))
    assert sorted({(str(r["doc_id"]), r["piece"]) for r in got}) == sorted(
        {(str(i), 0) for i, *_ in rows} | {("5000", 1), ("5000", 2)})
    target = 300 ** 0.7 / (300 ** 0.7 + 900 ** 0.7)
    for part in (0.2, 0.4, 0.6):
        ids = [r["doc_id"] for r in got if r["sequence_id"] < part * len(ends) and (r["doc_id"] or 0) < 1200]
        assert abs(sum((i or 0) >= 900 for i in ids) / len(ids) - target) < 0.06


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    first = {r["doc_id"]: r for r in docs.collect()}
    kept = docs
    seen = {}
    for name, stage in cp.STAGES[:-1]:
        kept = stage(spark, kept, SF001)
        assert kept.columns == docs.columns
        seen[name] = [r.asDict() for r in kept.collect()]
        kept = spark.createDataFrame(seen[name], docs.schema)
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF001}/labels.parquet").where("toxic = 1").collect()}
    clean = {r["doc_id"] for r in spark.read.parquet(f"{SF001}/labels.parquet").where("toxic = 0").collect()}
    left = {r["doc_id"] for r in seen["toxicity"]}
    assert len(clean - left) <= 0.02 * len(clean) and len(toxic & left) <= 0.3 * len(toxic)
    groups = {}
    for r in seen["toxicity"]:
        groups.setdefault(simhash.fingerprint(r["text"]), []).append(r["doc_id"])
    assert {min(g) for g in groups.values()} >= {r["doc_id"] for r in seen["near_dedup"]}
    texts = {r["doc_id"]: r for r in seen["pii"]}
    a = pii.anchors()
    for i, r in texts.items():
        assert r["text"] == pii.mask_text(first[i]["text"], pii.find_spans(first[i]["text"], a))
        assert r["n_chars"] == len(r["text"])
    assert sorted(map(str, seen["mixing"])) == sorted(map(str, seen["pii"]))
    packed = cp.STAGES[-1][1](spark, kept, SF001).collect()
    assert {r["doc_id"] for r in packed} == set(texts)
    whole = cp.run(spark, SF001).collect()
    assert sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in whole) == sorted(
        (r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in packed)
