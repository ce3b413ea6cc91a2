"""Property tests: Python string semantics and numpy rounding reproduced by
native Spark expressions. Each example is a batch of values, one Spark job."""

import datetime as dt

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from murmur.functions.numeric import np_round, whole_days_between
from murmur.functions.text import py_strip
from murmur.sources.segment import text_lines_feedback

WS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0   　"
texts = st.lists(st.text(alphabet=st.sampled_from(list("ab ,.é٣") + list(WS)), max_size=30), min_size=1, max_size=60)
SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(texts)
def test_strip_matches_python(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    got = {r.i: r.s for r in df.select("i", py_strip("t").alias("s")).collect()}
    assert [got[i] for i in range(len(values))] == [v.strip() for v in values]


@SETTINGS
@given(texts)
def test_lines_match_splitlines(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, text string")
    got = {}
    for r in text_lines_feedback(df).collect():
        got.setdefault(r.doc_id, []).append((int(r.id), r.text))
    for i, v in enumerate(values):
        assert [t for _, t in sorted(got.get(i, []))] == [x.strip() for x in v.splitlines() if x.strip()]


@SETTINGS
@given(st.lists(st.floats(min_value=0, max_value=1, allow_nan=False), min_size=1, max_size=200))
def test_np_round_matches_numpy(spark, values):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, x double")
    got = {r.i: r.r for r in df.select("i", np_round("x").alias("r")).collect()}
    assert [got[i] for i in range(len(values))] == [float(round(np.float64(v), 3)) for v in values]


def test_whole_days_floor(spark):
    rows = [(dt.datetime(2024, 1, 1, 23, 0), dt.datetime(2024, 1, 2, 1, 0), 0),
            (dt.datetime(2024, 1, 1, 0, 0), dt.datetime(2024, 1, 3, 0, 0), 2),
            (dt.datetime(2024, 1, 1, 12, 0), dt.datetime(2024, 1, 3, 11, 59, 59), 1)]
    df = spark.createDataFrame(rows, "a timestamp, b timestamp, d int")
    assert all(r.got == r.d for r in df.select("d", whole_days_between(F.col("a"), F.col("b")).alias("got")).collect())


def test_theme_edges(spark):
    from murmur.functions import lexicon as lx
    from murmur.operators.insights import score_clusters
    d = dt.datetime(2024, 1, 1)
    texts = {
        0: ["upload is slow", "very slow upload"],                  # 'load' inside 'upload': startup theme
        1: ["support sent a reply", "no reply from support yet"],   # reply counts for summary, not impact
        2: ["Upload crashed", "pdf crash on upload"],               # upload + crash + pdf
    }
    rows, pos = [], 0
    for c, ts in texts.items():
        for t in ts:
            rows.append((pos, str(pos), t, "s", d, "negative", "LOW", 0.3, c))
            pos += 1
    df = spark.createDataFrame(rows, "pos long, id string, text string, source string, date timestamp, "
                                     "sentiment string, severity string, severity_score double, cluster int")
    got = {r.cluster: r for r in score_clusters(df).collect()}
    assert got[0].theme == "SLOW_STARTUP"
    assert got[1].theme == "SUPPORT_DELAY"
    assert got[1].customer_impact == lx.THEME_IMPACT["GENERIC"]
    assert got[2].theme == "UPLOAD_FAILURE"
    assert got[2].observed_pattern == lx.THEME_PATTERN["UPLOAD_FAILURE"] % "s"


_PIECES = ["• ", "●", "- ", "– ", "—", "‣ ", "1. ", "12) ", "٣. ", "3.", "Hello", "world", "Again", "x", "ok",
           ". ", "! ", "? ", ".", "?  ", " ", "\t", " ", "\xa0", "Z", "a", "é", "\r\n", "\n", "\r", "42"]
pages = st.lists(st.lists(st.sampled_from(_PIECES), max_size=40).map("".join), min_size=1, max_size=25)


@SETTINGS
@given(pages)
def test_page_cleaning_matches_python(spark, texts):
    from test_segment import python_pages
    from murmur.sources.segment import page_line_feedback
    page_list = [(i + 1, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(1, p, t) for p, t in page_list], "doc_id long, page_no int, text string")
    got = sorted(((r.id, r.text, r.source) for r in page_line_feedback(df).collect()), key=lambda x: int(x[0]))
    assert got == python_pages(page_list)


def test_timeline_sf0001(spark):
    from conftest import SF001
    from murmur.operators.report import feedback_timeline
    from murmur.plans.fixtures import feedback_fixture
    tl = feedback_timeline(feedback_fixture(spark, SF001)).collect()
    assert len(tl) == 30 and min(r["count"] for r in tl) == 20 and max(r["count"] for r in tl) == 50


_SEV_PIECES = ["crash", "Crashing", "freeze", "can't", "can’t", "unable", "fail", "failure", "slow", "too many",
               "too long", "Painfully", "days", "week", "weeks", "hour", "hours", "several days", "almost a week",
               "3", "12", "٣", "x3", "3x", " ", "  ", "\t", "\xa0", " ", ".", ",", "-", "_", "a", "support", "holidays"]
sev_texts = st.lists(st.lists(st.sampled_from(_SEV_PIECES), max_size=12).map("".join), min_size=1, max_size=80)


def python_severity(text):
    import re
    from murmur.functions import lexicon as lx
    t = text.lower()
    if any(w in t for w in lx.HIGH_SEVERITY_WORDS):
        return "HIGH"
    if re.search(lx.DELAY_PATTERN, t):
        return "HIGH"
    if any(w in t for w in lx.DELAY_PHRASES):
        return "HIGH"
    if any(w in t for w in lx.MEDIUM_SEVERITY_WORDS):
        return "MEDIUM"
    return "LOW"


@SETTINGS
@given(sev_texts)
def test_severity_matches_python_rule(spark, values):
    from murmur.operators.enrich import detect_severity
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, text string")
    got = {r.i: r.severity for r in detect_severity(df).collect()}
    assert [got[i] for i in range(len(values))] == [python_severity(v) for v in values]
