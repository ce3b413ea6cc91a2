import pytest
from pyspark.sql import functions as F

from conftest import SF01
from murmur.operators.insights import rank_insights, score_clusters, nested_evidence, numbered_evidence, evidence_table
from murmur.operators.report import dataset_stats, feedback_timeline
from murmur.plans.fixtures import clustered_fixture, feedback_fixture

# FIXTURES.md, F-clustered at sf0.01
EXPECTED = {
    0: (1250, 1250, 5, 29, 1.000, 0.917, 0.958, "UPLOAD_FAILURE", "HIGH"),
    1: (1250, 1250, 5, 29, 0.600, 0.837, 0.718, "SLOW_STARTUP", "MEDIUM"),
    2: (1491, 990, 4, 29, 1.000, 0.835, 0.917, "SUPPORT_DELAY", "HIGH"),
    3: (768, 768, 2, 29, 0.531, 0.669, 0.600, "EXPORT_FAILURE", "LOW"),
    4: (372, 186, 5, 8, 0.600, 0.486, 0.543, "GENERIC", "LOW"),
}


@pytest.fixture(scope="module")
def clustered(spark):
    return clustered_fixture(spark, SF01).cache()


def test_scores(clustered):
    rows = {r.cluster: r for r in score_clusters(clustered).collect()}
    assert set(rows) == set(EXPECTED)   # cluster 5 is positive-only and dropped
    for c, (n, neg, src, span, sev, ev, pri, theme, level) in EXPECTED.items():
        r = rows[c]
        assert (r.evidence_count, r.negative_evidence, r.source_count, r.time_span_days) == (n, neg, src, span)
        assert (r.severity_score, r.evidence_score, r.priority_score) == (sev, ev, pri)
        assert r.theme == theme and r.priority == level


def test_rank_and_stats(clustered):
    ranked = [r.cluster for r in rank_insights(score_clusters(clustered)).collect()]
    assert ranked == [0, 2, 1, 3, 4]
    st = dataset_stats(clustered, score_clusters(clustered)).first()
    assert (st.total_feedback, st.active_insights, st.high_priority, st.strong_signals, st.sources) == (10000, 5, 2, 3, 5)


def test_timeline(spark):
    tl = feedback_timeline(feedback_fixture(spark, SF01)).collect()
    assert len(tl) == 30 and min(r["count"] for r in tl) == 302 and max(r["count"] for r in tl) == 364
    assert [r.date for r in tl] == sorted(r.date for r in tl)


def test_dominant_severity_tie_goes_to_first_seen(spark):
    import datetime as dt
    d = dt.datetime(2024, 1, 1)
    rows = [(0, "a", "x", "s", d, "negative", "LOW", 0.3, 0), (1, "b", "y", "s", d, "negative", "HIGH", 1.0, 0),
            (2, "c", "z", "s", d, "negative", "HIGH", 1.0, 0), (3, "d", "w", "s", d, "negative", "LOW", 0.3, 0)]
    df = spark.createDataFrame(rows, "pos long, id string, text string, source string, date timestamp, "
                                     "sentiment string, severity string, severity_score double, cluster int")
    assert score_clusters(df).first().severity == "LOW"


def test_duplicating_rows_keeps_ratios(clustered):
    """Metamorphic: doubling every row leaves ratio features unchanged."""
    doubled = clustered.unionByName(clustered)
    a = {r.cluster: r for r in score_clusters(clustered).collect()}
    b = {r.cluster: r for r in score_clusters(doubled).collect()}
    for c in a:
        assert (a[c].negative_ratio, a[c].severity_score, a[c].evidence_score) == \
               (b[c].negative_ratio, b[c].severity_score, b[c].evidence_score)
        assert b[c].evidence_count == 2 * a[c].evidence_count


def test_numpy_rounding(spark):
    from murmur.functions.numeric import np_round
    import numpy as np
    vals = [0.5995, 0.0005, 0.0015, 0.59956, 0.6004999]
    got = spark.createDataFrame([(v,) for v in vals], ["x"]).select(np_round("x").alias("r")).collect()
    assert [r.r for r in got] == [round(np.float64(v), 3) for v in vals]


def test_evidence_forms(clustered):
    nested = {r.cluster: r for r in nested_evidence(clustered).collect()}
    flat = evidence_table(clustered).where("cluster = 4").orderBy("pos").collect()
    assert nested[4].supporting_feedback_ids == [r.id for r in flat]
    chunks = nested_evidence(clustered, chunk=10).where("cluster = 4").orderBy("chunk_no").collect()
    assert [i for c in chunks for i in c.supporting_feedback_ids] == [r.id for r in flat]
    assert [len(c.supporting_feedback) for c in chunks[:-1]] == [10] * (len(chunks) - 1)
    seq = numbered_evidence(clustered).where("cluster = 4").orderBy("pos").collect()
    assert [r.seq for r in seq] == list(range(len(flat)))


def test_reverse_trace(clustered):
    from murmur.operators.report import insight_of_feedback, trace_evidence
    ev = evidence_table(clustered)
    back = insight_of_feedback(clustered.select("pos", "id", "text"), ev)
    assert back.count() == clustered.count()
    # ids of different uploads may be equal
    same = clustered.withColumn("id", F.lit("1"))
    assert insight_of_feedback(same, evidence_table(same)).count() == clustered.count()
    assert back.where("cluster is null").count() == clustered.where("cluster = -1").count()
    rows = trace_evidence(ev, 4).collect()
    assert [r.pos for r in rows] == sorted(r.pos for r in rows) and {r.cluster for r in rows} == {4}


def test_plans_of_the_aggregates(spark, clustered):
    """One scan behind the scores; no sort of members for representatives."""
    from murmur.operators.insights import representative_statement
    vec = clustered.withColumn("embedding", F.array(F.col("pos").cast("double"), F.lit(1.0)))
    plan = representative_statement(vec)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_members_of_the_largest_clusters_are_not_moved(spark, monkeypatch):
    from pyspark.sql import functions as F

    from murmur.operators import insights
    monkeypatch.setattr(insights, "HEAVY_CLUSTERS", 1)
    members = spark.range(900).select(F.col("id").alias("pos"), F.when(F.col("id") % 9 < 8, 0).otherwise(
        F.col("id")).cast("int").alias("cluster")).withColumn("part", F.spark_partition_id())
    figures = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("_n"), F.min("pos").alias("first"))
    out = insights._spread_join(members, figures, ["cluster"], ["first"])
    got = out.withColumn("now", F.spark_partition_id()).collect()
    assert len(got) == 900 and all(r.now == r.part for r in got if r.cluster == 0)
    assert all(r.first == (0 if r.cluster == 0 else r.pos) for r in got)
