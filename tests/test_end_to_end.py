"""From a hand-written CSV to ranked insights, with the Spark ML embedder."""

import os
import tempfile

from pyspark.sql import functions as F

from murmur.operators.enrich import embed_text, fit_text_embedder
from murmur.operators.insights import analyze_feedback, evidence_table
from murmur.operators.report import dataset_stats, feedback_timeline
from murmur.sources.files import read_feedback

CSV = '''id,text,source,date
1,"Uploading a PDF makes the app crash every time",review,2025-03-01
2,"The app crash happens when uploading a PDF document",support_ticket,2025-03-03
3,"Uploading a PDF makes the app crash again today",interview,2025-03-09
4,"Support took 4 days to send a reply",support_ticket,2025-03-02
5,"Support took 6 days to send a reply, ""slow""",review,2025-03-05
6,"Export to CSV fails with an error",review,2025-03-04
7,"Export to CSV fails with an error message
on the second line",support_ticket,2025-03-06
8,"Love the new colour theme",review,2025-03-07
9,"",review,2025-03-08
10,"Dashboard charts look great and clean",interview,2025-03-10
'''


def test_csv_to_insights(spark):
    d = tempfile.mkdtemp(prefix="e2e-")
    path = os.path.join(d, "feedback.csv")
    with open(path, "w") as f:
        f.write(CSV)
    fb = read_feedback(spark, path, ingest_ts="2025-04-01 00:00:00")
    assert fb.count() == 9   # the empty text is dropped
    model = fit_text_embedder(fb, dim=256)
    insights, enriched = analyze_feedback(fb, embedder=lambda df: embed_text(df, model), eps=0.5)
    rows = insights.collect()
    assert [r.rank for r in rows] == list(range(1, len(rows) + 1))
    assert [r.priority_score for r in rows] == sorted((r.priority_score for r in rows), reverse=True)
    themes = {r.theme for r in rows}
    assert "UPLOAD_FAILURE" in themes
    upload = next(r for r in rows if r.theme == "UPLOAD_FAILURE")
    assert upload.evidence_count >= 2 and upload.problem in {
        "Uploading a PDF makes the app crash every time", "Uploading a PDF makes the app crash again today",
        "The app crash happens when uploading a PDF document"}
    ev = evidence_table(enriched).where(F.col("cluster") == upload.cluster)
    members = {r.id for r in ev.collect()}
    assert len(members) == upload.evidence_count and members <= {"1", "2", "3"}
    st = dataset_stats(fb, insights).first()
    assert st.total_feedback == 9 and st.active_insights == len(rows)
    assert feedback_timeline(fb).count() == 9


def test_nested_evidence_and_text_files(spark):
    from murmur.plans.fixtures import feedback_vec_fixture
    from murmur.operators.report import insights_json
    fb = feedback_vec_fixture(spark, "/root/testdata/sf0.001")
    ins, _ = analyze_feedback(fb, eps=0.6, min_samples=2)
    r = ins.first()
    assert len(r.supporting_feedback_ids) == r.evidence_count == len(r.supporting_feedback)
    assert [x.id for x in r.supporting_feedback] == r.supporting_feedback_ids
    doc = insights_json(ins).first().json
    assert '"supporting_feedback":[{' in doc and "NaN" not in doc

    d = tempfile.mkdtemp(prefix="txt-")
    for name, body in [("a.txt", "first line\n\n  second line  \r\nthird"), ("b.txt", "\n only one \n")]:
        with open(os.path.join(d, name), "w") as f:
            f.write(body)
    rows = read_feedback(spark, os.path.join(d, "*.txt")).collect()
    by_doc = {}
    for x in rows:
        by_doc.setdefault(os.path.basename(x.doc_id), []).append((x.id, x.text, x.source))
    assert sorted(by_doc["a.txt"]) == [("1", "first line", "text_file"), ("2", "second line", "text_file"),
                                       ("3", "third", "text_file")]
    assert by_doc["b.txt"] == [("1", "only one", "text_file")]


def test_insights_hold_every_member(spark):
    """A cluster longer than a chunk has a row for each of its chunks."""
    from murmur.operators.report import insights_json
    from murmur.plans.fixtures import feedback_vec_fixture
    fb = feedback_vec_fixture(spark, "/root/testdata/sf0.001")
    whole, enriched = analyze_feedback(fb, eps=0.6, min_samples=2)
    ins, _ = analyze_feedback(fb, eps=0.6, min_samples=2, evidence_chunk=3)
    got, counts = {}, {}
    for r in ins.collect():
        assert 0 < len(r.supporting_feedback) <= 3
        got.setdefault((r["rank"], r.cluster), []).extend(r.supporting_feedback_ids)
        counts[r["rank"], r.cluster] = r.evidence_count
    assert max(counts.values()) > 3 and {k: len(v) for k, v in got.items()} == counts
    assert got == {(r["rank"], r.cluster): r.supporting_feedback_ids for r in whole.collect()}
    assert insights_json(ins).count() == sum(-(-n // 3) for n in counts.values())
    assert dataset_stats(fb, ins).first() == dataset_stats(fb, whole).first()


def test_all_noise_gives_empty_insights(spark):
    """At the default eps 0.35 the driver vectors have no neighbours."""
    from murmur.plans.fixtures import feedback_vec_fixture
    # one row a vector: events with a number below 500
    fb = feedback_vec_fixture(spark, "/root/testdata/sf0.001").where("pos < 500")
    ins, enriched = analyze_feedback(fb)
    assert ins.count() == 0
    assert enriched.where("cluster <> -1").count() == 0
    st = dataset_stats(fb, ins).first()
    assert (st.total_feedback, st.active_insights, st.high_priority, st.strong_signals) == (500, 0, 0, 0)


def test_batch_job(spark):
    from murmur.__main__ import analyze
    d = tempfile.mkdtemp(prefix="job-")
    path = os.path.join(d, "feedback.csv")
    with open(path, "w") as f:
        f.write(CSV)
    out = os.path.join(d, "out")
    stats = analyze(spark, path, out, eps=0.5, embed_dim=256)
    assert stats["total_feedback"] == 9 and stats["active_insights"] >= 1
    for part in ("feedback", "insights", "insights_json", "evidence", "stats", "timeline"):
        assert os.path.isdir(os.path.join(out, part))
    assert spark.read.parquet(os.path.join(out, "insights")).count() == stats["active_insights"]
    assert spark.read.json(os.path.join(out, "timeline")).count() == 9


def test_grouped_analysis_equals_separate_runs(spark):
    """Many datasets in one job give exactly the per-dataset analyses."""
    from murmur.operators.insights import INSIGHT_COLUMNS
    from murmur.plans.fixtures import feedback_vec_fixture
    fb = feedback_vec_fixture(spark, "/root/testdata/sf0.01").withColumn("ds", (F.col("pos") % 2).cast("int"))
    grouped, genr = analyze_feedback(fb, eps=0.6, min_samples=2, group_col="ds")
    g_rows = {(r.ds, r.rank): r.asDict() for r in grouped.collect()}
    g_stats = {r.ds: r.asDict() for r in dataset_stats(fb, grouped, group_col="ds").collect()}
    g_tl = {(r.ds, r.date): r["count"] for r in feedback_timeline(fb, group_col="ds").collect()}
    n = 0
    for d in (0, 1):
        part = fb.where(F.col("ds") == d)
        alone, _ = analyze_feedback(part, eps=0.6, min_samples=2)
        for r in alone.collect():
            got = g_rows[(d, r.rank)]
            for c in INSIGHT_COLUMNS + ["supporting_feedback_ids"]:
                assert got[c] == r[c], (d, r.rank, c)
            n += 1
        st = dataset_stats(part, alone).first().asDict()
        assert {k: g_stats[d][k] for k in st} == st
        for r in feedback_timeline(part).collect():
            assert g_tl[(d, r.date)] == r["count"]
    assert n == len(g_rows) and n > 0


def test_per_file_datasets(spark):
    """Each input file is an upload: ids restart per file, pos stays unique,
    and the per-file analysis equals analysing each file alone."""
    from murmur.__main__ import analyze
    d = tempfile.mkdtemp(prefix="perfile-")
    body = CSV.replace("id,text,source,date", "text,source,date")
    rows = body.split("\n")
    header, recs = rows[0], rows[1:]
    # drop the leading id field of each record line (multi-line record stays intact)
    recs = [r.split(",", 1)[1] if r[:2].rstrip(",").isdigit() else r for r in recs]
    for name in ("a.csv", "b.csv"):
        with open(os.path.join(d, name), "w") as f:
            f.write("\n".join([header] + recs))
    fb = read_feedback(spark, os.path.join(d, "*.csv"), ingest_ts="2025-04-01 00:00:00", dataset_col="dataset")
    got = fb.collect()
    assert len({r.pos for r in got}) == len(got) == 18
    for name in ("a.csv", "b.csv"):
        ids = sorted(int(r.id) for r in got if r.dataset.endswith(name))
        assert ids == [1, 2, 3, 4, 5, 6, 7, 8, 10]   # record 9 is blank
    stats = analyze(spark, os.path.join(d, "*.csv"), os.path.join(d, "out"), eps=0.5, embed_dim=256, per_file=True)
    assert len(stats) == 2 and all(s["total_feedback"] == 9 for s in stats)
    assert stats[0]["active_insights"] == stats[1]["active_insights"] >= 1


def test_embedder_runs_once_per_row(spark):
    import pandas as pd
    from pyspark.sql.types import ArrayType, FloatType
    from murmur.plans.fixtures import feedback_fixture
    calls = spark.sparkContext.accumulator(0)

    @F.pandas_udf(ArrayType(FloatType()))
    def toy_embed(texts: pd.Series) -> pd.Series:
        calls.add(len(texts))
        return texts.map(lambda t: [float(len(t) % 7), float(len(t) % 5), 1.0])

    fb = feedback_fixture(spark, "/root/testdata/sf0.001")
    insights, enriched = analyze_feedback(fb, embedder=lambda d: d.withColumn("embedding", toy_embed("text")),
                                          eps=0.01)
    insights.collect()
    evidence_table(enriched).collect()
    assert calls.value == fb.count()


def test_workers_need_no_package_on_their_path():
    """A driver started elsewhere (workers cannot import murmur) still runs
    the operators whose code executes in Python workers."""
    import subprocess
    import sys
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        "import sys; sys.path.insert(0, %r)\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "from murmur.operators.cluster import dbscan_cosine\n"
        "df = spark.createDataFrame([(i, [1.0, float(i %% 3)]) for i in range(30)], 'pos long, embedding array<float>')\n"
        "print('clusters', dbscan_cosine(df, eps=0.01, min_samples=2).select('cluster').distinct().count())\n"
    ) % repo
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tempfile.mkdtemp(prefix="elsewhere-"), env=env,
                         capture_output=True, text=True, timeout=300)
    assert "clusters 3" in out.stdout, out.stderr[-2000:]
