import os
import tempfile


from conftest import SF001
from murmur.plans.fixtures import FIXTURE_INGEST_TS, messy_fixture
from murmur.streaming.ingest import ingest_stream, timeline_stream

SCHEMA = "` Review ` string, Ticket_ID string, Channel string, Created_At string"


def test_ingest_and_timeline(spark):
    base = tempfile.mkdtemp(prefix="stream-")
    src, out = os.path.join(base, "in"), os.path.join(base, "out")
    messy = messy_fixture(spark, SF001)
    messy.where("Ticket_ID < 500").write.option("header", True).csv(os.path.join(src, "a"))
    messy.where("Ticket_ID >= 500").write.option("header", True).csv(os.path.join(src, "b"))
    q = ingest_stream(spark, os.path.join(src, "*"), out, SCHEMA, ingest_ts=FIXTURE_INGEST_TS,
                      checkpoint=os.path.join(base, "ckpt"))
    q.awaitTermination(120)
    got = spark.read.parquet(out)
    assert got.count() == 839 and {"severity", "sentiment", "batch_id", "dataset"} <= set(got.columns)
    assert got.select("pos").distinct().count() == 839

    stream = spark.readStream.schema(got.drop("batch_id").schema).parquet(out)
    tq = (timeline_stream(stream).writeStream.outputMode("append").format("memory")
          .queryName("tl").option("checkpointLocation", os.path.join(base, "ckpt2")).start())
    tq.processAllAvailable()
    tq.stop()
    days = spark.sql("select * from tl").collect()
    assert len(days) > 0 and all(d["count"] > 0 for d in days)


def test_restart_processes_only_new_files(spark):
    base = tempfile.mkdtemp(prefix="stream-restart-")
    src, out, ckpt = os.path.join(base, "in"), os.path.join(base, "out"), os.path.join(base, "ckpt")
    os.makedirs(src)
    messy = messy_fixture(spark, SF001)

    def drop(name, cond):
        tmp = os.path.join(base, "stage-" + name)
        messy.where(cond).coalesce(1).write.option("header", True).csv(tmp)
        part = [f for f in os.listdir(tmp) if f.endswith(".csv")][0]
        os.link(os.path.join(tmp, part), os.path.join(src, name + ".csv"))

    drop("first", "Ticket_ID < 300")
    ingest_stream(spark, src, out, SCHEMA, ingest_ts=FIXTURE_INGEST_TS, checkpoint=ckpt).awaitTermination(120)
    n1 = spark.read.parquet(out).count()
    drop("second", "Ticket_ID >= 300")
    ingest_stream(spark, src, out, SCHEMA, ingest_ts=FIXTURE_INGEST_TS, checkpoint=ckpt).awaitTermination(120)
    got = spark.read.parquet(out)
    assert n1 == 251 and got.count() == 839
    assert got.select("batch_id").distinct().count() == 2
    # ids come from the Ticket_ID column; every file is its own dataset
    assert {r.dataset.rsplit("/", 1)[-1] for r in got.select("dataset").distinct().collect()} == {"first.csv", "second.csv"}


def test_stream_generated_ids_restart_per_file(spark):
    base = tempfile.mkdtemp(prefix="stream-ids-")
    src, out = os.path.join(base, "in"), os.path.join(base, "out")
    os.makedirs(src)
    for name, texts in (("u1.csv", ["one", "", "two", "three"]), ("u2.csv", ["four", "five"])):
        with open(os.path.join(src, name), "w") as f:
            f.write("comment\n" + "\n".join(texts) + "\n")
    q = ingest_stream(spark, src, out, "comment string", ingest_ts=FIXTURE_INGEST_TS,
                      checkpoint=os.path.join(base, "ckpt"))
    q.awaitTermination(120)
    rows = spark.read.parquet(out).collect()
    by_file = {}
    for r in rows:
        by_file.setdefault(r.dataset.rsplit("/", 1)[-1], []).append((int(r.id), r.text))
    assert sorted(by_file["u1.csv"]) == [(1, "one"), (2, "two"), (3, "three")]
    assert sorted(by_file["u2.csv"]) == [(1, "four"), (2, "five")]
    assert len({r.pos for r in rows}) == len(rows)
