import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from murmur.operators.standardize import (feedback_violations, normalize_headers, standardize_feedback,
                                          validate_feedback)
from murmur.plans.fixtures import FIXTURE_INGEST_TS, messy_fixture, write_csv_fixture
from murmur.sources.files import read_csv_feedback, read_feedback, read_json_feedback


def _counts(df):
    ts = F.lit(FIXTURE_INGEST_TS).cast("timestamp")
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("source") == "unknown").alias("unknown"),
                  F.count_if(F.col("date") == ts).alias("ingest"),
                  F.count_if((F.hour("date") == 0) & (F.minute("date") == 0) & (F.second("date") == 0)
                             & (F.col("date") != ts)).alias("midnight")).first()


def test_messy_standardize(spark):
    std = standardize_feedback(messy_fixture(spark, SF01), ingest_ts=FIXTURE_INGEST_TS, date_flag_col="date_parsed")
    c = _counts(std)
    assert (c.n, c.unknown) == (8390, 1678)
    assert std.where("not date_parsed").count() == 494   # only the cells that are no dates
    assert c.midnight >= 416   # slashed rows parse to midnight
    assert std.where("text like 'padded%'").count() > 0
    assert std.where("text rlike '^\\\\s|\\\\s$'").count() == 0


def test_generated_ids_have_gaps(spark):
    std = standardize_feedback(messy_fixture(spark, SF01, drop="Ticket_ID"), ingest_ts=FIXTURE_INGEST_TS)
    ids = [int(r.id) for r in std.orderBy("pos").select("id").limit(5).collect()]
    assert ids == [2, 3, 4, 5, 6]   # row 0 (pos % 11 == 0) was blank


def test_no_channel_and_unlisted_text(spark):
    std = standardize_feedback(messy_fixture(spark, SF01, drop="Channel"), ingest_ts=FIXTURE_INGEST_TS)
    assert {r.source for r in std.select("source").distinct().collect()} == {"uploaded_file"}
    std2 = standardize_feedback(messy_fixture(spark, SF01, rename_review="Body"), ingest_ts=FIXTURE_INGEST_TS)
    assert std2.count() > 0   # the longest string column is chosen


def test_header_collision(spark):
    df = spark.createDataFrame([("a", "b")], ["Text", " text"])
    with pytest.raises(ValueError):
        normalize_headers(df)


def test_validation(spark):
    df = spark.createDataFrame([("a",)], ["text"])
    with pytest.raises(ValueError, match=r"\['date', 'id', 'source'\]"):
        validate_feedback(df)
    assert [r.rule for r in feedback_violations(df).collect()] == ["missing_columns"]


def test_csv_round_trip(spark):
    path = write_csv_fixture(spark, SF01, tempfile.mkdtemp(prefix="fcsv-") + "/f.csv")
    std = standardize_feedback(read_csv_feedback(spark, path), ingest_ts=FIXTURE_INGEST_TS)
    assert std.count() == 8390
    assert std.where(F.col("text").contains('"q"\ntext')).count() > 0


def test_json_three_layouts(spark):
    d = tempfile.mkdtemp(prefix="fjson-")
    docs = {
        "a.json": [{"feedback": "first one", "id": 1}, {"feedback": "second", "id": 2, "source": "web"}],
        "b.json": {"reviews": [{"review": "wrapped", "review_id": 7}]},
        "c.json": {"feedback": "single object"},
    }
    for name, obj in docs.items():
        with open(os.path.join(d, name), "w") as f:
            json.dump(obj, f, indent=2)   # multi-line documents
    a = read_feedback(spark, os.path.join(d, "a.json"), ingest_ts=FIXTURE_INGEST_TS).orderBy("pos").collect()
    assert [(r.id, r.text, r.source) for r in a] == [("1", "first one", "unknown"), ("2", "second", "web")]
    b = read_feedback(spark, os.path.join(d, "b.json"), ingest_ts=FIXTURE_INGEST_TS).collect()
    assert [(r.id, r.text) for r in b] == [("7", "wrapped")]
    c = read_feedback(spark, os.path.join(d, "c.json"), ingest_ts=FIXTURE_INGEST_TS).collect()
    assert [(r.id, r.text, r.source) for r in c] == [("1", "single object", "uploaded_file")]
    with open(os.path.join(d, "s.json"), "w") as f:
        f.write("5")
    with pytest.raises(Exception, match="neither a list nor an object"):
        read_json_feedback(spark, os.path.join(d, "s.json")).collect()


def test_unsupported_extension(spark):
    with pytest.raises(ValueError, match="no reader for"):
        read_feedback(spark, "/nowhere/file.xlsx")


def test_csv_position_across_files(spark):
    """Row positions follow file order, then row order, across many files."""
    path = tempfile.mkdtemp(prefix="fcsv-multi-") + "/many.csv"
    src = spark.range(0, 2000).repartitionByRange(4, "id").select(
        F.concat(F.lit("row "), F.col("id").cast("string")).alias("text"), F.col("id").alias("n"))
    src.write.option("header", True).csv(path)
    assert len([f for f in os.listdir(path) if f.endswith(".csv")]) == 4
    std = standardize_feedback(read_csv_feedback(spark, path), ingest_ts=FIXTURE_INGEST_TS)
    rows = std.select("pos", "id", "text").collect()
    assert sorted((r.pos, r.text) for r in rows) == [(i, f"row {i}") for i in range(2000)]
    assert all(r.id == str(r.pos + 1) for r in rows)


@pytest.mark.parametrize("multi_line", [False, True, None])
def test_numbering_survives_another_split_layout(spark, multi_line):
    """The rows are read once: settings that change between the call and the
    action cannot lose or renumber any."""
    path = tempfile.mkdtemp(prefix="fcsv-splits-")
    for k in range(3):
        with open(os.path.join(path, f"{k}.csv"), "w") as f:
            f.write("id,text\n" + "".join(f"{k * 100_000 + i},row {i}\n" for i in range(100_000)))
    try:
        for before, after in ((2, 13), (13, 2)):
            spark.conf.set("spark.sql.files.minPartitionNum", before)
            std = standardize_feedback(read_csv_feedback(spark, path, multi_line=multi_line), ingest_ts=FIXTURE_INGEST_TS)
            spark.conf.set("spark.sql.files.minPartitionNum", after)
            r = std.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pos").alias("d"), F.min("pos").alias("lo"),
                        F.max("pos").alias("hi"), F.count_if(F.col("pos") == F.col("id").cast("long")).alias("same")).first()
            assert tuple(r) == (300_000, 300_000, 0, 299_999, 300_000)
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_many_small_files(spark):
    path = tempfile.mkdtemp(prefix="fcsv-small-")
    for k in range(300):
        with open(os.path.join(path, f"{k:04d}.csv"), "w") as f:
            f.write("text\n" + f"a {k}\nb {k}\n")
    std = standardize_feedback(read_csv_feedback(spark, path), ingest_ts=FIXTURE_INGEST_TS, dataset_col="file")
    rows = sorted((r.pos, r.id, r.text) for r in std.collect())
    assert rows == sorted((2 * k + i, str(i + 1), f"{'ab'[i]} {k}") for k in range(300) for i in (0, 1))


def test_headers_of_every_file(spark):
    path = tempfile.mkdtemp(prefix="fcsv-heads-")
    files = {"a.csv": "id,text,source,date\n1,first,web,2024-01-05\n,no id,app,2024-01-06\n",
             "b.csv": "date,source,text,id,extra\n2024-01-06,ticket,second upload,9,zz\n",
             "c.csv": "\ufefftext\nonly text\n"}
    for name, body in files.items():
        with open(os.path.join(path, name), "w") as f:
            f.write(body)
    std = read_feedback(spark, [os.path.join(path, n) for n in files], ingest_ts=FIXTURE_INGEST_TS).orderBy("pos")
    assert [(r.id, r.text, r.source, str(r.date)) for r in std.collect()] == [
        ("1", "first", "web", "2024-01-05 00:00:00"), ("2", "no id", "app", "2024-01-06 00:00:00"),
        ("9", "second upload", "ticket", "2024-01-06 00:00:00"), ("4", "only text", "uploaded_file", FIXTURE_INGEST_TS)]


def _written(**files):
    path = tempfile.mkdtemp(prefix="fcsv-mixed-")
    for name, body in files.items():
        with open(os.path.join(path, name + ".csv"), "w", newline="") as f:
            f.write(body)
    return path


def test_every_upload_names_its_own_columns(spark):
    """Text, id, source and date columns are chosen per header; no row is lost."""
    path = _written(a="id,comment,Channel\n1,from comment,web\n2,second,\n", b="id,feedback,date\n7,from feedback,2024-01-05\n",
                    c="ID,Text\n8,upper case names\n", d="\n \nid,text\n9,blank first lines\n", e="\n\n",
                    f="nr,story\n5,the longest column is taken\n6,again\n", g='"Notes, all",NOTE,Ticket_ID\nx,"a ""note""",3\n')
    want = {"a": [("1", "from comment", "web"), ("2", "second", "unknown")], "b": [("7", "from feedback", "uploaded_file")],
            "c": [("8", "upper case names", "uploaded_file")], "d": [("9", "blank first lines", "uploaded_file")],
            "f": [("6", "the longest column is taken", "uploaded_file"), ("7", "again", "uploaded_file")],
            "g": [("3", 'a "note"', "uploaded_file")]}
    plain = read_feedback(spark, path + "/*.csv", ingest_ts=FIXTURE_INGEST_TS).orderBy("pos").collect()
    assert sorted(r.pos for r in plain) == list(range(8))
    assert sorted((r.text, r.source) for r in plain) == sorted((t, s) for rows in want.values() for _, t, s in rows)
    each = read_feedback(spark, path + "/*.csv", ingest_ts=FIXTURE_INGEST_TS, dataset_col="up").collect()
    got = {}
    for r in sorted(each, key=lambda r: r.pos):
        got.setdefault(os.path.basename(r.up)[0], []).append((r.id, r.text, r.source))
    want["f"] = [("1", *want["f"][0][1:]), ("2", *want["f"][1][1:])]
    assert got == want
    dates = {r.text: str(r.date) for r in plain}
    assert dates.pop("from feedback") == "2024-01-05 00:00:00" and set(dates.values()) == {FIXTURE_INGEST_TS}


@pytest.mark.parametrize("seed", range(4))
def test_broken_cells_in_many_splits(spark, seed):
    """Records found across splits of a few bytes are those of Python's reader."""
    import csv
    import io
    import random
    rng = random.Random(seed)
    piece = ["a", "b c", '"', ",", "\n", "\n\n", "é", '""', "x" * 30, "' '"]
    table = [["id", "text", "source"]]
    for i in range(120):
        table.append([str(i), "t" + "".join(rng.choice(piece) for _ in range(rng.randint(0, 6))), rng.choice(["web", 'w "q', "app"])])
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(table)
    path = _written(a=out.getvalue(), b='id,text\n500,5" screen\n501,"6"" one"\n', c='id,text\n600,"open\n\n' + "y\n" * 40 + '"\n601,last')
    want = [(r[0], r[1].strip(), r[2]) for r in table[1:]] + [
        (i, t, "uploaded_file") for i, t in (("500", '5" screen'), ("501", '6" one'), ("600", "open\n\n" + "y\n" * 39 + "y"), ("601", "last"))]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        std = read_feedback(spark, path + "/*.csv", ingest_ts=FIXTURE_INGEST_TS)
        got = sorted((r.pos, r.id, r.text, r.source) for r in std.collect())
        raw = read_csv_feedback(spark, path + "/a.csv")
        assert raw.where("text is not null").count() == len(table) - 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(g[1:] for g in got) == sorted(want)
    ids = [g[1] for g in got]
    assert [i for i in ids if int(i) < 200] == [r[0] for r in table[1:]]      # order inside a file


def test_quoted_breaks_are_found(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="fcsv-quote-"), "q.csv")
    with open(path, "w") as f:
        f.write('id,text\n1,"two\nlines, ""quoted"""\n2,plain\n')
    std = read_feedback(spark, path, ingest_ts=FIXTURE_INGEST_TS).orderBy("pos")
    assert [(r.id, r.text) for r in std.collect()] == [("1", 'two\nlines, "quoted"'), ("2", "plain")]


def test_json_lines_with_blanks_and_many_keys(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="fjson-keys-"), "k.jsonl")
    with open(path, "w") as f:
        for i in range(200):
            f.write(json.dumps({f"user{i}": 1, "story": f"a long enough story {i}", "ID": i}) + "\n\n")
    raw = read_json_feedback(spark, path, layout="lines")
    assert sorted(raw.columns[:-1]) == ["ID", "story"]
    std = standardize_feedback(raw, ingest_ts=FIXTURE_INGEST_TS).orderBy("pos").collect()
    assert [(r.pos, r.id, r.text) for r in std] == [(i, str(i), f"a long enough story {i}") for i in range(200)]


@pytest.mark.parametrize("wrap", ["", "reviews"])
def test_one_large_json_document_in_splits(spark, wrap):
    """The records of a document cut anywhere are those of the document layout."""
    import random
    rng = random.Random(5)
    odd = ['}', '{"', "]}", "\\", '\\"', "},{", "é", "\n", "[", '"', "plain"]
    recs = [{"text": "t" + "".join(rng.choice(odd) for _ in range(rng.randint(0, 6))), "id": i,
             "more": rng.choice([{"a": {"b": [1, {"c": {}}]}}, [], None, "}{"])} for i in range(150)]
    for i, body in enumerate([recs, recs[:1], []]):
        path = tempfile.mkdtemp(prefix="fjson-split-") + "/big.json"
        with open(path, "w") as f:
            json.dump({wrap: body} if wrap else body, f, ensure_ascii=False, indent=None if i else 1)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "113b")
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        try:
            got = read_json_feedback(spark, path, layout="split", columns=["id", "text"])
            rows = [(r.id, r.text) for r in standardize_feedback(got, ingest_ts=FIXTURE_INGEST_TS).orderBy("pos").collect()] if body else got.collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        whole = read_json_feedback(spark, path, columns=["id", "text"])
        want = [(r.id, r.text) for r in standardize_feedback(whole, ingest_ts=FIXTURE_INGEST_TS).orderBy("pos").collect()] if body else []
        assert rows == want and len(rows) == len(body)
    for body in ('[1, {"text": "x"}]', '{"meta": {"a": {}}, "data": [{"text": "x"}]}', '{"data": [{"text": "x"}], "n": 1}'):
        path = tempfile.mkdtemp(prefix="fjson-split-") + "/other.json"
        with open(path, "w") as f:
            f.write(body)
        with pytest.raises(Exception, match="as a document"):
            read_json_feedback(spark, path, layout="split", columns=["text"]).collect()


def test_dates(spark):
    cells = {"2024-01-05T10:00:00Z": "2024-01-05 10:00:00", "2024-01-05 10:00:00.123": "2024-01-05 10:00:00.123000",
             "2024-01-05T10:00:00+02:00": "2024-01-05 08:00:00", "2024/01/05": "2024-01-05 00:00:00",
             "2024-01-05": "2024-01-05 00:00:00", "03/04/2024": "2024-03-04 00:00:00", "25/12/2024": "2024-12-25 00:00:00",
             "1704448800000000000": "2024-01-05 10:00:00", " 2024-01-05 10:00 ": "2024-01-05 10:00:00",
             "10:30": None, "soon": None, "": None, None: None}
    df = spark.createDataFrame([("t", c) for c in cells], "text string, date string")
    out = standardize_feedback(df, ingest_ts=FIXTURE_INGEST_TS, date_flag_col="date_parsed").orderBy("pos").collect()
    assert [(str(r.date) if r.date_parsed else None) for r in out] == list(cells.values())
    assert all(str(r.date) == FIXTURE_INGEST_TS for r in out if not r.date_parsed)
    turned = standardize_feedback(df.where("date = '03/04/2024'"), ingest_ts=FIXTURE_INGEST_TS, day_first=True).first()
    assert str(turned.date) == "2024-04-03 00:00:00"
    epoch = spark.createDataFrame([("t", "1704448800")], "text string, timestamp string")
    assert str(standardize_feedback(epoch, epoch_unit="s").first().date) == "2024-01-05 10:00:00"


def test_given_positions_are_used(spark):
    df = spark.createDataFrame([(5, "a"), (2, "b")], "row long, text string")
    rows = standardize_feedback(df, ingest_ts=FIXTURE_INGEST_TS, pos_col="row").orderBy("pos").collect()
    assert [(r.pos, r.id, r.text) for r in rows] == [(2, "3", "b"), (5, "6", "a")]
