"""Fixture views over the driver tables (see FIXTURES.md). Every fixture is a
Spark DataFrame here and, in ``murmur.plans.oracle``, a DuckDB SQL twin.

The driver tables carry no complaint text, so ``F-feedback`` derives one from
``events``: template ``event_id % 16``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: fixture texts (index = event_id % 16) ---------------------
FEEDBACK_TEMPLATES = (
    "Upload of a PDF made the program crash",
    "The document upload screen will freeze midway",
    "Opening the home screen is slow",
    "Slow to start each morning",
    "Support sent a reply after 3 days",
    "No response from support in 2weeks",
    "Support reply took 5 hours",
    "The export ended with an error",
    "I am unable to download the sheet",
    "Export failing again",
    "Menus are confusing",
    "Too many clicks to reach settings",
    "Love the fresh colours",
    "Charts look great",
    "Closed on holidays",
    "Restarted twice, painfully boring",
)
# phrases put into documents (index = doc_id % their number): every severity
# and sentiment word, delay forms, theme branches, and near misses
PHRASES = (
    "it crashes", "crashing again", "Freezes now", "freezing", "I CANNOT", "you can't", "unable", "a failure", "it fails",
    "failed", "Broken", "unreliable", "slow", "Painfully", "frustrating", "difficult", "confusing", "extremely", "forever",
    "too many", "too long", "takes too long", "3 days", "12weeks", "1 hour", "7 HOURS", "2 day", "several days",
    "almost a week", "weeks", "one week", "5 minutes", "3 dayss", "a3 weekly", "v2 hourly", "crush", "frozen", "slo w",
    "no response", "boring", "took", "error", "love", "great", "easy", "clean", "happy", "love but slow",
    "upload pdf crash", "document upload freeze", "opening is slow", "start slow", "support reply", "support in a week",
    "export error", "download unable", "export works", "upload works", "nothing here", "",
)
# fixed instant used for rows without a usable date in the fixtures
FIXTURE_INGEST_TS = "2024-02-01 00:00:00"
# -----------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def feedback_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-feedback: ``pos, id, text, source, date`` from ``events``."""
    ev = table(spark, sf_dir, "events")
    templates = F.array(*[F.lit(t) for t in FEEDBACK_TEMPLATES])
    return ev.select(
        F.col("event_id").alias("pos"),
        F.col("event_id").cast("string").alias("id"),
        F.element_at(templates, (F.pmod(F.col("event_id"), F.lit(16)) + 1).cast("int")).alias("text"),
        F.col("event_type").alias("source"),
        F.col("ts").cast("timestamp").alias("date"),
    )


def phrased_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-phrases: every document with one of ``PHRASES`` in its middle."""
    docs = table(spark, sf_dir, "documents")
    phrases = F.array(*[F.lit(t) for t in PHRASES])
    half = F.floor(F.length("text") / 2).cast("int")
    phrase = F.get(phrases, F.pmod(F.col("doc_id"), F.lit(len(PHRASES))).cast("int"))
    return docs.select(
        F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("id"),
        F.concat(F.substring("text", F.lit(1), half), F.lit(" "), phrase, F.lit(" "),
                 F.substring("text", half + 1, F.length("text"))).alias("text"))


def fixture_cluster(pos, source, date):
    """The hand-made cluster rule of F-clustered (first match wins)."""
    n = F.pmod(pos, F.lit(16))
    return (
        F.when(n.isin(0, 1), 0)
        .when(n.isin(2, 3), 1)
        .when(n.isin(4, 5, 6) & (source != "view"), 2)
        .when(n.isin(7, 8, 9) & source.isin("error", "click"), 3)
        .when(n.isin(10, 11) & (date < F.lit("2024-01-10").cast("timestamp")), 4)
        .when(n.isin(12, 13, 14), 5)
        .otherwise(-1)
        .cast("int")
    )


def clustered_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-clustered: F-feedback + severity + sentiment + fixture ``cluster``."""
    from murmur.operators.enrich import detect_severity, score_sentiment

    fb = feedback_fixture(spark, sf_dir)
    fb = detect_severity(score_sentiment(fb))
    return fb.withColumn("cluster", fixture_cluster(F.col("pos"), F.col("source"), F.col("date")))


def feedback_vec_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-feedback-vec: all of F-feedback; event ``i`` has the vector number
    ``i % n`` of the ``n`` in ``embeddings``, so every vector is shared by
    many rows, as comments of one wording are."""
    fb = feedback_fixture(spark, sf_dir)
    emb = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("_vec"), "embedding")
    n = emb.select(F.count(F.lit(1))).scalar()
    return fb.withColumn("_vec", F.pmod(F.col("pos"), n)).join(emb, "_vec").drop("_vec")


# --- F-messy, F-csv, F-json ----------------------------------------------------------
def messy_fixture(spark: SparkSession, sf_dir: str, drop: str | None = None, rename_review: str | None = None,
                  csv_quirks: bool = False) -> DataFrame:
    """F-messy: untidy headers and values derived from ``events``."""
    ev = table(spark, sf_dir, "events")
    pos = F.col("event_id")
    plain = F.concat(F.lit("plain text "), pos.cast("string"))
    if csv_quirks:
        # a doubled quote and a line break inside some texts
        plain = F.when(pos % 3 == 0, F.concat(F.lit('plain "q"\ntext '), pos.cast("string"))).otherwise(plain)
    review = (F.when(pos % 11 == 0, F.lit(""))
              .when(pos % 13 == 0, F.lit("nan"))
              .when(pos % 7 == 0, F.concat(F.lit("\tpadded text "), pos.cast("string"), F.lit("  ")))
              .otherwise(plain))
    channel = F.when(pos % 5 == 0, F.lit(None).cast("string")).otherwise(F.col("event_type"))
    created = (F.when(pos % 17 == 0, F.lit("not a date"))
               .when(pos % 19 == 0, F.date_format("ts", "dd/MM/yyyy"))
               .when(pos % 23 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
               .when(pos % 29 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
               .when(pos % 31 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss'.125'"))
               .when(pos % 37 == 0, F.date_format("ts", "yyyy/MM/dd"))
               .when(pos % 41 == 0, (F.unix_seconds(F.col("ts").cast("timestamp")) * 1_000_000_000).cast("string"))
               .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))
    cols = {rename_review or " Review ": review, "Ticket_ID": pos, "Channel": channel, "Created_At": created}
    if drop:
        cols.pop(drop)
    return ev.select(*[c.alias(n) for n, c in cols.items()])


def _write_csv(df: DataFrame, path: str) -> str:
    (df.write.mode("overwrite").option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def write_csv_fixture(spark: SparkSession, sf_dir: str, path: str, even: bool = False) -> str:
    """F-csv: F-messy (with quotes and line breaks in texts) as CSV files;
    ``even`` keeps the rows of even number."""
    df = messy_fixture(spark, sf_dir, csv_quirks=True)
    return _write_csv(df.where("Ticket_ID % 2 = 0") if even else df, path)


def write_turned_csv_fixture(spark: SparkSession, sf_dir: str, path: str) -> str:
    """The rows of F-csv of odd number, under another header: columns in
    another order and a further column."""
    df = messy_fixture(spark, sf_dir, csv_quirks=True).where("Ticket_ID % 2 = 1")
    return _write_csv(df.select("Created_At", "Ticket_ID", F.lit("x").alias("extra"), "Channel", " Review "), path)


# names that the uploads of F-uploads give to text, id, source and date (index =
# event_id % 4); the last has no source, and dates under a name that is not known
UPLOAD_HEADERS = (("comment", "Ticket_ID", "Channel", "Created_At"), ("FEEDBACK", "id", "type", "Date"),
                  (" Text ", "Review_ID", "source", "timestamp"), ("nOtes", "feedback_id", "", "when"))


def write_uploads_fixture(spark: SparkSession, sf_dir: str, path: str) -> str:
    """F-uploads: the rows of F-csv dealt to four uploads with other headers."""
    df = messy_fixture(spark, sf_dir, csv_quirks=True)
    for n, names in enumerate(UPLOAD_HEADERS):
        own = df.where(F.col("Ticket_ID") % 4 == n)
        _write_csv(own.select(*[F.col(c).alias(name) for c, name in zip((" Review ", "Ticket_ID", "Channel", "Created_At"), names)
                                if name]), f"{path}/{n}.csv")
    return path


def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    pos = F.col("event_id")
    return ev.select(
        pos.alias("pos"),
        F.struct(
            F.when(pos % 11 != 0, F.concat(F.lit("json text "), pos.cast("string"))).alias("comment"),
            pos.alias("review_id"),
            F.when(pos % 5 != 0, F.col("event_type")).alias("channel"),
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created"),
        ).alias("rec"),
    )


def write_json_fixture(spark: SparkSession, sf_dir: str, path: str, chunk: int = 100) -> str:
    """F-json: one JSON document per line, in three layouts by chunk of rows:
    a top-level list, a ``{"reviews": [...]}`` wrapper, and single objects.
    Each document holds at most ``chunk`` records."""
    recs = json_records(spark, sf_dir).withColumn("_chunk", F.floor(F.col("pos") / chunk))
    grouped = recs.where(F.col("_chunk") % 3 != 2).groupBy("_chunk").agg(F.collect_list("rec").alias("recs"))
    as_list = grouped.where(F.col("_chunk") % 3 == 0).select(F.to_json("recs").alias("value"))
    wrapped = grouped.where(F.col("_chunk") % 3 == 1).select(
        F.to_json(F.struct(F.col("recs").alias("reviews"))).alias("value"))
    single = recs.where(F.col("_chunk") % 3 == 2).select(F.to_json("rec").alias("value"))
    blank = spark.createDataFrame([("",), ("  ",)], "value string")
    as_list.unionByName(wrapped).unionByName(single).unionByName(blank).write.mode("overwrite").text(path)
    return path


def write_json_document_fixture(spark: SparkSession, sf_dir: str, path: str) -> str:
    """F-json-document: all records as one JSON document, ``{"reviews": [...]}``,
    one record a line."""
    recs = json_records(spark, sf_dir)
    ends = recs.agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")).first()
    lead = F.when(F.col("pos") == ends["lo"], '{"reviews": [').otherwise(",")
    trail = F.when(F.col("pos") == ends["hi"], "]}").otherwise("")
    lines = recs.select("pos", F.concat(lead, F.to_json("rec"), trail).alias("value"))
    # one document is one file, written by one task
    lines.repartitionByRange(1, "pos").sortWithinPartitions("pos").select("value").write.mode("overwrite").text(path)
    return path


# --- F-pages, F-paragraphs: page- and paragraph-shaped text from ``documents`` ------
LINES_PER_PAGE = 5


def _decorate(i, line):
    """Prefix rule for line i of a document: bullet, number, dash, plain."""
    return (F.when(i % 4 == 0, F.concat(F.lit("• "), line))
            .when(i % 4 == 1, F.concat((i + 1).cast("string"), F.lit(". "), line))
            .when(i % 4 == 2, F.concat(F.lit("- "), line))
            .otherwise(line))


def pages_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-pages: each document cut into pages of 5 lines, lines decorated
    with bullets / numbering, joined with CRLF. Groups hold 5 lines."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    lines = lines.select("doc_id", (F.floor(F.col("i") / LINES_PER_PAGE) + 1).cast("int").alias("page_no"),
                         F.struct("i", _decorate(F.col("i"), F.col("line")).alias("l")).alias("x"))
    pages = lines.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return pages.select("doc_id", "page_no",
                        F.array_join(F.transform("xs", lambda x: x.getField("l")), "\r\n").alias("text"))


def paragraphs_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-paragraphs: documents with a whitespace-only line after every third line."""
    docs = table(spark, sf_dir, "documents")
    lines = F.split("text", "\n")
    joined = F.array_join(F.transform(lines, lambda x, i: F.concat(
        x, F.when(i % 3 == 2, F.lit("\n \n")).otherwise(F.lit("\n")))), "")
    return docs.select("doc_id", joined.alias("text"))
