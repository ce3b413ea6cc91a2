"""Query registry: one entry per operator of the inventory, each a callable
``(spark, sf_dir) -> DataFrame`` over the driver tables, plus (where the
operator is SQL-expressible) a DuckDB twin over the same tables.

Result conventions shared by both sides: arrays are rendered as
comma-joined text and timestamps as ISO text, so the two engines hash alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.functions import lexicon as lx
from murmur.plans import fixtures as fx
from murmur.plans import oracle as orc

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


# ============================================================================
# 2.3 row enrichment over F-feedback
# ============================================================================
def _feedback(spark, sf_dir):
    return fx.feedback_fixture(spark, sf_dir)


def _q_detect_severity(spark, sf_dir):
    from murmur.operators.enrich import detect_severity
    return detect_severity(_feedback(spark, sf_dir)).select("pos", "id", "severity", "severity_score")


register("detect_severity", _with(f"{orc.feedback_cte()},\n{orc.enriched_cte()}",
                                  "SELECT pos, id, severity, severity_score FROM enr"))(_q_detect_severity)


def _q_score_sentiment(spark, sf_dir):
    from murmur.operators.enrich import score_sentiment
    return score_sentiment(_feedback(spark, sf_dir)).select("pos", "sentiment", "sentiment_score")


register("score_sentiment", _with(f"{orc.feedback_cte()},\n{orc.enriched_cte()}",
                                  "SELECT pos, sentiment, sentiment_score FROM enr"))(_q_score_sentiment)


def _q_enrich_phrases(spark, sf_dir):
    """E1, E2 and the keyword flags of A20 over F-phrases, row by row."""
    from murmur.operators.enrich import detect_severity, score_sentiment
    rows = detect_severity(score_sentiment(fx.phrased_fixture(spark, sf_dir)))
    lower = F.lower("text")
    return rows.select("pos", "severity", "severity_score", "sentiment", "sentiment_score",
                       *[lower.contains(w).alias("kw_" + w) for w in lx.THEME_KEYWORDS])


register("enrich_phrases", _with(
    f"{orc.phrased_cte()},\n{orc.enriched_cte('phr')}",
    "SELECT pos, severity, severity_score, sentiment, sentiment_score, "
    + ", ".join(f"contains(lower(text), '{w}') AS kw_{w}" for w in orc.KEYWORDS) + " FROM enr"))(_q_enrich_phrases)


# ============================================================================
# 2.5 cluster aggregation over F-clustered
# ============================================================================
def _clustered(spark, sf_dir):
    return fx.clustered_fixture(spark, sf_dir)


def _raw(spark, sf_dir):
    from murmur.operators.insights import raw_cluster_scores
    return raw_cluster_scores(_clustered(spark, sf_dir))


def _final(spark, sf_dir):
    from murmur.operators.insights import finalize_scores
    return finalize_scores(_raw(spark, sf_dir))


_CLU = orc.clustered_cte()
_SCORING = orc.scoring_ctes("clu")
_ALL = f"{_CLU},\n{_SCORING}"


def _register_select(name: str, base: Callable, spark_cols: list, sql_from: str, sql_cols: str):
    def fn(spark, sf_dir):
        cols = spark_cols() if callable(spark_cols) else spark_cols
        return base(spark, sf_dir).select(*cols)
    fn.__name__ = f"_q_{name}"
    register(name, _with(_ALL, f"SELECT {sql_cols} FROM {sql_from}"))(fn)


def _drop_noise(spark, sf_dir):
    from murmur.operators.insights import drop_noise
    return drop_noise(_clustered(spark, sf_dir)).select("pos", "cluster")


register("drop_noise", _with(_ALL, "SELECT pos, cluster FROM clu WHERE cluster <> -1"))(_drop_noise)

_register_select("evidence_count", _raw, lambda: ["cluster", "evidence_count"], "s4", "cluster, evidence_count")
_register_select("negative_evidence", _raw, lambda: ["cluster", "negative_evidence", F.col("negative_ratio_raw").alias("negative_ratio")],
                 "s4", "cluster, negative_evidence, negative_ratio_raw AS negative_ratio")
_register_select("drop_positive_only", _final, lambda: ["cluster", "negative_evidence"], "scored", "cluster, negative_evidence")
_register_select("frequency_score", _raw, lambda: ["cluster", "frequency_score"], "s4", "cluster, frequency_score")
_register_select("source_diversity", _raw, lambda: ["cluster", "source_count", "source_diversity"], "s4",
                 "cluster, source_count, source_diversity")
_register_select("cluster_time_span", _raw,
                 lambda: ["cluster", F.date_format("first_seen_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("first_seen_ts"),
                  F.date_format("last_seen_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_seen_ts"), "time_span_days"],
                 "s4", "cluster, strftime(first_seen_ts, '%Y-%m-%d %H:%M:%S.%f') AS first_seen_ts, "
                       "strftime(last_seen_ts, '%Y-%m-%d %H:%M:%S.%f') AS last_seen_ts, time_span_days")
_register_select("temporal_score", _raw, lambda: ["cluster", "temporal_score"], "s4", "cluster, temporal_score")
_register_select("mean_severity", _raw, lambda: ["cluster", F.col("severity_raw").alias("severity_score")], "s4",
                 "cluster, severity_raw AS severity_score")
_register_select("evidence_score", _raw, lambda: ["cluster", F.col("evidence_raw").alias("evidence_score")], "s4",
                 "cluster, evidence_raw AS evidence_score")
_register_select("signal_strength", _final, lambda: ["cluster", "signal_strength"], "scored", "cluster, signal_strength")
_register_select("priority_score", _raw, lambda: ["cluster", F.col("priority_raw").alias("priority_score")], "s4",
                 "cluster, priority_raw AS priority_score")
_register_select("priority_level", _final, lambda: ["cluster", "priority"], "scored", "cluster, priority")
_register_select("dominant_severity", _raw, lambda: ["cluster", "severity"], "s4", "cluster, severity")
_register_select("source_list", _raw, lambda: ["cluster", F.array_join("sources", ", ").alias("sources")], "s4",
                 "cluster, array_to_string(sources, ', ') AS sources")
_register_select("keyword_flags", _raw, lambda: ["cluster"] + ["kw_" + w for w in lx.THEME_KEYWORDS], "s4",
                 "cluster, " + ", ".join("kw_" + w for w in lx.THEME_KEYWORDS))
_register_select("problem_summary", _final, lambda: ["cluster", "theme", "problem_summary"], "insights",
                 "cluster, theme, problem_summary")
_register_select("observed_pattern", _final, lambda: ["cluster", "observed_pattern"], "insights", "cluster, observed_pattern")
_register_select("customer_impact", _final, lambda: ["cluster", "customer_impact"], "insights", "cluster, customer_impact")
_register_select("round_scores", _final, lambda: ["cluster", "priority_score", "severity_score", "evidence_score", "negative_ratio"],
                 "scored", "cluster, priority_score, severity_score, evidence_score, negative_ratio")


def _insight_cols(df: DataFrame) -> DataFrame:
    from murmur.operators.insights import INSIGHT_COLUMNS
    cols = [c for c in INSIGHT_COLUMNS if c in df.columns]
    return df.select(*[F.array_join("sources", ", ").alias("sources") if c == "sources" else c for c in cols])


def _q_score_clusters(spark, sf_dir):
    from murmur.operators.insights import score_clusters
    return _insight_cols(score_clusters(_clustered(spark, sf_dir)))


register("score_clusters", _with(_ALL, f"SELECT {orc.INSIGHT_SQL_COLUMNS} FROM insights"))(_q_score_clusters)


def _ranked(spark, sf_dir):
    from murmur.operators.insights import rank_insights, score_clusters
    return rank_insights(score_clusters(_clustered(spark, sf_dir)))


def _q_rank_insights(spark, sf_dir):
    return _ranked(spark, sf_dir).select("rank", "cluster", "priority_score", "priority")


register("rank_insights", _with(_ALL, "SELECT rank, cluster, priority_score, priority FROM insights"))(_q_rank_insights)


def _evidence(spark, sf_dir):
    from murmur.operators.insights import evidence_table
    return evidence_table(_clustered(spark, sf_dir))


_EVIDENCE_SQL = ("SELECT cluster, pos, id, source, strftime(date, '%Y-%m-%d') AS date, text, sentiment, severity "
                 "FROM clu WHERE cluster <> -1")


CHUNK = 100


def _nested(spark, sf_dir):
    from murmur.operators.insights import nested_evidence
    return nested_evidence(_clustered(spark, sf_dir), chunk=CHUNK)


def _q_supporting_ids(spark, sf_dir):
    return _nested(spark, sf_dir).select("cluster", "chunk_no", F.array_join("supporting_feedback_ids", ",").alias("ids"))


def _q_supporting_feedback(spark, sf_dir):
    items = _nested(spark, sf_dir).select("cluster", "chunk_no", F.posexplode("supporting_feedback").alias("i", "f"))
    return items.select("cluster", (F.col("chunk_no") * CHUNK + F.col("i")).cast("long").alias("seq"), "f.*")


_SEQ_SQL = """(SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY pos) - 1 AS seq FROM clu WHERE cluster <> -1)"""
register("supporting_ids", _with(_ALL, f"""SELECT cluster, CAST(seq // {CHUNK} AS INTEGER) AS chunk_no,
  string_agg(id, ',' ORDER BY seq) AS ids FROM {_SEQ_SQL} GROUP BY 1, 2"""))(_q_supporting_ids)
register("supporting_feedback", _with(_ALL, f"""SELECT cluster, seq, id, source, strftime(date, '%Y-%m-%d') AS date, text,
  sentiment, severity FROM {_SEQ_SQL}"""))(_q_supporting_feedback)


# ============================================================================
# 2.6 dataset outputs
# ============================================================================
def _q_dataset_stats(spark, sf_dir):
    from murmur.operators.insights import score_clusters
    from murmur.operators.report import dataset_stats
    cf = _clustered(spark, sf_dir)
    return dataset_stats(cf, score_clusters(cf))


register("dataset_stats", _with(_ALL, """SELECT
  (SELECT count(*) FROM clu) AS total_feedback,
  (SELECT count(*) FROM insights) AS active_insights,
  (SELECT count(*) FROM insights WHERE upper(priority) = 'HIGH') AS high_priority,
  (SELECT count(*) FROM insights WHERE upper(signal_strength) = 'STRONG SIGNAL') AS strong_signals,
  (SELECT count(DISTINCT source) FROM clu) AS sources"""))(_q_dataset_stats)


def _q_feedback_timeline(spark, sf_dir):
    from murmur.operators.report import feedback_timeline
    return feedback_timeline(_feedback(spark, sf_dir))


register("feedback_timeline", _with(orc.feedback_cte(), """SELECT strftime(date, '%Y-%m-%d') AS date, count(*) AS count
FROM fb WHERE date IS NOT NULL GROUP BY 1"""))(_q_feedback_timeline)


def _q_trace_evidence(spark, sf_dir):
    from murmur.operators.report import trace_evidence
    top = _ranked(spark, sf_dir).where("rank = 1").select("cluster")
    ev = _evidence(spark, sf_dir).join(top, "cluster", "left_semi")
    return trace_evidence(ev).select("cluster", "pos", "id", "source", "date", "text")


register("trace_evidence", _with(_ALL, """SELECT e.cluster, e.pos, e.id, e.source, strftime(e.date, '%Y-%m-%d') AS date, e.text
FROM clu e WHERE e.cluster = (SELECT cluster FROM insights WHERE rank = 1)"""))(_q_trace_evidence)


# ============================================================================
# 2.3 / 2.4 vectors, similarity and clustering over ``embeddings``
# ============================================================================
FIXTURE_EPS = 0.6   # the driver vectors have no neighbours at the default 0.35
FIXTURE_BLOCK = 400   # rows a block: several block pairs at every scale factor but the smallest


def _embeddings(spark, sf_dir):
    return fx.table(spark, sf_dir, "embeddings")


def _with_rec(ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{body}"


def _round(c, digits):
    from murmur.functions.numeric import np_round
    return np_round(c, digits)


def _q_l2_normalize(spark, sf_dir):
    from murmur.operators.enrich import l2_normalize
    df = l2_normalize(_embeddings(spark, sf_dir), "embedding", "unit")
    return df.select("vec_id", F.posexplode("unit").alias("dim", "value")).select(
        "vec_id", "dim", _round(F.col("value"), 9).alias("value"))


register("l2_normalize", """WITH n AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v,
         sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS nrm FROM embeddings)
SELECT vec_id, CAST(i - 1 AS INTEGER) AS dim,
       """ + orc.np_round("CASE WHEN nrm > 0 THEN v[i] / nrm ELSE v[i] END", 9) + """ AS value
FROM n, range(1, len(v) + 1) t(i)""")(_q_l2_normalize)


def _q_cosine_to_vector(spark, sf_dir):
    from murmur.operators.enrich import cosine_to_vector
    emb = _embeddings(spark, sf_dir)
    # one vector of d numbers, fetched once (a bounded value, not a table)
    target = emb.select(F.min_by("embedding", "vec_id")).first()[0]
    return cosine_to_vector(emb, "embedding", target).select("vec_id", _round(F.col("similarity"), 9).alias("similarity"))


register("cosine_to_vector", """SELECT vec_id, """ + orc.np_round(
    orc.cosine("embedding", "(SELECT arg_min(embedding, vec_id) FROM embeddings)"), 9) + """ AS similarity
FROM embeddings""")(_q_cosine_to_vector)


def _pairs(spark, sf_dir):
    from murmur.operators.cluster import cosine_eps_join
    # a Parquet table: cheap and stable to read twice
    return cosine_eps_join(_embeddings(spark, sf_dir), "vec_id", "embedding", eps=FIXTURE_EPS,
                           block_rows=FIXTURE_BLOCK, input_materialized=True)


def _q_cosine_eps_join(spark, sf_dir):
    return _pairs(spark, sf_dir).select("src", "dst", _round(F.col("distance"), 6).alias("distance"))


register("cosine_eps_join", _with(orc.pairs_cte("embeddings", "vec_id", "embedding", FIXTURE_EPS),
                                  f"SELECT src, dst, {orc.np_round('distance', 6)} AS distance FROM pairs"))(_q_cosine_eps_join)


def _q_connected_components(spark, sf_dir):
    from murmur.operators.cluster import connected_components
    verts = _embeddings(spark, sf_dir).select(F.col("vec_id").alias("id"))
    return connected_components(verts, _pairs(spark, sf_dir), id_col="id")


register("connected_components", _with_rec(
    f"{orc.pairs_cte('embeddings', 'vec_id', 'embedding', FIXTURE_EPS)},\n"
    f"verts AS (SELECT vec_id AS id FROM embeddings),\n{orc.components_ctes('verts', 'pairs')}",
    "SELECT id, component FROM cc"))(_q_connected_components)


def _dbscan(spark, sf_dir, min_samples):
    from murmur.operators.cluster import dbscan_cosine
    emb = _embeddings(spark, sf_dir).withColumn("pos", F.col("vec_id"))
    return dbscan_cosine(emb, pos_col="pos", vec_col="embedding", eps=FIXTURE_EPS, min_samples=min_samples,
                         block_rows=FIXTURE_BLOCK)


def _q_dbscan_cosine(spark, sf_dir):
    return _dbscan(spark, sf_dir, 3).select("vec_id", "cluster")


register("dbscan_cosine", _with_rec(orc.dbscan_ctes("embeddings", "vec_id", "embedding", FIXTURE_EPS, 3),
                                    "SELECT id AS vec_id, cluster FROM db"))(_q_dbscan_cosine)


def _q_cluster_batches(spark, sf_dir):
    """The same rows in three batches, in order of position."""
    from murmur.operators.batches import add_batch, batch_labels
    emb = _embeddings(spark, sf_dir).select(F.col("vec_id").alias("pos"), "embedding")
    top = emb.agg(F.max("pos")).first()[0] or 0
    state = None
    for lo, hi in ((None, top // 2), (top // 2, top * 3 // 4), (top * 3 // 4, None)):
        batch = emb.where((F.lit(lo is None) | (F.col("pos") > F.lit(lo))) & (F.lit(hi is None) | (F.col("pos") <= F.lit(hi))))
        state = add_batch(state, batch, eps=FIXTURE_EPS, min_samples=3, block_rows=FIXTURE_BLOCK)
    return batch_labels(state).withColumnRenamed("pos", "vec_id")


register("cluster_batches", _with_rec(orc.dbscan_ctes("embeddings", "vec_id", "embedding", FIXTURE_EPS, 3),
                                      "SELECT id AS vec_id, cluster FROM db"))(_q_cluster_batches)


def _q_approx_join_recall(spark, sf_dir):
    """The approximate join against the exact one."""
    from murmur.operators.approx import join_recall
    row = join_recall(_embeddings(spark, sf_dir), "vec_id", "embedding", eps=FIXTURE_EPS, recall=0.98)
    return row.select("exact_pairs", "wrong_pairs", "repeated_pairs", (F.col("measured_recall") >= 0.9).alias("recall_reached"))


register("approx_join_recall", _with(
    orc.pairs_cte("embeddings", "vec_id", "embedding", FIXTURE_EPS),
    "SELECT count(*) AS exact_pairs, CAST(0 AS BIGINT) AS wrong_pairs, CAST(0 AS BIGINT) AS repeated_pairs, "
    "TRUE AS recall_reached FROM pairs"))(_q_approx_join_recall)


def _q_number_clusters(spark, sf_dir):
    d = _dbscan(spark, sf_dir, 2)
    return d.where("cluster <> -1").groupBy("cluster").agg(
        F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("size"))


register("number_clusters", _with_rec(orc.dbscan_ctes("embeddings", "vec_id", "embedding", FIXTURE_EPS, 2),
                                      "SELECT cluster, min(id) AS first_id, count(*) AS size FROM db "
                                      "WHERE cluster <> -1 GROUP BY cluster"))(_q_number_clusters)


def _labelled_vectors(spark, sf_dir):
    emb = _embeddings(spark, sf_dir)
    return emb.select(F.col("vec_id").alias("pos"), F.col("vec_id").cast("string").alias("id"),
                      F.col("vec_id").cast("string").alias("text"), F.col("label").alias("cluster"), "embedding")


def _q_cluster_centroid(spark, sf_dir):
    from murmur.operators.insights import cluster_centroid
    c = cluster_centroid(_labelled_vectors(spark, sf_dir))
    return c.select(F.col("cluster").alias("label"), F.posexplode("centroid").alias("dim", "value")).select(
        "label", "dim", _round(F.col("value"), 9).alias("value"))


register("cluster_centroid", _with(orc.centroid_ctes("embeddings", "label", "embedding"),
                                   f"SELECT grp AS label, CAST(i - 1 AS INTEGER) AS dim, {orc.np_round('centroid[i]', 9)} AS value "
                                   "FROM cent, range(1, len(centroid) + 1) t(i) WHERE grp <> -1"))(_q_cluster_centroid)


def _q_representative_statement(spark, sf_dir):
    from murmur.operators.insights import representative_statement
    r = representative_statement(_labelled_vectors(spark, sf_dir))
    return r.select(F.col("cluster").alias("label"), F.col("representative_pos").alias("representative_id"))


register("representative_statement", _with(
    orc.centroid_ctes("embeddings", "label", "embedding"),
    f"""SELECT e.label, arg_max(e.vec_id, {{'s': {orc.np_round(orc.cosine('e.embedding', 'c.centroid'), 9)}, 'p': -e.vec_id}})
       AS representative_id
FROM embeddings e JOIN cent c ON c.grp = e.label WHERE e.label <> -1 GROUP BY e.label"""))(_q_representative_statement)


# ============================================================================
# A27: the whole analysis over F-feedback-vec
# ============================================================================
def _q_analyze_feedback(spark, sf_dir):
    from murmur.operators.insights import INSIGHT_COLUMNS, analyze_feedback
    ranked, _ = analyze_feedback(fx.feedback_vec_fixture(spark, sf_dir), eps=FIXTURE_EPS, min_samples=2)
    return ranked.where("chunk_no = 0").select("rank", *[F.array_join("sources", ", ").alias("sources") if c == "sources" else c
                                   for c in INSIGHT_COLUMNS])


def _q_analyze_evidence(spark, sf_dir):
    """All members that the insights carry, chunks of ``CHUNK``."""
    from murmur.operators.insights import analyze_feedback
    ranked, _ = analyze_feedback(fx.feedback_vec_fixture(spark, sf_dir), eps=FIXTURE_EPS, min_samples=2,
                                 evidence_chunk=CHUNK)
    items = ranked.select("rank", "cluster", "chunk_no", F.posexplode("supporting_feedback").alias("i", "f"))
    return items.select("rank", "cluster", (F.col("chunk_no") * CHUNK + F.col("i")).cast("long").alias("seq"), "f.*")


def _analyze_ctes() -> str:
    return f"""{orc.feedback_cte()},
fbv AS (SELECT fb.*, e.vec_id, e.embedding FROM fb JOIN embeddings e
        ON e.vec_id = fb.pos % (SELECT count(*) FROM embeddings)),
{orc.enriched_cte('fbv')},
vecs AS (SELECT min(pos) AS pos, vec_id, any_value(embedding) AS embedding, count(*) AS w FROM enr GROUP BY vec_id),
{orc.dbscan_ctes('vecs', 'pos', 'embedding', FIXTURE_EPS, 2, weight='w')},
clu AS (SELECT enr.*, db.cluster FROM enr JOIN vecs USING (vec_id) JOIN db ON db.id = vecs.pos),
{orc.scoring_ctes('clu')},
{orc.centroid_ctes("(SELECT * FROM clu WHERE cluster <> -1)", 'cluster', 'embedding')},
rep AS (
  SELECT k.cluster, arg_max(k.text, {{'s': {orc.np_round(orc.cosine('k.embedding', 'c.centroid'), 9)}, 'p': -k.pos}}) AS problem
  FROM clu k JOIN cent c ON c.grp = k.cluster GROUP BY k.cluster)"""


def _analyze_sql() -> str:
    return _with_rec(_analyze_ctes(), f"SELECT rank, i.{orc.INSIGHT_SQL_COLUMNS.replace('array_to_string(sources', 'array_to_string(i.sources')}, rep.problem "
                           "FROM insights i LEFT JOIN rep USING (cluster)")


register("analyze_feedback", _analyze_sql())(_q_analyze_feedback)
register("analyze_evidence", _with_rec(_analyze_ctes(), f"""SELECT i.rank, i.cluster, m.seq, m.id, m.source,
  strftime(m.date, '%Y-%m-%d') AS date, m.text, m.sentiment, m.severity
FROM insights i JOIN {_SEQ_SQL} m ON m.cluster = i.cluster"""))(_q_analyze_evidence)


# ============================================================================
# 2.1 / 2.2 sources and standardisation over F-messy, F-csv, F-json
# ============================================================================
def _std_out(df: DataFrame, with_pos: bool = False) -> DataFrame:
    cols = (["pos"] if with_pos else []) + ["id", "text", "source",
                                            F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date")]
    return df.select(*cols)


def _standardized(spark, sf_dir, **kw):
    from murmur.operators.standardize import standardize_feedback
    return standardize_feedback(fx.messy_fixture(spark, sf_dir, **kw), ingest_ts=fx.FIXTURE_INGEST_TS)


_MESSY_STD = f"""{orc.messy_cte()},
{orc.standardized_cte('messy', 'review', 'CAST(ticket_id AS VARCHAR)', 'channel', 'created_at')}"""


def _q_normalize_headers(spark, sf_dir):
    from murmur.operators.standardize import normalize_headers
    return normalize_headers(fx.messy_fixture(spark, sf_dir))


register("normalize_headers", _with(orc.messy_cte(), "SELECT review, ticket_id, channel, created_at FROM messy"))(
    _q_normalize_headers)


def _q_resolve_text_column(spark, sf_dir):
    from murmur.operators.standardize import normalize_headers, resolve_text_column
    df = normalize_headers(fx.messy_fixture(spark, sf_dir))
    name = resolve_text_column(df)
    return df.select(F.col("ticket_id").alias("pos"), F.lit(name).alias("text_column"), F.col(name).alias("text"))


register("resolve_text_column", _with(orc.messy_cte(), "SELECT pos, 'review' AS text_column, review AS text FROM messy"))(
    _q_resolve_text_column)


def _q_longest_text_column(spark, sf_dir):
    from murmur.operators.standardize import longest_text_column
    cust = fx.table(spark, sf_dir, "customer")
    name = longest_text_column(cust)
    return cust.select(F.col("c_custkey").alias("id"), F.lit(name).alias("text_column"), F.col(name).alias("text"))


register("longest_text_column", """WITH m AS (
  SELECT avg(coalesce(length(c_name), 3)) AS a1, avg(coalesce(length(c_mktsegment), 3)) AS a2 FROM customer),
pick AS (SELECT CASE WHEN a1 >= a2 THEN 'c_name' ELSE 'c_mktsegment' END AS col FROM m)
SELECT c_custkey AS id, (SELECT col FROM pick) AS text_column,
       CASE (SELECT col FROM pick) WHEN 'c_name' THEN c_name ELSE c_mktsegment END AS text
FROM customer""")(_q_longest_text_column)


def _q_assign_ids(spark, sf_dir):
    return _standardized(spark, sf_dir, drop="Ticket_ID").select("pos", "id")


register("assign_ids", _with(f"""{orc.messy_cte()},
{orc.standardized_cte('messy', 'review', 'CAST(pos + 1 AS VARCHAR)', 'channel', 'created_at')}""",
                             "SELECT pos, id FROM std"))(_q_assign_ids)


def _q_resolve_source(spark, sf_dir):
    a = _standardized(spark, sf_dir).select("id", "source", F.lit("channel").alias("variant"))
    b = _standardized(spark, sf_dir, drop="Channel").select("id", "source", F.lit("no_channel").alias("variant"))
    return a.unionByName(b)


register("resolve_source", _with(f"""{orc.messy_cte()},
{orc.standardized_cte('messy', 'review', 'CAST(ticket_id AS VARCHAR)', 'channel', 'created_at', 'a')},
{orc.standardized_cte('messy', 'review', 'CAST(ticket_id AS VARCHAR)', None, 'created_at', 'b')}""",
                                 "SELECT id, source, 'channel' AS variant FROM a UNION ALL "
                                 "SELECT id, source, 'no_channel' AS variant FROM b"))(_q_resolve_source)


def _q_resolve_date(spark, sf_dir):
    return _standardized(spark, sf_dir).select("id", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"))


register("resolve_date", _with(_MESSY_STD, "SELECT id, strftime(date, '%Y-%m-%d %H:%M:%S') AS date FROM std"))(
    _q_resolve_date)


def _q_clean_text(spark, sf_dir):
    return _standardized(spark, sf_dir).select("id", "text")


register("clean_text", _with(_MESSY_STD, "SELECT id, text FROM std"))(_q_clean_text)


def _q_standardize_feedback(spark, sf_dir):
    return _std_out(_standardized(spark, sf_dir), with_pos=True)


register("standardize_feedback", _with(_MESSY_STD, f"SELECT pos, {orc.STD_OUT} FROM std"))(_q_standardize_feedback)


def _q_validate_feedback(spark, sf_dir):
    from murmur.operators.standardize import feedback_violations, normalize_headers
    raw = feedback_violations(normalize_headers(fx.messy_fixture(spark, sf_dir)))
    std = feedback_violations(_standardized(spark, sf_dir))
    return raw.withColumn("table", F.lit("raw")).unionByName(std.withColumn("table", F.lit("standardized")))


register("validate_feedback", _with(_MESSY_STD, """SELECT 'missing_columns' AS rule, 'date, id, source, text' AS detail,
       'raw' AS "table" FROM (SELECT 1) t
UNION ALL SELECT 'no_rows', 'the table has no rows', 'standardized' FROM (SELECT count(*) AS n FROM std) WHERE n = 0"""))(
    _q_validate_feedback)


_WRITTEN: dict[tuple, str] = {}


def _fixture_path(spark, sf_dir, name, ext, write):
    """A file fixture, written once per application and input folder: later
    runs of a query only read it."""
    from murmur.session import scratch_path
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN:
        _WRITTEN[key] = write(spark, sf_dir, scratch_path(spark, name, ext))
    return _WRITTEN[key]


def _csv_path(spark, sf_dir):
    return _fixture_path(spark, sf_dir, "f-csv", ".csv", fx.write_csv_fixture)


def _json_path(spark, sf_dir):
    return _fixture_path(spark, sf_dir, "f-json", ".jsonl", fx.write_json_fixture)


def _q_read_csv_feedback(spark, sf_dir):
    from murmur.operators.standardize import standardize_feedback
    from murmur.sources.files import read_csv_feedback
    raw = read_csv_feedback(spark, _csv_path(spark, sf_dir))
    return _std_out(standardize_feedback(raw, ingest_ts=fx.FIXTURE_INGEST_TS), with_pos=True)


_CSV_STD = f"""{orc.messy_cte(csv_quirks=True)},
{orc.standardized_cte('messy', 'review', 'CAST(ticket_id AS VARCHAR)', 'channel', 'created_at')}"""
register("read_csv_feedback", _with(_CSV_STD, f"SELECT pos, {orc.STD_OUT} FROM std"))(_q_read_csv_feedback)


def _q_read_json_feedback(spark, sf_dir):
    from murmur.operators.standardize import standardize_feedback
    from murmur.sources.files import read_json_feedback
    raw = read_json_feedback(spark, _json_path(spark, sf_dir), layout="lines")
    return _std_out(standardize_feedback(raw, ingest_ts=fx.FIXTURE_INGEST_TS))


_JSON_STD = """jrec AS (
  SELECT event_id AS pos, CASE WHEN event_id % 11 <> 0 THEN 'json text ' || CAST(event_id AS VARCHAR) END AS comment,
         event_id AS review_id, CASE WHEN event_id % 5 <> 0 THEN event_type END AS channel,
         strftime(ts, '%Y-%m-%d %H:%M:%S') AS created
  FROM events),
""" + orc.standardized_cte("jrec", "comment", "CAST(review_id AS VARCHAR)", "channel", "created")
register("read_json_feedback", _with(_JSON_STD, f"SELECT {orc.STD_OUT} FROM std"))(_q_read_json_feedback)


def _q_read_json_document(spark, sf_dir):
    """S2: one document of all records, cut into records by many tasks."""
    from murmur.operators.standardize import standardize_feedback
    from murmur.sources.files import read_json_feedback
    path = _fixture_path(spark, sf_dir, "f-json-document", "", fx.write_json_document_fixture)
    raw = read_json_feedback(spark, path, layout="split")
    return _std_out(standardize_feedback(raw, ingest_ts=fx.FIXTURE_INGEST_TS), with_pos=True)


register("read_json_document", _with(_JSON_STD, f"SELECT pos, {orc.STD_OUT} FROM std"))(_q_read_json_document)


def _q_read_feedback(spark, sf_dir):
    from murmur.sources.files import read_feedback
    # two uploads whose headers differ in names and order
    other = _fixture_path(spark, sf_dir, "f-csv-turned", ".csv", fx.write_turned_csv_fixture)
    half = _fixture_path(spark, sf_dir, "f-csv-half", ".csv", lambda *a: fx.write_csv_fixture(*a, even=True))
    csv = read_feedback(spark, [half, other], ingest_ts=fx.FIXTURE_INGEST_TS)
    js = read_feedback(spark, _json_path(spark, sf_dir), ingest_ts=fx.FIXTURE_INGEST_TS)
    return _std_out(csv).withColumn("format", F.lit("csv")).unionByName(
        _std_out(js).withColumn("format", F.lit("json")))


register("read_feedback", _with(f"{_CSV_STD.replace('std', 'cstd')},\n{_JSON_STD.replace('std', 'jstd')}",
                                f"SELECT {orc.STD_OUT}, 'csv' AS format FROM cstd UNION ALL "
                                f"SELECT {orc.STD_OUT}, 'json' AS format FROM jstd"))(_q_read_feedback)


def _q_read_feedback_uploads(spark, sf_dir):
    """S6, P2 to P6 per upload: four headers that name their columns differently."""
    from murmur.sources.files import read_feedback
    path = _fixture_path(spark, sf_dir, "f-uploads", "", fx.write_uploads_fixture)
    paths = [f"{path}/{n}.csv" for n in range(len(fx.UPLOAD_HEADERS))]
    return _std_out(read_feedback(spark, paths, ingest_ts=fx.FIXTURE_INGEST_TS))


register("read_feedback_uploads", _with(_CSV_STD, f"""SELECT id, text,
  CASE WHEN pos % 4 = 3 THEN 'uploaded_file' ELSE source END AS source,
  CASE WHEN pos % 4 = 3 THEN '{fx.FIXTURE_INGEST_TS}' ELSE strftime(date, '%Y-%m-%d %H:%M:%S') END AS date FROM std"""))(
    _q_read_feedback_uploads)


def _q_write_feedback(spark, sf_dir):
    from murmur.operators.report import write_feedback
    from murmur.sources.files import read_feedback
    from murmur.session import scratch_path
    path = scratch_path(spark, "feedback")
    std = _standardized(spark, sf_dir)
    write_feedback(std, path)
    as_csv = scratch_path(spark, "feedback", ".csv")
    write_feedback(std.select("id", "text", "source", "date"), as_csv, fmt="csv")
    back = read_feedback(spark, as_csv, ingest_ts="1999-01-01 00:00:00")
    return _std_out(spark.read.parquet(path)).withColumn("format", F.lit("parquet")).unionByName(
        _std_out(back).withColumn("format", F.lit("csv")))


register("write_feedback", _with(_MESSY_STD, f"SELECT {orc.STD_OUT}, 'parquet' AS format FROM std "
                                             f"UNION ALL SELECT {orc.STD_OUT}, 'csv' FROM std"))(_q_write_feedback)


def _q_store_feedback(spark, sf_dir):
    """D5 as a store: written, read, changed and written back to its own path."""
    from murmur.session import scratch_path
    from murmur.sources.store import load_table, save_table
    path = scratch_path(spark, "feedback-store")
    save_table(_standardized(spark, sf_dir), path)
    save_table(load_table(spark, path).withColumn("source", F.upper("source")), path)
    return _std_out(load_table(spark, path))


register("store_feedback", _with(_MESSY_STD, f"SELECT {orc.STD_OUT.replace('source', 'upper(source) AS source')} FROM std"))(
    _q_store_feedback)


def _q_evidence_store(spark, sf_dir):
    """D6 from the store: the rows of the top insight, from its folder alone."""
    from murmur.session import scratch_path
    from murmur.sources.store import open_evidence, save_evidence
    path = scratch_path(spark, "evidence-store")
    save_evidence(_evidence(spark, sf_dir), path)
    top = _ranked(spark, sf_dir).where("rank = 1").select("cluster").first()   # one row
    return open_evidence(spark, path, top["cluster"]).select("cluster", "pos", "id", "source", "date", "text")


register("evidence_store", ORACLE["trace_evidence"])(_q_evidence_store)


# ============================================================================
# 2.1 segmenters over ``documents``
# ============================================================================
def _q_text_lines_feedback(spark, sf_dir):
    from murmur.sources.segment import text_lines_feedback
    docs = fx.table(spark, sf_dir, "documents")
    return text_lines_feedback(docs, ingest_ts=fx.FIXTURE_INGEST_TS).select("doc_id", "id", "text", "source")


register("text_lines_feedback", orc.text_lines_sql("documents"))(_q_text_lines_feedback)


def _q_paragraph_feedback(spark, sf_dir):
    from murmur.sources.segment import paragraph_feedback
    docs = fx.paragraphs_fixture(spark, sf_dir)
    return paragraph_feedback(docs, ingest_ts=fx.FIXTURE_INGEST_TS).select("doc_id", "id", "text", "source")


def _paragraph_sql():
    from murmur.sources.segment import PARAGRAPH_BREAK_REGEX
    return _with(orc.paragraphs_fixture_cte(), orc.paragraphs_sql("para", PARAGRAPH_BREAK_REGEX))


register("paragraph_feedback", _paragraph_sql())(_q_paragraph_feedback)


def _q_page_line_feedback(spark, sf_dir):
    from murmur.sources.segment import page_line_feedback
    pages = fx.pages_fixture(spark, sf_dir)
    return page_line_feedback(pages, ingest_ts=fx.FIXTURE_INGEST_TS).select("doc_id", "id", "text", "source")


def _page_sql():
    from murmur.sources.segment import BULLET_REGEX, NUMBERING_REGEX
    return _with(f"{orc.pages_fixture_cte()},\n{orc.page_lines_ctes('pg', BULLET_REGEX, NUMBERING_REGEX)}",
                 "SELECT doc_id, CAST(off + i AS VARCHAR) AS id, s[i] AS text, 'pdf_page_' || CAST(page_no AS VARCHAR) AS source "
                 "FROM s5d, range(1, len(s) + 1) t(i)")


register("page_line_feedback", _page_sql())(_q_page_line_feedback)


# ============================================================================
# 2.6 sanitising and JSON; 2.3 Spark ML scorers (rows-only checks)
# ============================================================================
def _nonfinite(spark, sf_dir):
    ev = fx.table(spark, sf_dir, "events")
    pos = F.col("event_id")
    bad = (F.when(pos % 7 == 1, F.lit(float("nan"))).when(pos % 7 == 2, F.lit(float("inf")))
           .when(pos % 7 == 3, F.lit(float("-inf"))).otherwise(F.col("value")))
    return ev.select(
        "event_id",
        bad.alias("value"),
        F.when(pos % 5 != 0, F.struct(bad.alias("v"), F.col("event_type").alias("t"))).alias("nested"),
        F.array(F.col("value"), bad, F.lit(float("nan"))).alias("arr"),
        F.when(pos % 2 == 0, F.date_trunc("second", "ts")).otherwise(F.col("ts")).alias("ts"),
    )


def _q_sanitize_nonfinite(spark, sf_dir):
    from murmur.operators.report import sanitize_nonfinite
    s = sanitize_nonfinite(_nonfinite(spark, sf_dir))
    return s.select(
        "event_id", "value", F.col("nested").isNull().alias("no_nested"),
        F.col("nested.v").alias("nested_v"), F.col("nested.t").alias("nested_t"),
        F.size(F.filter("arr", lambda x: x.isNull())).alias("arr_nulls"),
        F.aggregate(F.filter("arr", lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x).alias("arr_sum"),
        "ts")


register("sanitize_nonfinite", """WITH b AS (
  SELECT event_id, value AS raw, event_type,
         CASE WHEN event_id % 7 IN (1, 2, 3) THEN NULL ELSE value END AS v,
         CASE WHEN event_id % 2 = 0 THEN date_trunc('second', ts) ELSE ts END AS t
  FROM events)
SELECT event_id, v AS value, event_id % 5 = 0 AS no_nested, CASE WHEN event_id % 5 <> 0 THEN v END AS nested_v,
       CASE WHEN event_id % 5 <> 0 THEN event_type END AS nested_t,
       CASE WHEN v IS NULL THEN 2 ELSE 1 END AS arr_nulls,
       CASE WHEN v IS NULL THEN raw ELSE raw + v END AS arr_sum,
       CASE WHEN microsecond(t) % 1000000 = 0 THEN strftime(t, '%Y-%m-%dT%H:%M:%S')
            ELSE strftime(t, '%Y-%m-%dT%H:%M:%S.%f') END AS ts
FROM b""")(_q_sanitize_nonfinite)


def _q_insights_json(spark, sf_dir):
    from murmur.operators.insights import score_clusters
    from murmur.operators.report import insights_json
    return insights_json(score_clusters(_clustered(spark, sf_dir)))


_JSON_COLS = ("cluster", "problem_summary", "observed_pattern", "customer_impact", "theme", "signal_strength",
              "priority", "priority_score", "severity", "severity_score", "evidence_score", "evidence_count",
              "negative_evidence", "negative_ratio", "sources", "source_count", "first_seen", "last_seen",
              "time_span_days")
register("insights_json", _with(_ALL, "SELECT CAST(to_json({" + ", ".join(f"'{c}': {c}" for c in _JSON_COLS)
                                + "}) AS VARCHAR) AS json FROM insights"))(_q_insights_json)


def _labelled_documents(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = fx.table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return docs, docs.join(labels, "doc_id")


_TERMS = r"""tok AS (
  SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda w: w <> '')) AS term FROM documents),
tc AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL)"""


def _q_embed_terms(spark, sf_dir):
    from murmur.operators.enrich import embed_terms
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "text")
    return embed_terms(docs).select("doc_id", "term", _round(F.col("weight"), 6).alias("weight"))


register("embed_terms", _with(_TERMS + """,
sp AS (SELECT term, count(*) AS df FROM tc GROUP BY term),
raw AS (SELECT doc_id, term, tf * ln(CAST((SELECT count(*) FROM documents) + 1 AS DOUBLE) / (df + 1)) AS w FROM tc JOIN sp USING (term)),
nrm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM raw WHERE w > 0 GROUP BY doc_id)""",
                              f"SELECT doc_id, term, {orc.np_round('w / norm', 6)} AS weight FROM raw JOIN nrm USING (doc_id) "
                              "WHERE w > 0"))(_q_embed_terms)


def _q_score_sentiment_bayes(spark, sf_dir):
    from murmur.operators.enrich import score_sentiment_bayes
    docs, train = _labelled_documents(spark, sf_dir)
    labels = train.select("doc_id", "label")
    return score_sentiment_bayes(docs, labels).select(
        "doc_id", "sentiment", _round(F.col("sentiment_score"), 6).alias("sentiment_score"))


register("score_sentiment_bayes", _with(_TERMS + """,
bt AS (SELECT term, sum(CASE WHEN toxic = 1 THEN tf ELSE 0 END) AS n1, sum(CASE WHEN toxic = 0 THEN tf ELSE 0 END) AS n0
       FROM tc JOIN labels USING (doc_id) GROUP BY term),
tt AS (SELECT CAST(sum(n1) AS DOUBLE) AS t1, CAST(sum(n0) AS DOUBLE) AS t0, count(*) AS v FROM bt),
pr AS (SELECT ln((sum(toxic) + 1.0) / (count(*) - sum(toxic) + 1.0)) AS prior FROM labels JOIN documents USING (doc_id)),
wt AS (SELECT term, ln((n1 + 1.0) / (t1 + v)) - ln((n0 + 1.0) / (t0 + v)) AS r FROM bt, tt),
sm AS (SELECT doc_id, sum(tf * r) AS s FROM tc JOIN wt USING (term) GROUP BY doc_id),
z AS (SELECT doc_id, coalesce(s, 0.0) + prior AS z FROM documents LEFT JOIN sm USING (doc_id), pr)""",
                              f"""SELECT doc_id, CASE WHEN z > 0 THEN 'negative' ELSE 'positive' END AS sentiment,
  {orc.np_round('greatest(1.0 / (1.0 + exp(-z)), 1.0 - 1.0 / (1.0 + exp(-z)))', 6)} AS sentiment_score FROM z"""))(
    _q_score_sentiment_bayes)


# --- dense halves of E2 and E3: sketch embedding and a linear model on it --------------
SKETCH_ROUNDS, SKETCH_RATE = 8, 32.0


def _q_embed_text(spark, sf_dir):
    from murmur.operators.enrich import embed_sketch
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "text")
    return embed_sketch(docs).select("doc_id", F.posexplode("embedding").alias("dim", "value")).where("value <> 0").select(
        "doc_id", "dim", _round(F.col("value"), 6).alias("value")).where("value <> 0")


def _q_score_sentiment_model(spark, sf_dir):
    """Fitted on the labelled documents, applied to all."""
    from murmur.operators.enrich import embed_sketch, fit_sentiment_linear, score_sentiment_linear
    from murmur.session import cut_lineage
    docs, train = _labelled_documents(spark, sf_dir)
    vectors = cut_lineage(embed_sketch(docs))
    weights, bias = fit_sentiment_linear(vectors.join(train.select("doc_id", "label"), "doc_id"),
                                         rounds=SKETCH_ROUNDS, rate=SKETCH_RATE)
    return score_sentiment_linear(vectors, weights, bias).select(
        "doc_id", "sentiment", _round(F.col("sentiment_score"), 6).alias("sentiment_score"))


_HEX = "instr('0123456789abcdef', substr(md5(term), {i}, 1)) - 1"
_SKETCH = _TERMS + """,
sp AS (SELECT term, count(*) AS df FROM tc GROUP BY term),
raw AS (SELECT doc_id, term, tf * ln(CAST((SELECT count(*) FROM documents) + 1 AS DOUBLE) / (df + 1)) AS w FROM tc JOIN sp USING (term)),
sk AS (SELECT doc_id, CAST((""" + " + ".join(f"({_HEX.format(i=i + 1)}) * {16 ** (6 - i)}" for i in range(7)) + f""") % 384 AS INTEGER) AS dim,
    sum(CASE WHEN ({_HEX.format(i=8)}) % 2 = 0 THEN w ELSE -w END) AS s FROM raw WHERE w > 0 GROUP BY 1, 2),
nrm AS (SELECT doc_id, sqrt(sum(s * s)) AS norm FROM sk GROUP BY doc_id),
x AS MATERIALIZED (SELECT doc_id, dim, s / norm AS v FROM sk JOIN nrm USING (doc_id) WHERE s <> 0)"""
register("embed_text", _with(_SKETCH, f"SELECT doc_id, dim, {orc.np_round('v', 6)} AS value FROM x "
                                      f"WHERE {orc.np_round('v', 6)} <> 0"))(_q_embed_text)


def _linear_sql() -> str:
    """The gradient steps one by one; dimension 384 is the intercept."""
    steps = ["""lab AS MATERIALIZED (SELECT doc_id, toxic AS y FROM labels JOIN documents USING (doc_id) WHERE toxic IN (0, 1)),
xb AS MATERIALIZED (SELECT doc_id, dim, v FROM x UNION ALL SELECT doc_id, 384, 1.0 FROM documents),
w0 AS MATERIALIZED (SELECT i AS dim, 0.0::DOUBLE AS w FROM range(385) t(i))"""]
    for k in range(SKETCH_ROUNDS):
        steps.append(f"""w{k + 1} AS MATERIALIZED (SELECT dim, w - coalesce(g, 0) * {SKETCH_RATE} / (SELECT count(*) FROM lab) AS w FROM w{k} LEFT JOIN (
  SELECT xb.dim, sum((p - y) * v) AS g FROM xb JOIN lab USING (doc_id) JOIN (
    SELECT doc_id, 1 / (1 + exp(-sum(v * w))) AS p FROM xb JOIN lab USING (doc_id) JOIN w{k} USING (dim) GROUP BY doc_id) USING (doc_id)
  GROUP BY xb.dim) USING (dim))""")
    steps.append(f"pr AS (SELECT doc_id, 1 / (1 + exp(-sum(v * w))) AS p FROM xb JOIN w{SKETCH_ROUNDS} USING (dim) GROUP BY doc_id)")
    return _with(_SKETCH + ",\n" + ",\n".join(steps),
                 "SELECT doc_id, CASE WHEN p > 0.5 THEN 'negative' ELSE 'positive' END AS sentiment, "
                 f"{orc.np_round('greatest(p, 1 - p)', 6)} AS sentiment_score FROM pr")


register("score_sentiment_model", _linear_sql())(_q_score_sentiment_model)
