"""Cluster aggregation, scoring, themes and ranking (A1-A27).

One ``groupBy(cluster)`` pass computes every per-cluster feature (partial
aggregation before the shuffle, so a hot cluster costs one partial row per
task). Dataset-wide figures (largest cluster, distinct sources, dataset time
span) are scalar subqueries: computed once and inlined, never joined.

Input columns: ``pos`` (row order), ``id``, ``text``, ``source``, ``date``
(timestamp), ``sentiment``, ``severity``, ``severity_score``, ``cluster``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions import lexicon as lx
from murmur.functions import vectors as vx
from murmur.functions.indexing import with_ordinal
from murmur.functions.joins import lookup_of
from murmur.functions.numeric import np_round, whole_days_between
from murmur.session import cut_lineage

NOISE = -1


def _kw(word: str) -> str:
    return "kw_" + word


HEAVY_CLUSTERS = 2_000    # of these the figures are broadcast to the members


def _spread_join(members: DataFrame, figures: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Members with the figures (``values``, one row a cluster, ``_n`` members) of
    their cluster. Members of the largest clusters are not moved, so that no
    cluster is ever one task."""
    return lookup_of(figures, keys, values, "_n", whole_rows=HEAVY_CLUSTERS, heavy_keys=HEAVY_CLUSTERS)(members)


# --- A1 --------------------------------------------------------------------------
def drop_noise(df: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    return df.where(F.col(cluster_col) != NOISE)


# --- A2, A3, A6, A7, A9, A14, A19, A20 in one aggregation -------------------------
def _dominant(counts_and_first) -> Column:
    """Most frequent label; ties go to the label seen first (lowest pos)."""
    cands = [F.struct(n.alias("n"), F.coalesce(-first, F.lit(-(2 ** 62))).alias("f"), F.lit(lab).alias("label"))
             for lab, n, first in counts_and_first]
    return F.array_max(F.array(*cands)).getField("label")


def _keys(cluster_col: str, group_col: str | None):
    key = [F.col(cluster_col).alias("cluster")]
    return ([F.col(group_col)] + key) if group_col else key


LEVELS = ("HIGH", "MEDIUM", "LOW")


def source_features(df: DataFrame, cluster_col: str = "cluster", keywords=lx.THEME_KEYWORDS,
                    group_col: str | None = None) -> DataFrame:
    """One row per (group,) cluster and source, noise included: the one scan
    behind all cluster and dataset figures. The flat (cluster, source) table
    is the scalable form of the source lists."""
    lower = F.lower(F.col("text"))
    tenths = (F.when(F.col("severity") == "HIGH", lx.SEVERITY_TENTHS["HIGH"])
              .when(F.col("severity") == "MEDIUM", lx.SEVERITY_TENTHS["MEDIUM"])
              .otherwise(lx.SEVERITY_TENTHS["LOW"]))
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("sentiment") == "negative").alias("negative"),
        F.min("date").alias("first"),
        F.max("date").alias("last"),
        F.sum(tenths).alias("tenths"),
    ]
    for lev in LEVELS:
        aggs.append(F.count_if(F.col("severity") == lev).alias("_n_" + lev))
        aggs.append(F.min(F.when(F.col("severity") == lev, F.col("pos"))).alias("_first_" + lev))
    aggs += [F.bool_or(lower.contains(w)).alias(_kw(w)) for w in keywords]
    return df.groupBy(*_keys(cluster_col, group_col), F.col("source")).agg(*aggs)


def _cluster_rows(per_source: DataFrame, keywords=lx.THEME_KEYWORDS, group_col: str | None = None) -> DataFrame:
    """Cluster features from :func:`source_features`: the arrays are built
    from one row per distinct source."""
    aggs = [
        F.sum("n").alias("evidence_count"),
        F.sum("negative").alias("negative_evidence"),
        F.array_sort(F.collect_list("source")).alias("sources"),
        F.min("first").alias("first_seen_ts"),
        F.max("last").alias("last_seen_ts"),
        F.sum("tenths").alias("severity_tenths"),
    ]
    for lev in LEVELS:
        aggs += [F.sum("_n_" + lev).alias("_n_" + lev), F.min("_first_" + lev).alias("_first_" + lev)]
    aggs += [F.bool_or(_kw(w)).alias(_kw(w)) for w in keywords]
    lead = [group_col] if group_col else []
    per = drop_noise(per_source).groupBy(*lead, "cluster").agg(*aggs)
    per = per.withColumn("severity", _dominant([(lev, F.col("_n_" + lev), F.col("_first_" + lev)) for lev in LEVELS]))
    per = per.withColumn("source_count", F.size("sources").cast("long"))
    return per.drop(*[f"_n_{lev}" for lev in LEVELS], *[f"_first_{lev}" for lev in LEVELS])


def cluster_features(df: DataFrame, cluster_col: str = "cluster", keywords=lx.THEME_KEYWORDS,
                     group_col: str | None = None) -> DataFrame:
    """One row per non-noise cluster (per group) with its raw evidence features."""
    return _cluster_rows(source_features(df, cluster_col, keywords, group_col), keywords, group_col)


# --- themes (A20-A23) ----------------------------------------------------------------
def _any(*words) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | F.col(_kw(w))
    return cond


def _theme_cases():
    export = _any("export", "download") & _any("fail", "failure", "cannot", "unable", "error", "crash")
    slow = _any("load", "opening", "start") & F.col(_kw("slow"))
    summary = [
        ("UPLOAD_FAILURE", F.col(_kw("upload")) & _any("pdf", "document") & _any("crash", "freeze")),
        ("SLOW_STARTUP", slow),
        ("SUPPORT_DELAY", F.col(_kw("support")) & _any("days", "week", "reply", "response")),
        ("EXPORT_FAILURE", export),
    ]
    pattern = [
        ("UPLOAD_FAILURE", F.col(_kw("upload")) & _any("crash", "freeze")),
        ("SLOW_STARTUP", slow),
        ("SUPPORT_DELAY", F.col(_kw("support")) & _any("days", "week", "response", "reply")),
        ("EXPORT_FAILURE", export),
    ]
    impact = [
        ("UPLOAD_FAILURE", F.col(_kw("upload")) & _any("crash", "freeze")),
        ("SLOW_STARTUP", slow),
        ("SUPPORT_DELAY", F.col(_kw("support")) & _any("days", "week", "response")),
        ("EXPORT_FAILURE", export),
    ]
    return summary, pattern, impact


def _first_match(cases) -> Column:
    expr = None
    for code, cond in cases:
        expr = F.when(cond, F.lit(code)) if expr is None else expr.when(cond, F.lit(code))
    return expr.otherwise(F.lit("GENERIC"))


def _lookup(code: Column, table: dict) -> Column:
    expr = None
    for k, v in table.items():
        expr = F.when(code == k, F.lit(v)) if expr is None else expr.when(code == k, F.lit(v))
    return expr


def describe_clusters(per: DataFrame) -> DataFrame:
    """A21-A23: theme code plus summary, observed pattern (with the sorted
    source list) and customer impact."""
    summary, pattern, impact = _theme_cases()
    out = per.withColumns({
        "theme": _first_match(summary),
        "_pattern_theme": _first_match(pattern),
        "_impact_theme": _first_match(impact),
    })
    return out.withColumns({
        "problem_summary": _lookup(F.col("theme"), lx.THEME_SUMMARY),
        "observed_pattern": F.replace(_lookup(F.col("_pattern_theme"), lx.THEME_PATTERN),
                                      F.lit("%s"), F.array_join("sources", ", ")),
        "customer_impact": _lookup(F.col("_impact_theme"), lx.THEME_IMPACT),
    }).drop("_pattern_theme", "_impact_theme")


# --- A4-A13, A24, A25 -------------------------------------------------------------------
INSIGHT_COLUMNS = [
    "cluster", "problem", "problem_summary", "observed_pattern", "customer_impact", "theme",
    "signal_strength", "priority", "priority_score", "severity", "severity_score", "evidence_score",
    "evidence_count", "negative_evidence", "negative_ratio", "sources", "source_count",
    "first_seen", "last_seen", "time_span_days",
]


def raw_cluster_scores(df: DataFrame, cluster_col: str = "cluster", group_col: str | None = None) -> DataFrame:
    """A2-A10, A12 unrounded, for every non-noise cluster (before A4).

    One scan gives the per-(cluster, source) table, noise included; it is
    checkpointed, and cluster rows, the largest cluster and the dataset
    figures are small aggregates of it: scalar subqueries for one dataset,
    per-group rows joined on the group key with ``group_col``."""
    from murmur.session import cut_lineage

    per_source = cut_lineage(source_features(df, cluster_col, group_col=group_col))
    per = _cluster_rows(per_source, group_col=group_col)
    figures = F.struct(
        F.count_distinct("source").alias("sources"),
        whole_days_between(F.min("first"), F.max("last")).alias("span"),
    )
    if group_col is None:
        dataset = per_source.select(figures.alias("g")).scalar()
        # A5: the largest cluster includes positive-only clusters
        sizes = drop_noise(per_source).groupBy("cluster").agg(F.sum("n").alias("n"))
        s = per.withColumns({"_g": dataset, "_max": sizes.select(F.max("n")).scalar()})
    else:
        by_group = per_source.groupBy(group_col).agg(figures.alias("_g"))
        largest = drop_noise(per_source).groupBy(group_col, "cluster").agg(F.sum("n").alias("n")).groupBy(
            group_col).agg(F.max("n").alias("_max"))
        s = per.join(by_group, group_col).join(largest, group_col)

    n = F.col("evidence_count")
    s = s.withColumns({
        "frequency_score": n / F.col("_max"),
        "negative_ratio_raw": F.col("negative_evidence") / n,
        "source_diversity": F.col("source_count") / F.col("_g.sources"),
        "time_span_days": whole_days_between(F.col("first_seen_ts"), F.col("last_seen_ts")),
        "severity_raw": F.col("severity_tenths") / F.lit(10.0) / n,
    })
    s = s.withColumn("temporal_score", F.when(F.col("_g.span") > 0, F.col("time_span_days") / F.col("_g.span"))
                     .otherwise(F.lit(0.0)))
    s = s.withColumn("evidence_raw",
                     F.lit(0.25) * F.col("frequency_score") + F.lit(0.25) * F.col("negative_ratio_raw")
                     + F.lit(0.15) * F.col("source_diversity") + F.lit(0.15) * F.col("temporal_score")
                     + F.lit(0.20) * F.col("severity_raw"))
    s = s.withColumn("priority_raw", F.lit(0.50) * F.col("evidence_raw") + F.lit(0.50) * F.col("severity_raw"))
    return s.drop("_g", "_max")


def finalize_scores(raw: DataFrame) -> DataFrame:
    """A4 (drop positive-only), A11, A13, A24 and the descriptions."""
    s = raw.where(F.col("negative_evidence") > 0)
    s = s.withColumns({
        "signal_strength": F.when(F.col("evidence_raw") >= 0.70, F.lit("STRONG SIGNAL")).otherwise(F.lit("WEAK SIGNAL")),
        "priority": F.when(F.col("priority_raw") >= 0.80, F.lit("HIGH"))
        .when(F.col("priority_raw") >= 0.60, F.lit("MEDIUM")).otherwise(F.lit("LOW")),
        "priority_score": np_round("priority_raw"),
        "severity_score": np_round("severity_raw"),
        "evidence_score": np_round("evidence_raw"),
        "negative_ratio": np_round("negative_ratio_raw"),
        "first_seen": F.date_format("first_seen_ts", "yyyy-MM-dd"),
        "last_seen": F.date_format("last_seen_ts", "yyyy-MM-dd"),
    })
    return describe_clusters(s)


def score_clusters(df: DataFrame, cluster_col: str = "cluster", keep_raw: bool = False,
                   group_col: str | None = None) -> DataFrame:
    """A25: one scored row per retained cluster (positive-only clusters are
    dropped after they set the largest-cluster size); per group when
    ``group_col`` is given."""
    s = finalize_scores(raw_cluster_scores(df, cluster_col, group_col=group_col))
    if keep_raw:
        return s
    lead = [group_col] if group_col else []
    return s.select(*lead, *[c for c in INSIGHT_COLUMNS if c != "problem"])


# --- A15, A16 ----------------------------------------------------------------------------
def cluster_centroid(df: DataFrame, cluster_col: str = "cluster", vec_col: str = "embedding",
                     group_col: str | None = None) -> DataFrame:
    """Element-wise mean vector per cluster (``Summarizer.mean``: a partial
    aggregate, so a hot cluster is combined map-side)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    lead = [group_col] if group_col else []
    return (
        drop_noise(df, cluster_col)
        .groupBy(*_keys(cluster_col, group_col))
        .agg(Summarizer.mean(array_to_vector(F.col(vec_col))).alias("_c"))
        .select(*lead, "cluster", vector_to_array("_c").alias("centroid"))
    )


def representative_statement(df: DataFrame, cluster_col: str = "cluster", vec_col: str = "embedding",
                             text_col: str = "text", group_col: str | None = None) -> DataFrame:
    """Per cluster, the member closest (cosine) to the centroid; similarity
    rounded to 9 digits, then lowest ``pos`` wins ties."""
    cents = cluster_centroid(df, cluster_col, vec_col, group_col=group_col)
    lead = [group_col] if group_col else []
    keys = [*lead, "cluster"]
    # rows of one vector are equally near: only the first of them is compared
    members = cut_lineage(drop_noise(df, cluster_col).groupBy(
        *_keys(cluster_col, group_col), F.col(vec_col).alias("_v")).agg(F.min("pos").alias("pos")))
    sizes = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    # whole billionths, so that ties are ties
    sim = F.coalesce(F.rint(vx.cosine("_v", "centroid") * F.lit(1e9)).cast("long"), F.lit(-(2 ** 62)))
    near = _spread_join(members, cents.join(sizes, keys), keys, ["centroid"]).select(
        *keys, F.struct(sim.alias("s"), (-F.col("pos")).alias("p")).alias("_b"))
    first = near.groupBy(*keys).agg(F.max("_b").alias("_b")).select(*keys, (-F.col("_b.p")).alias("pos"))
    # the text is fetched for one row a cluster
    rows = drop_noise(df, cluster_col).select(
        *lead, F.col(cluster_col).alias("cluster"), "pos", F.col(text_col).alias("problem"),
        F.col("id").alias("representative_id"))
    return rows.join(first, [*keys, "pos"]).select(
        *keys, "problem", "representative_id", F.col("pos").alias("representative_pos"))


# --- A17, A18: evidence -------------------------------------------------------------------
EVIDENCE_CHUNK = 10_000   # members in one array row of nested_evidence


def evidence_table(df: DataFrame, cluster_col: str = "cluster", group_col: str | None = None) -> DataFrame:
    """Flat form of supporting feedback, the scalable primary form: one row per
    (cluster, member), rows told apart by ``pos``. :func:`numbered_evidence`
    adds the member's place in its cluster."""
    lead = [group_col] if group_col else []
    return drop_noise(df, cluster_col).select(
        *lead, F.col(cluster_col).alias("cluster"), "pos", "id", "source",
        F.date_format("date", "yyyy-MM-dd").alias("date"), "text", "sentiment", "severity")


def numbered_evidence(df: DataFrame, cluster_col: str = "cluster", group_col: str | None = None) -> DataFrame:
    """:func:`evidence_table` with ``seq``, the member's place in its cluster
    by ``pos`` (from 0): a distributed ordinal over (cluster, pos) minus the
    cluster's first, so no cluster is ever one task."""
    keys = ([group_col] if group_col else []) + ["cluster"]
    ordered = with_ordinal(evidence_table(df, cluster_col, group_col=group_col), "_o", [*keys, "pos"], start=0)
    first = ordered.groupBy(*keys).agg(F.min("_o").alias("_o0"), F.count(F.lit(1)).alias("_n"))
    return _spread_join(ordered, first, keys, ["_o0"]).withColumn("seq", F.col("_o") - F.col("_o0")).drop("_o", "_o0")


def nested_evidence(df: DataFrame, cluster_col: str = "cluster", chunk: int = EVIDENCE_CHUNK,
                    group_col: str | None = None) -> DataFrame:
    """``supporting_feedback_ids`` and ``supporting_feedback`` arrays in row
    order, ``chunk`` members a row: ``(cluster, chunk_no, arrays)``. All
    members are kept; a cluster of at most ``chunk`` members is one row."""
    keys = ([group_col] if group_col else []) + ["cluster"]
    fields = ("id", "source", "date", "text", "sentiment", "severity")
    ev = numbered_evidence(df, cluster_col, group_col).withColumn(
        "chunk_no", F.floor(F.col("seq") / F.lit(chunk)).cast("int"))
    nested = ev.groupBy(*keys, "chunk_no").agg(
        F.array_sort(F.collect_list(F.struct("seq", *fields))).alias("_items"))
    return nested.select(
        *keys, "chunk_no",
        F.transform("_items", lambda x: x.getField("id")).alias("supporting_feedback_ids"),
        F.transform("_items", lambda x: F.struct(*[x.getField(f).alias(f) for f in fields]))
        .alias("supporting_feedback"),
    )


# --- A26 -------------------------------------------------------------------------------------
def rank_insights(insights: DataFrame, top: int | None = None, group_col: str | None = None) -> DataFrame:
    """Sort by rounded priority descending, ties by cluster ascending, with an
    explicit 1-based ``rank`` (restarting in every group with ``group_col``);
    ``top`` turns it into a top-k report."""
    if group_col is None:
        ranked = with_ordinal(insights, "rank", [F.desc("priority_score"), F.asc("cluster")], start=1)
        order = ["rank"]
    else:
        ordered = with_ordinal(insights, "_o", [F.asc(group_col), F.desc("priority_score"), F.asc("cluster")], start=0)
        first = ordered.groupBy(group_col).agg(F.min("_o").alias("_o0"))
        ranked = ordered.join(first, group_col).withColumn("rank", F.col("_o") - F.col("_o0") + 1).drop("_o", "_o0")
        order = [group_col, "rank"]
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.orderBy(*order)


# --- A27 -------------------------------------------------------------------------------------
def analyze_feedback(feedback: DataFrame, sentiment=None, embedder=None, eps: float = 0.35,
                     min_samples: int = 2, vec_col: str = "embedding", block_rows: int | None = None,
                     group_col: str | None = None, evidence_chunk: int = EVIDENCE_CHUNK):
    """End to end: enrich, cluster, score, describe, pick representatives and
    rank. ``feedback`` has ``pos, id, text, source, date`` and either a vector
    column or an ``embedder`` (df -> df + vec_col). Returns
    ``(insights, enriched)``. Insights carry ``supporting_feedback_ids`` and
    ``supporting_feedback``, arrays of ``evidence_chunk`` members a row: an
    insight with more members has a row for each ``chunk_no`` (from 0), equal
    in all other columns, so every member is there and no row is without
    bound; ``chunk_no = 0`` is one row an insight. With
    ``group_col`` every dataset is analysed on its own (clusters, scores,
    ranks per dataset), all datasets in the same distributed jobs; ``pos``
    must be unique overall."""
    from murmur.operators.cluster import dbscan_cosine
    from murmur.operators.enrich import detect_severity, score_sentiment
    from murmur.session import cut_lineage

    df = feedback
    if embedder is not None:
        df = embedder(df)
    lead = [group_col] if group_col else []
    # materialised once: embedding / model inference never runs twice
    df = cut_lineage(detect_severity((sentiment or score_sentiment)(df)))
    # clustering reads only (pos, vector); its labels are narrow
    labels = cut_lineage(dbscan_cosine(
        df.select(*lead, "pos", vec_col), pos_col="pos", vec_col=vec_col, eps=eps, min_samples=min_samples,
        block_rows=block_rows, group_col=group_col, input_materialized=True).select("pos", "cluster"))
    enriched = df.join(labels, "pos")
    scored = score_clusters(enriched.drop(vec_col), group_col=group_col)
    reps = representative_statement(enriched, vec_col=vec_col, group_col=group_col).select(*lead, "cluster", "problem")
    # ranked before the evidence is attached: a rank is an insight's, not a chunk's
    ranked = rank_insights(scored.join(reps, lead + ["cluster"], "left").select(*lead, *INSIGHT_COLUMNS),
                           group_col=group_col)
    nested = nested_evidence(enriched.drop(vec_col), chunk=evidence_chunk, group_col=group_col)
    values = [c for c in INSIGHT_COLUMNS if c != "cluster"] + ["rank"]
    insights = _spread_join(nested, ranked.withColumn("_n", F.col("evidence_count")), lead + ["cluster"], values).select(
        *lead, *INSIGHT_COLUMNS, "chunk_no", "supporting_feedback_ids", "supporting_feedback", "rank")
    return insights.orderBy(*lead, "rank", "chunk_no"), enriched
