"""Batch job: ``python -m murmur analyze <input> --out <dir>`` (also under
spark-submit). Reads a feedback file set, standardises it, embeds the texts
with the Spark ML embedder (or uses a vector column), runs the analysis and
writes the standardised feedback, ranked insights (Parquet and JSON lines),
evidence, dataset stats and the daily timeline under ``--out``."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession


def analyze(spark: SparkSession, path: str, out: str, fmt: str | None = None, eps: float = 0.35,
            min_samples: int = 2, embed_dim: int = 384, vec_col: str | None = None, per_file: bool = False):
    from murmur.operators.enrich import embed_text, fit_text_embedder
    from murmur.operators.insights import analyze_feedback, evidence_table
    from murmur.operators.report import dataset_stats, feedback_timeline, write_feedback, write_insights_json
    from murmur.session import cut_lineage, ensure_checkpoint_dir
    from murmur.sources.files import read_feedback

    ensure_checkpoint_dir(spark)
    group = "dataset" if per_file else None
    options = {"dataset_col": group} if per_file else {}
    feedback = cut_lineage(read_feedback(spark, path, format=fmt, **options))
    write_feedback(feedback, os.path.join(out, "feedback"))
    if vec_col:
        embedder, column = None, vec_col
    else:
        model = fit_text_embedder(feedback, dim=embed_dim)
        embedder, column = (lambda df: embed_text(df, model)), "embedding"
    insights, enriched = analyze_feedback(feedback, embedder=embedder, eps=eps, min_samples=min_samples,
                                          vec_col=column, group_col=group)
    insights.write.mode("overwrite").parquet(os.path.join(out, "insights"))
    write_insights_json(spark.read.parquet(os.path.join(out, "insights")), os.path.join(out, "insights_json"))
    evidence_table(enriched, group_col=group).write.mode("overwrite").parquet(os.path.join(out, "evidence"))
    stats = dataset_stats(feedback, spark.read.parquet(os.path.join(out, "insights")), group_col=group)
    stats.write.mode("overwrite").json(os.path.join(out, "stats"))
    feedback_timeline(feedback, group_col=group).write.mode("overwrite").json(os.path.join(out, "timeline"))
    rows = [r.asDict() for r in spark.read.json(os.path.join(out, "stats")).collect()]
    return rows if per_file else rows[0]


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="murmur")
    sub = ap.add_subparsers(dest="cmd", required=True)
    a = sub.add_parser("analyze", help="analyse a feedback file set")
    a.add_argument("path")
    a.add_argument("--out", required=True)
    a.add_argument("--format", default=None, help="csv, json, jsonl or txt (default: from the extension)")
    a.add_argument("--eps", type=float, default=0.35)
    a.add_argument("--min-samples", type=int, default=2)
    a.add_argument("--embed-dim", type=int, default=384)
    a.add_argument("--vector-column", default=None, help="use this array column instead of embedding texts")
    a.add_argument("--per-file", action="store_true", help="analyse every input file as its own dataset")
    args = ap.parse_args(argv)
    spark = SparkSession.builder.appName("murmur-analyze").getOrCreate()
    stats = analyze(spark, args.path, args.out, args.format, args.eps, args.min_samples, args.embed_dim,
                    args.vector_column, args.per_file)
    print(stats)


if __name__ == "__main__":
    main()
