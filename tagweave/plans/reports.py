"""Report plan over the evaluation records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave.operators import report, score
from tagweave.plans.evaluation import scored_records
from tagweave.sources import derived


def r6(c):
    return F.round(F.col(c), 6).alias(c)


def _parsed(spark, sf_dir):
    return score.parse_generated(derived.tag_records(spark, sf_dir), "response")


def tag_distribution(spark, sf_dir):
    parsed = _parsed(spark, sf_dir)
    p = report.positional_tags(parsed, {"gen": "generated_tags", "gold": "gold"})
    d = report.tag_distribution(p, require_side="gen")
    return d.select("file_name", "side", "pos", "tag", "n", "total", "n_distinct", r6("pct"))


def topic_top30(spark, sf_dir):
    p = report.positional_tags(_parsed(spark, sf_dir), {"gen": "generated_tags"})
    return report.topic_top(p, k=30).select("file_name", "rank", "tag", "n", "total", "n_distinct")


def generation_quality(spark, sf_dir):
    g = report.generation_quality(_parsed(spark, sf_dir), "generated_tags")
    return g.select("file_name", "records", "empty", "incomplete", "complete", r6("success_pct"))


def position_compare(spark, sf_dir):
    c = report.position_compare(scored_records(spark, sf_dir), "pred_names", "gold_names")
    return c.select(*[r6(n) if n.startswith("rate_") else n for n in c.columns])


def report_long_form(spark, sf_dir):
    """O-K5: the whole distribution report as one long table
    (file_name, section, pos, tag, n, pct): generated and gold positions
    0-3, and the pooled top-30 topics (pos 4)."""
    parsed = _parsed(spark, sf_dir)
    p = report.positional_tags(parsed, {"generated": "generated_tags", "ground_truth": "gold"})
    d = report.tag_distribution(p, require_side="generated").select(
        "file_name", F.col("side").alias("section"), "pos", "tag", "n", "pct")
    t = report.topic_top(p.where(F.col("side") == "generated"), k=30, side="generated").select(
        "file_name", F.lit("topics").alias("section"), F.lit(4).alias("pos"), "tag", "n",
        (F.col("n") * 100.0 / F.col("total")).alias("pct"))
    return d.unionByName(t).select("file_name", "section", "pos", "tag", "n", r6("pct"))


def rows_per_file(spark, sf_dir):
    """O-A19: records loaded per file."""
    return report.rows_per_file(derived.tag_records(spark, sf_dir).select("doc_id", "file_name"))
