"""Evaluation plan: model output -> tags -> exact metrics per record, per file
and overall (SURVEY 3.1), over records derived from ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.functions.extract import tag_names
from tagweave.functions.rows import posexplode_rows
from tagweave.functions.text import truncate_head_tail
from tagweave.operators import score
from tagweave.sources import derived


def scored_records(spark: SparkSession, sf_dir: str, with_text: bool = False) -> DataFrame:
    """doc_id, file_name, generated_tags, parse_stage, pred_names, gold_names,
    exact_match_precision/recall/f1 (+ text when asked). Projection only."""
    r = derived.tag_records(spark, sf_dir, with_text=with_text)
    r = score.parse_generated(r, "response")
    r = r.withColumn("pred_names", tag_names(F.col("generated_tags"))) \
         .withColumn("gold_names", tag_names(F.col("gold")))
    return score.with_exact(r, "pred_names", "gold_names", normalise=True)


def r6(c):
    return F.round(F.col(c), 6).alias(c)


def parse_stage_counts(spark, sf_dir):
    r = score.parse_generated(derived.tag_records(spark, sf_dir), "response")
    return r.groupBy("file_name", "parse_stage").agg(F.count(F.lit(1)).alias("n"))


def parsed_tag_rows(spark, sf_dir):
    r = score.parse_generated(derived.tag_records(spark, sf_dir), "response")
    return posexplode_rows(r, ["doc_id"], "generated_tags", "pos", "t").select(
        "doc_id", "pos", F.col("t.tag").alias("tag"), F.col("t.explanation").alias("explanation"))


def exact_prf_by_doc(spark, sf_dir):
    r = scored_records(spark, sf_dir)
    return r.select("doc_id", "file_name", r6("exact_match_precision"), r6("exact_match_recall"),
                    r6("exact_match_f1"))


def file_metrics_exact(spark, sf_dir):
    m = score.file_metrics(scored_records(spark, sf_dir), semantic=False)
    return m.select("file_name", "total_samples", "valid_samples", *[r6(c) for c in score.EXACT],
                    "failed_cases_count")


def overall_macro(spark, sf_dir):
    m = score.file_metrics(scored_records(spark, sf_dir), semantic=False)
    o = score.overall(m, semantic=False)
    return o.select("n_files", "total_samples", "valid_samples", *[r6(c) for c in score.EXACT],
                    "failed_cases_count")


def failed_cases(spark, sf_dir):
    r = scored_records(spark, sf_dir, with_text=True)
    f = score.failed_cases(r, order_key="doc_id", semantic=False, k=5,
                           text=truncate_head_tail(F.col("text"), 600))
    return f.select("file_name", "case_rank", "doc_id", r6("exact_match_f1"),
                    F.array_join("pred_names", "|").alias("predicted"),
                    F.array_join("gold_names", "|").alias("ground_truth"), "input_preview")
