"""Plans that go through Python model calls or through files: sampled
responses (O-M2/M3), a JSON Lines write + tolerant read round trip (O-K1,
O-S1, O-P7), and the preference-file loader (O-S5, O-P14, O-P19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave.operators import export, judge, modelcall, parse
from tagweave.session import scratch_folder
from tagweave.sources import derived, readers, sinks


def two_temperature_responses(spark, sf_dir):
    d = derived.table(spark, sf_dir, "documents").select("doc_id", "text")
    s = modelcall.sample_responses(d, "text")
    return s.select("doc_id", F.inline("responses")).select("doc_id", "response_id", "temperature", "text")


def concurrent_responses(spark, sf_dir):
    """``two_temperature_responses`` with several calls in flight in every task."""
    d = derived.table(spark, sf_dir, "documents").select("doc_id", "text")
    s = modelcall.sample_responses(d, "text", max_in_flight=4, deadline_s=60.0)
    return s.select("doc_id", F.inline("responses")).select("doc_id", "response_id", "temperature", "text")


def jsonl_roundtrip(spark, sf_dir):
    """Write generation records as JSON Lines, read them back with the
    tolerant reader, clean the responses and count per source file."""
    path = scratch_folder(spark, "generation-jsonl")
    sinks.write_jsonl(derived.generation_records(spark, sf_dir), path, mode="overwrite")
    rows = readers.tolerant_jsonl(spark, path, glob="*.json")
    typed = rows.select(
        F.try_variant_get("v", "$.index", "bigint").alias("index"),
        F.try_variant_get("v", "$.file_name", "string").alias("file_name"),
        F.try_variant_get("v", "$.responses", "array<struct<response_id:int,temperature:double,text:string>>")
        .alias("responses"))
    c = parse.clean_responses(typed)
    per = c.select("file_name", F.size("responses").alias("nr"),
                   F.size(F.filter("responses", lambda r: r["parsed_kind"] == "list")).alias("nl"))
    return per.groupBy("file_name").agg(F.count(F.lit(1)).alias("records"), F.sum("nr").alias("responses"),
                                        F.sum("nl").alias("parsed_lists"))


def preference_file_load(spark, sf_dir):
    """Export kept judged pairs as dpo_weighted JSON Lines, load them with the
    preference-directory loader and apply the training-row checks."""
    pairs = judge.judge(derived.judge_pairs(spark, sf_dir), 2.0, 7.0)
    rows = export.dpo_weighted(judge.preference_rows(pairs))
    path = scratch_folder(spark, "pref-jsonl")
    sinks.write_jsonl(rows, path, mode="overwrite")
    t = export.training_rows(readers.preference_dir(spark, path))
    return t.select("prompt", "chosen", "rejected", F.round("weight", 6).alias("weight"))


def preference_load_reasons(spark, sf_dir):
    """All eligible judged pairs (kept or not) exported with their weight
    (NULL when the judge reply was unusable) and loaded back: loader outcome
    counts by reason (preference_rows job)."""
    j = judge.judge(derived.judge_pairs(spark, sf_dir), 2.0, 7.0)
    rows = j.select("prompt", F.col("chosen_text").alias("chosen"), F.col("rejected_text").alias("rejected"),
                    export.weight_expr().alias("weight"))
    path = scratch_folder(spark, "pref-all-jsonl")
    sinks.write_jsonl(rows, path, mode="overwrite")
    loaded = readers.tolerant_jsonl(spark, path, glob="*.json").select(
        F.variant_get(F.col("v"), "$.prompt", "variant").alias("prompt"),
        F.variant_get(F.col("v"), "$.chosen", "variant").alias("chosen"),
        F.variant_get(F.col("v"), "$.rejected", "variant").alias("rejected"),
        F.variant_get(F.col("v"), "$.weight", "variant").alias("weight"),
        F.variant_get(F.col("v"), "$.weight", "variant").isNotNull().alias("has_weight"))
    return export.rejection_counts(loaded)

