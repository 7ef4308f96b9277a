"""SFT-data and evaluation-input plans: prompt building,
truncation, sequence budgets, splits, samples, score cuts, resume and
before/after comparisons, over records derived from ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave.functions.extract import tag_names
from tagweave.functions import text as T
from tagweave.operators import prompts, score, split, tokens
from tagweave.plans.evaluation import scored_records
from tagweave.sources import derived


def r6(c):
    return F.round(F.col(c), 6).alias(c)


def source_rows(spark, sf_dir):
    """Evaluation source rows: input (English documents only), prompt (every
    document, prefixed with its language), context (source name on even ids)."""
    d = derived.table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", F.col("source").alias("file_name"),
        F.when(F.col("lang") == "en", F.col("text")).alias("input"),
        F.concat(F.lit("["), F.col("lang"), F.lit("] "), F.col("text")).alias("prompt"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("source "), F.col("source"))).otherwise(F.lit(""))
        .alias("context"))


def prompt_build(spark, sf_dir):
    p = prompts.build_prompts(prompts.inference_text(source_rows(spark, sf_dir)), max_tokens=300)
    return p.select("doc_id", "n_tokens", "truncated", "prompt_text")


def truncate_head_tail(spark, sf_dir):
    d = derived.table(spark, sf_dir, "documents").select("doc_id", "text")
    d = d.withColumn("_tw_tokens", T.token_pieces(F.col("text")))
    n = F.size("_tw_tokens")
    return d.select("doc_id", n.alias("n_tokens"), (n > 600).alias("truncated"),
                    T.truncate_head_tail(F.col("text"), 600, "_tw_tokens").alias("truncated_text"))


def token_budget(spark, sf_dir):
    r = derived.tag_records(spark, sf_dir, with_text=True)
    b = prompts.token_budget(r.withColumn("target", F.to_json("gold")), "text", "target")
    rep = prompts.budget_report(b)
    return rep.select("file_name", "rows", r6("p50_len"), r6("p90_len"), "max_total", "truncated", "no_loss")


def subword_truncation(spark, sf_dir):
    """Head and tail truncation on the ids of a subword tokenizer (O-P3)."""
    d = derived.table(spark, sf_dir, "documents").select("doc_id", "text")
    t = tokens.truncate_ids(d, "text", tokens.PieceTokenizer, 600)
    return t.select("doc_id", "n_tokens", F.md5("truncated_text").alias("truncated_md5"))


def subword_budget(spark, sf_dir):
    """Sequence budgets in the tokens of a subword tokenizer (O-P4, O-P16)."""
    d = derived.table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws(" ", "lang", "source").alias("target"))
    b = tokens.token_budget(d, "text", "target", tokens.PieceTokenizer, max_len=2048, prompt_cap=1800)
    return b.select("doc_id", "n_prompt", "n_total", "n_kept", "n_loss", "truncated", "no_loss")


def template_prompts(spark, sf_dir):
    """The generation, preference and judge prompts (O-P2) of every document."""
    d = derived.table(spark, sf_dir, "documents")
    fields = {"query": F.col("text"), "tags": F.col("lang"), "first": F.col("lang"), "second": F.col("source")}
    return d.select("doc_id", *[F.md5(T.fill_template(prompts.TEMPLATES[n], **fields)).alias(f"{n}_md5") for n in ("generation", "preference", "judge")])


def per_file_limit(spark, sf_dir):
    d = derived.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("file_name"))
    return split.per_group_limit(d, "file_name", [F.col("doc_id")], 10)


def hash_split(spark, sf_dir):
    d = derived.table(spark, sf_dir, "documents").select("doc_id")
    return split.hash_split(d, "doc_id", 0.2)


def prefix_split(spark, sf_dir):
    d = derived.table(spark, sf_dir, "documents").select("doc_id")
    return split.prefix_split(d, "doc_id", 0.2).select("doc_id", "split")


def eval_sample(spark, sf_dir):
    d = derived.table(spark, sf_dir, "documents").select("doc_id")
    return split.seeded_sample(d, "doc_id", 50)


def score_table(spark, sf_dir):
    """Per-document log-probabilities of a large and a small reference model
    (stand-in values derived from the document length)."""
    d = derived.table(spark, sf_dir, "documents")
    return d.select("doc_id", (-(F.col("n_chars") % 97) / 10.0).alias("logp_large"),
                    (-(F.col("n_chars") % 89) / 10.0).alias("logp_small"))


def difference_score_top(spark, sf_dir):
    s = score_table(spark, sf_dir).withColumn("score_diff", F.col("logp_large") - F.col("logp_small"))
    return split.top_fraction(s, "score_diff", "doc_id", 0.5).select("doc_id", r6("score_diff"))


def resume_remaining(spark, sf_dir):
    """O-J1: records not in the earlier output (labelled documents count as done)."""
    d = derived.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("file_name"))
    done = derived.table(spark, sf_dir, "labels").select("doc_id")
    return d.join(done, "doc_id", "left_anti")


def run_delta(spark, sf_dir):
    """O-J5: per model (file), mean exact F1 before (the tags the model meant)
    and after (the tags recovered from its output), and the change."""
    r = scored_records(spark, sf_dir).withColumnRenamed("exact_match_f1", "after")
    b = score.with_exact(r.drop("exact_match_precision", "exact_match_recall")
                         .withColumn("gen_names", tag_names(F.col("gen_raw"))), "gen_names", "gold_names")
    # Both models' scores are columns of the same records: one aggregation,
    # no join between two per-file tables.
    valid = F.size("gold_names") > 0
    per = b.groupBy("file_name").agg(F.avg(F.when(valid, F.col("exact_match_f1"))).alias("before_f1"),
                                     F.avg(F.when(valid, F.col("after"))).alias("after_f1"),
                                     F.count_if(valid).alias("_v")).where(F.col("_v") > 0)
    return per.select("file_name", r6("before_f1"), r6("after_f1"),
                      F.round(F.col("after_f1") - F.col("before_f1"), 6).alias("delta"))


def sft_extract_f1(spark, sf_dir):
    """O-P10 + O-A6 + O-A18: SFT-style extraction of the model output, raw
    set F1 against gold names, mean per file (0 when a file has no rows)."""
    from tagweave.functions.extract import extract_tags_sft

    r = derived.tag_records(spark, sf_dir)
    r = r.withColumn("sft_tags", extract_tags_sft(F.col("response")))
    r = r.withColumn("pred_names", tag_names(F.col("sft_tags"))).withColumn("gold_names", tag_names(F.col("gold")))
    r = score.with_exact(r, "pred_names", "gold_names", normalise=False)
    return r.groupBy("file_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.coalesce(F.avg("exact_match_f1"), F.lit(0.0)), 6).alias("mean_f1"),
        F.sum(F.size("pred_names")).alias("n_pred_tags"))


def sft_targets(spark, sf_dir):
    """O-P15: training targets from stored tag lists. Even documents store
    the gold list in Python-literal style (single quotes), odd ones as JSON;
    both are read leniently and written back as canonical JSON plus EOS."""
    r = derived.tag_records(spark, sf_dir)
    js = F.to_json("gold")
    stored = F.when(F.col("doc_id") % 2 == 0, F.translate(js, '"', "'")).otherwise(js)
    return r.select("doc_id", prompts.sft_target(stored).alias("target"))


def prompt_truncation_counts(spark, sf_dir):
    """Per-file prompt summary of the evaluation inputs (build_prompts job)."""
    p = prompts.build_prompts(prompts.inference_text(source_rows(spark, sf_dir)), max_tokens=300)
    r = prompts.truncation_report(p)
    return r.select("file_name", "rows", "truncated", r6("mean_tokens"), "max_tokens")

