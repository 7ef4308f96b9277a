"""Preference-data plan, second half: judge pairs, gap filters, exports
(SURVEY 3.2 steps 4-6), over pairs derived from ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave.operators import export, judge, modelcall
from tagweave.sources import derived

SCORE_COLS = ["quality_chosen", "quality_rejected", "diversity_chosen", "diversity_rejected",
              "diversity_gap", "privacy_chosen", "privacy_rejected"]


def r6(c):
    return F.round(F.col(c), 6).alias(c)


def judged(spark, sf_dir, min_gap=2.0, min_privacy=7.0, texts=True):
    """Judged pairs; without ``texts`` lengths stand in for them (scores only)."""
    return judge.judge(derived.judge_pairs(spark, sf_dir, texts), min_gap, min_privacy)


def preference(spark, sf_dir, texts=True):
    return judge.preference_rows(judged(spark, sf_dir, texts=texts))


def judge_outcomes(spark, sf_dir):
    return judge.outcome_counts(judged(spark, sf_dir, texts=False))


def judge_kept_scores(spark, sf_dir):
    return preference(spark, sf_dir, texts=False).select("index", *SCORE_COLS)


def judge_averages(spark, sf_dir):
    a = judge.kept_averages(preference(spark, sf_dir, texts=False))
    return a.select("kept", r6("avg_diversity_gap"), r6("avg_privacy_chosen"), r6("avg_privacy_rejected"))


def export_dpo(spark, sf_dir):
    return export.export(preference(spark, sf_dir), "dpo")


def export_weighted(spark, sf_dir):
    e = export.export(preference(spark, sf_dir), "dpo_weighted")
    return e.select("prompt", "chosen", "rejected", r6("weight"), r6("diversity_weight"), r6("privacy_weight"))


def export_ppo(spark, sf_dir):
    e = export.export(preference(spark, sf_dir), "ppo")
    return e.select("query", "response", r6("reward"))


def loss_table(pref):
    """A per-example loss for the weighting report: logistic loss of the
    quality margin, next to the dpo_weighted weight of the same row."""
    margin = (F.col("quality_chosen") - F.col("quality_rejected")) / 10.0
    return pref.select(F.log1p(F.exp(-margin)).alias("loss"), export.weight_expr().alias("weight"))


def weighted_loss(spark, sf_dir):
    r = export.weighted_loss(loss_table(preference(spark, sf_dir, texts=False)))
    return r.select("n", r6("mean_weighted_loss"), r6("loss_times_mean_weight"))


def rule_judge_outcomes(spark, sf_dir):
    pairs = judge.rule_judge(derived.judge_pairs(spark, sf_dir))
    j = judge.judge(pairs, 2.0, 7.0)
    return j.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"),
                                    F.round(F.avg("diversity_gap"), 6).alias("avg_gap"))


def labelled_judgements(spark, sf_dir):
    """O-J6: pairs (model output vs gold JSON of each document) judged by a
    precomputed reply table joined by key; documents without a reply count
    as failed calls. Replies come from ``labels``: quality 1 prefers the
    model output, quality 0 the gold list; toxic lowers the privacy score of
    the model output."""
    r = derived.tag_records(spark, sf_dir)
    pairs = r.select(F.col("doc_id").alias("id"), F.concat(F.lit("Tag document "), F.col("doc_id").cast("string"))
                     .alias("prompt"), F.col("response").alias("response1"),
                     F.to_json("gold").alias("response2"))
    lab = derived.table(spark, sf_dir, "labels")
    q, t, k = F.col("quality"), F.col("toxic"), F.col("doc_id")
    replies = lab.select(
        k.alias("id"), F.when(q == 1, 1).otherwise(2).alias("chosen"),
        (4 + 4 * q).cast("double").alias("q1"), (8 - 4 * q).cast("double").alias("q2"),
        (k % 7 + 2).cast("double").alias("d1"), (k % 3 + 4).cast("double").alias("d2"),
        (10 - 6 * t).cast("double").alias("p1"), F.lit(9.0).alias("p2"))
    j = judge.judge(judge.attach_judgements(pairs, replies, "id"), 2.0, 7.0)
    return judge.outcome_counts(j)


def length_judge():
    """Stand-in judge model: prefers the longer response; some calls fail, some
    replies name no response or leave a score out."""
    def call(prompt, first, second):
        a, b = len(first), len(second)
        if (a + b) % 19 == 0:
            raise TimeoutError("no reply")
        scores = {f"response{i}": {"quality": n % 11, "diversity": str(n % 8), "privacy": 10 - n % 5} for i, n in ((1, a), (2, b))}
        return {"chosen": "neither" if (a + b) % 17 == 0 else 1 if a >= b else 2, "reasoning": "the longer one", "scores": scores}

    return call


def judge_model_outcomes(spark, sf_dir):
    """O-M4: response pairs judged by a model call, with retries and odd replies."""
    pairs = judge.eligible(derived.judge_pairs(spark, sf_dir).select("id", "prompt", "response1", "response2"))
    j = judge.judge(modelcall.judge_pairs(pairs, lambda: length_judge(), max_retries=2, backoff_s=0.0), 2.0, 7.0)
    return j.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.count("reasoning").alias("with_reasoning"),
                                    F.round(F.avg("diversity_gap"), 6).alias("avg_gap"))
