"""Pairwise judging of response pairs (O-F3, O-F4, O-J6, O-P18, O-M5,
O-A15, O-A16).

Input rows carry a prompt, two responses and a judge reply (chosen and six
scores), either precomputed (joined by key, O-J6), produced by a model call
(O-M4, see modelcall.py) or by the rule judge below (O-M5). Every step here is
a projection or a single-pass aggregate: the outcome column replaces the
reference's loop with counters, so kept and rejected rows come out of the
same scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.functions.jsonparse import let

OUTCOMES = ("kept", "low_diversity", "low_privacy", "failed")

# Fixed patterns for the rule judge's privacy penalty.
EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE_PATTERN = r"\d{3}[-. ]\d{3}[-. ]\d{4}"


def eligible(pairs: DataFrame, r2: str = "response2") -> DataFrame:
    """O-F4: at least two responses; only the first two are used."""
    return pairs.where(F.col(r2).isNotNull())


def attach_judgements(pairs: DataFrame, judgements: DataFrame, key: str) -> DataFrame:
    """O-J6: left join precomputed replies by key; a missing reply is a failed call."""
    return pairs.join(judgements, key, "left")


def orient(df: DataFrame, chosen: str = "chosen", r1: str = "response1", r2: str = "response2",
           q=("q1", "q2"), d=("d1", "d2"), p=("p1", "p2")) -> DataFrame:
    """O-P18: turn (response1/2, scores1/2, chosen in {1,2}) into
    chosen/rejected texts and scores. Other chosen values leave them NULL."""
    c = F.col(chosen)

    def by(one: str, two: str, pick_chosen: bool) -> Column:
        a, b = (one, two) if pick_chosen else (two, one)
        return F.when(c == 1, F.col(a)).when(c == 2, F.col(b))

    return df.select(
        "*",
        by(r1, r2, True).alias("chosen_text"), by(r1, r2, False).alias("rejected_text"),
        by(q[0], q[1], True).alias("quality_chosen"), by(q[0], q[1], False).alias("quality_rejected"),
        by(d[0], d[1], True).alias("diversity_chosen"), by(d[0], d[1], False).alias("diversity_rejected"),
        by(p[0], p[1], True).alias("privacy_chosen"), by(p[0], p[1], False).alias("privacy_rejected"),
    ).withColumn("diversity_gap", F.abs(F.col("diversity_chosen") - F.col("diversity_rejected")))


def outcome(df: DataFrame, min_gap: float = 2.0, min_privacy: float = 7.0, chosen: str = "chosen") -> DataFrame:
    """O-F3: first failing reason only: failed (no usable reply), then
    low_diversity (gap < min_gap), then low_privacy (either side < floor)."""
    o = (F.when(~F.coalesce(F.col(chosen).isin(1, 2), F.lit(False)), "failed")
         .when(F.col("diversity_gap") < min_gap, "low_diversity")
         .when((F.col("privacy_chosen") < min_privacy) | (F.col("privacy_rejected") < min_privacy),
               "low_privacy")
         .otherwise("kept"))
    return df.withColumn("outcome", o)


def judge(pairs: DataFrame, min_gap: float = 2.0, min_privacy: float = 7.0) -> DataFrame:
    """Eligibility + orientation + outcome over judged pairs."""
    return outcome(orient(eligible(pairs)), min_gap, min_privacy)


def preference_rows(judged: DataFrame, key: str = "id") -> DataFrame:
    """Kept rows in the annotated preference shape (FIXTURES A5)."""
    return judged.where(F.col("outcome") == "kept").select(
        F.col(key).alias("index"), "prompt",
        F.col("chosen_text").alias("chosen"), F.col("rejected_text").alias("rejected"),
        *[c for c in ("reasoning", "annotation") if c in judged.columns], "quality_chosen", "quality_rejected", "diversity_chosen", "diversity_rejected",
        "diversity_gap", "privacy_chosen", "privacy_rejected")


# Fixed outcome names, in the order in which they are decided.
OUTCOMES = ["failed", "low_diversity", "low_privacy", "kept"]


def outcome_counts(judged: DataFrame) -> DataFrame:
    """O-A15: processed rows by outcome."""
    return judged.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def kept_averages(pref: DataFrame) -> DataFrame:
    """O-A16: averages over kept rows."""
    return pref.agg(F.count(F.lit(1)).alias("kept"),
                    F.avg("diversity_gap").alias("avg_diversity_gap"),
                    F.avg("privacy_chosen").alias("avg_privacy_chosen"),
                    F.avg("privacy_rejected").alias("avg_privacy_rejected"))


def _words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"\S+"), F.lit(0))


def rule_scores(text: Column) -> Column:
    """O-M5: quality / diversity / privacy of one response on 0-10 scales.

    quality   = min(10, floor(characters / 50))         (completeness)
    diversity = 10 * distinct words / words              (0 for no words)
    privacy   = max(0, 10 - 3 * e-mail and phone matches)
    """
    quality = F.least(F.lit(10.0), F.floor(F.length(text) / 50).cast("double"))
    diversity = let(_words(text), lambda w: F.when(
        F.size(w) > 0, 10.0 * F.size(F.array_distinct(w)) / F.size(w)).otherwise(F.lit(0.0)))
    hits = (F.size(F.regexp_extract_all(text, F.lit(EMAIL_PATTERN), F.lit(0)))
            + F.size(F.regexp_extract_all(text, F.lit(PHONE_PATTERN), F.lit(0))))
    privacy = F.greatest(F.lit(0.0), (10 - 3 * hits).cast("double"))
    return F.struct(quality.alias("quality"), diversity.alias("diversity"), privacy.alias("privacy"))


def rule_judge(pairs: DataFrame, r1: str = "response1", r2: str = "response2") -> DataFrame:
    """Replace the judge columns with rule scores; chosen = higher total (1 on ties)."""
    s1, s2 = rule_scores(F.col(r1)), rule_scores(F.col(r2))
    out = pairs.drop("chosen", "q1", "q2", "d1", "d2", "p1", "p2").select(
        "*", s1.alias("_s1"), s2.alias("_s2"))
    tot1 = out["_s1.quality"] + out["_s1.diversity"] + out["_s1.privacy"]
    tot2 = out["_s2.quality"] + out["_s2.diversity"] + out["_s2.privacy"]
    return out.select(
        *[c for c in out.columns if c not in ("_s1", "_s2")],
        F.when(F.col(r2).isNull(), F.lit(None).cast("int"))
         .when(tot1 >= tot2, 1).otherwise(2).alias("chosen"),
        F.col("_s1.quality").alias("q1"), F.col("_s2.quality").alias("q2"),
        F.col("_s1.diversity").alias("d1"), F.col("_s2.diversity").alias("d2"),
        F.col("_s1.privacy").alias("p1"), F.col("_s2.privacy").alias("p2"))
