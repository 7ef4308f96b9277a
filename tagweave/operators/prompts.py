"""Prompt and sequence-budget jobs (O-P1 .. O-P4, O-P15 .. O-P17)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.functions.text import cap_tokens, chat_wrap, fill_template, token_pieces, truncate_head_tail, word_tokens

# Our own template texts (fixed values).
EVAL_TEMPLATE = (
    "Assign tags to the text below. Answer with a JSON list of objects with the keys "
    "\"tag\" and \"explanation\", in this order: domain, task type, difficulty, language, "
    "then topics.\n\nText:\n{text}\n\nTags:"
)
SFT_TEMPLATE = "Tag this query.\nQuery: {query}\nTags:"
GENERATION_TEMPLATE = (
    "Read the query and tag it. Give a JSON list of objects with \"tag\" and \"explanation\": first the domain, then "
    "the task type, the difficulty and the language, then one tag for each topic.\nQuery:\n{query}\nTags:"
)
PREFERENCE_TEMPLATE = "Query to tag:\n{query}\nTag list:\n{tags}"
JUDGE_TEMPLATE = (
    "Two tag lists were written for one query. Score each from 0 to 10 for quality, diversity and privacy and say "
    "which is better. Answer with a JSON object holding chosen (1 or 2), reasoning, and scores for response1 and response2.\n"
    "Query:\n{query}\nFirst list:\n{first}\nSecond list:\n{second}"
)
TEMPLATES = {"evaluation": EVAL_TEMPLATE, "sft": SFT_TEMPLATE, "generation": GENERATION_TEMPLATE,
             "preference": PREFERENCE_TEMPLATE, "judge": JUDGE_TEMPLATE}
EOS = "<eos>"


def inference_text(df: DataFrame, input_col: str = "input", prompt_col: str = "prompt",
                   context_col: str = "context") -> DataFrame:
    """O-P1: the evaluation text is ``input`` when present, else ``prompt``
    (rows with neither are dropped); a non-empty context is appended after a
    blank line."""
    base = F.coalesce(F.col(input_col), F.col(prompt_col))
    ctx = F.col(context_col)
    text = F.when(F.coalesce(ctx, F.lit("")) != "", F.concat(base, F.lit("\n\n"), ctx)).otherwise(base)
    return df.where(base.isNotNull()).withColumn("inference_context", text)


def build_prompts(df: DataFrame, max_tokens: int = 300, template: str = EVAL_TEMPLATE,
                  wrap: bool = True, stored_tokens: int = 600) -> DataFrame:
    """O-P3 + O-P2 + O-P17 on ``inference_context``: head/tail truncation to
    ``max_tokens`` for the prompt, template, chat markers. Adds n_tokens,
    truncated, prompt_text, and ``truncated_input`` (the context truncated to
    ``stored_tokens``, kept with the results for failure previews)."""
    ic = F.col("inference_context")
    # The token array is staged once and shared by the count and both truncations.
    out = (df.withColumn("_tw_tokens", token_pieces(ic))
           .withColumn("n_tokens", F.size("_tw_tokens"))
           .withColumn("truncated", F.col("n_tokens") > max_tokens)
           .withColumn("truncated_input", truncate_head_tail(ic, stored_tokens, "_tw_tokens")))
    p = fill_template(template, text=truncate_head_tail(ic, max_tokens, "_tw_tokens"))
    return out.withColumn("prompt_text", chat_wrap(p) if wrap else p).drop("_tw_tokens")


def token_budget(df: DataFrame, query_col: str, target_col: str, max_len: int = 2048,
                 prompt_cap: int = 1800, eos: str = EOS) -> DataFrame:
    """O-P4 + O-P15 + O-P16: token counts of an SFT example.

    prompt = template over the query capped at ``prompt_cap`` tokens; target =
    the target text followed by EOS. n_loss counts target tokens that fit in
    ``max_len``; truncated when the full text is longer; no_loss when nothing
    of the target fits.
    """
    prompt = fill_template(SFT_TEMPLATE, query=cap_tokens(F.col(query_col), prompt_cap))
    target = F.concat(F.col(target_col), F.lit(" " + eos))
    # n_total refers to the column n_prompt, so that the prompt's tokens are counted once.
    counted = df.withColumn("_tw_target", F.size(word_tokens(target))).withColumn("n_prompt", F.size(word_tokens(prompt)))
    return budget_columns(counted.withColumn("n_total", F.col("n_prompt") + F.col("_tw_target")).drop("_tw_target"), max_len)


def budget_columns(counted: DataFrame, max_len: int) -> DataFrame:
    """The columns of a sequence budget that follow from n_prompt and n_total."""
    return (counted.withColumn("n_kept", F.least(F.col("n_total"), F.lit(max_len)))
            .withColumn("n_loss", F.greatest(F.col("n_kept") - F.col("n_prompt"), F.lit(0)))
            .withColumn("truncated", F.col("n_total") > max_len)
            .withColumn("no_loss", F.col("n_loss") == 0))


def budget_report(budget: DataFrame, key: str = "file_name") -> DataFrame:
    """Per-key length quantiles (exact; the kept length is bounded by
    max_len, so the exact percentile state per group stays small), and
    truncated / zero-loss counts."""
    return budget.groupBy(key).agg(
        F.count(F.lit(1)).alias("rows"),
        F.percentile(F.col("n_kept"), 0.5).alias("p50_len"),
        F.percentile(F.col("n_kept"), 0.9).alias("p90_len"),
        F.max("n_total").alias("max_total"),
        F.count_if(F.col("truncated")).alias("truncated"),
        F.count_if(F.col("no_loss")).alias("no_loss"))


def sft_target(stored, eos: str = EOS) -> F.Column:
    """O-P15: the training target of a stored tag list. The text is read
    leniently (single quotes allowed, so Python-literal lists parse; never
    evaluated as code); objects keep all their keys, in their order, and lists
    of other values stay as they are; a single object is wrapped in a list;
    text that is no JSON becomes a one-element list of that text. Compact
    JSON + EOS."""
    opts = {"allowSingleQuotes": "true", "mode": "FAILFAST"}
    first = F.substring(F.ltrim(stored), 1, 1)
    value = F.from_json(stored, "variant", {"allowSingleQuotes": "true"})
    kinds = F.schema_of_variant(value)
    objects = F.when((first == "[") & kinds.startswith("ARRAY<OBJECT"), F.from_json(stored, "array<map<string,variant>>", opts))
    single = F.when((first == "{") & kinds.startswith("OBJECT"), F.from_json(stored, "map<string,variant>", opts))
    other = F.when((first == "[") & kinds.startswith("ARRAY"), F.to_json(value))
    body = F.coalesce(F.to_json(objects), F.concat(F.lit("["), F.to_json(single), F.lit("]")), other, F.to_json(F.array(stored)))
    return F.concat(body, F.lit(eos if not eos else " " + eos))


def truncation_report(prompted: DataFrame, key: str = "file_name") -> DataFrame:
    """The build_prompts job's per-file summary: rows, truncated prompts and
    token counts of the evaluation text."""
    return prompted.groupBy(key).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("truncated")).alias("truncated"),
        F.avg("n_tokens").alias("mean_tokens"),
        F.max("n_tokens").alias("max_tokens"))

