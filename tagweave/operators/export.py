"""Training-format exports and the preference loader checks (O-X1 .. O-X5,
O-P14, O-P19). Exports are projections of the kept preference rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dpo(pref: DataFrame) -> DataFrame:
    """O-X1."""
    return pref.select("prompt", "chosen", "rejected")


def _weights():
    dw = F.col("diversity_gap") / 10.0
    pw = F.abs(F.col("privacy_chosen") - F.col("privacy_rejected")) / 10.0
    return dw, pw


def weight_expr() -> Column:
    """O-X2 combined weight: 0.6 * gap / 10 + 0.4 * |privacy chosen - rejected| / 10."""
    dw, pw = _weights()
    return 0.6 * dw + 0.4 * pw


def dpo_weighted(pref: DataFrame) -> DataFrame:
    """O-X2: dpo columns plus the combined weight and both parts."""
    dw, pw = _weights()
    return pref.select("prompt", "chosen", "rejected", weight_expr().alias("weight"),
                       dw.alias("diversity_weight"), pw.alias("privacy_weight"))


def ppo(pref: DataFrame) -> DataFrame:
    """O-X3: reward = quality * diversity * privacy of the chosen side / 1000."""
    reward = F.col("quality_chosen") * F.col("diversity_chosen") * F.col("privacy_chosen") / 1000.0
    return pref.select(F.col("prompt").alias("query"), F.col("chosen").alias("response"),
                       reward.alias("reward"))


FORMATS = {"dpo": dpo, "dpo_weighted": dpo_weighted, "ppo": ppo}


def export(pref: DataFrame, format_type: str = "dpo") -> DataFrame:
    """O-X4: dispatch by name; an unknown name raises (the reference wrote an empty file)."""
    try:
        return FORMATS[format_type](pref)
    except KeyError:
        raise ValueError(f"unknown export format {format_type!r}; use one of {sorted(FORMATS)}") from None


def weighted_loss(losses: DataFrame, loss: str = "loss", weight: str = "weight") -> DataFrame:
    """O-X5 as a report over a loss table: mean of loss * weight (per-example
    weighting) and mean loss * mean weight (batch weighting)."""
    return losses.agg(F.count(F.lit(1)).alias("n"),
                      F.avg(F.col(loss) * F.col(weight)).alias("mean_weighted_loss"),
                      (F.avg(loss) * F.avg(weight)).alias("loss_times_mean_weight"))


def tags_to_json(v: Column) -> Column:
    """O-P14 on a VARIANT value: a JSON string stays as is; a list becomes the
    canonical JSON of {tag, explanation} objects ('' for a missing key; a
    string element becomes a tag with an empty explanation; other elements
    are dropped); a missing value (SQL NULL) gives '[]'; a JSON null gives
    'None'; anything else its JSON text."""
    kind = F.schema_of_variant(v)
    arr = F.try_variant_get(v, "$", "array<variant>")

    def field(x, k):
        return F.coalesce(F.to_json(F.variant_get(x, f"$.{k}", "variant")), F.lit('""'))

    def one(x):
        is_str = F.schema_of_variant(x) == "STRING"
        return F.when(is_str, F.to_json(F.struct(F.try_variant_get(x, "$", "string").alias("tag"),
                                                F.lit("").alias("explanation"))))\
            .otherwise(F.concat(F.lit('{"tag":'), field(x, "tag"), F.lit(',"explanation":'),
                                field(x, "explanation"), F.lit("}")))

    keep = F.filter(arr, lambda x: F.schema_of_variant(x).startswith("OBJECT")
                    | (F.schema_of_variant(x) == "STRING"))
    listed = F.concat(F.lit("["), F.array_join(F.transform(keep, one), ","), F.lit("]"))
    return (F.when(v.isNull(), F.lit("[]"))
            .when(kind == "STRING", F.try_variant_get(v, "$", "string"))
            .when(kind == "VOID", F.lit("None"))
            .when(arr.isNotNull(), listed)
            .otherwise(F.to_json(v)))


def training_row_checks(raw: DataFrame) -> DataFrame:
    """O-P19 checks over rows of VARIANT columns (prompt, chosen, rejected,
    weight, and ``has_weight`` for key presence). Adds the converted columns
    ``_prompt``, ``_chosen``, ``_rejected``, ``_weight`` and ``reason``: the
    first failing check ('prompt', 'chosen', 'rejected', 'weight') or 'ok'.
    A missing weight key means 1.0; an explicit null or a value that does not
    cast to a number fails."""
    prompt = F.when(F.schema_of_variant(F.col("prompt")) == "STRING",
                    F.try_variant_get(F.col("prompt"), "$", "string"))
    w_kind = F.schema_of_variant(F.col("weight"))
    weight = (F.when(~F.col("has_weight"), F.lit(1.0))
              .when(w_kind == "VOID", F.lit(None).cast("double"))
              .otherwise(F.try_variant_get(F.col("weight"), "$", "double")))
    out = raw.select("*", prompt.alias("_prompt"), tags_to_json(F.col("chosen")).alias("_chosen"),
                     tags_to_json(F.col("rejected")).alias("_rejected"), weight.alias("_weight"))
    reason = (F.when(F.coalesce(F.col("_prompt"), F.lit("")) == "", "prompt")
              .when(F.col("_chosen") == "", "chosen")
              .when(F.col("_rejected") == "", "rejected")
              .when(F.col("_weight").isNull(), "weight")
              .otherwise("ok"))
    return out.withColumn("reason", reason)


def training_rows(raw: DataFrame, template=None) -> DataFrame:
    """O-P19: the rows that pass ``training_row_checks`` with their converted
    values. ``template`` optionally maps the prompt column to the final text."""
    out = training_row_checks(raw).where(F.col("reason") == "ok")
    p = template(F.col("_prompt")) if template else F.col("_prompt")
    extra = [c for c in raw.columns if c not in ("prompt", "chosen", "rejected", "weight", "has_weight")]
    return out.select(*extra, p.alias("prompt"), F.col("_chosen").alias("chosen"),
                      F.col("_rejected").alias("rejected"), F.col("_weight").alias("weight"))


def rejection_counts(raw: DataFrame) -> DataFrame:
    """Loader outcome counts by reason ('ok' for loaded rows)."""
    return training_row_checks(raw).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
