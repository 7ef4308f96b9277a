"""Scoring jobs: per-record exact and semantic metrics, per-file metrics,
the macro overall, failed cases (O-A6 .. O-A14, O-F5, O-J3, O-J4, O-P20, O-P21).

Shape of the work: per-record metrics are projections (no shuffle); the
per-file table is one hash aggregate on file_name with partial aggregation
before the exchange, so a file holding a third of all rows costs one small
partial buffer per task, not a hot reducer. The embedding lookup joins on
the *distinct* tags only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagweave.functions import metrics as M
from tagweave.functions.extract import eval_result, eval_stages, tag_names
from tagweave.functions.rows import explode_rows, posexplode_rows
from tagweave.functions.sizing import DEFAULT_MAX_ROWS, bounded_broadcast
from tagweave.functions.text import preview

EXACT = ["exact_match_precision", "exact_match_recall", "exact_match_f1"]
SEMANTIC = ["semantic_accuracy", "semantic_f1", "semantic_precision", "semantic_recall"]


def parse_generated(df: DataFrame, text_col: str = "response", out: str = "generated_tags") -> DataFrame:
    """Extract tags from model output text (O-P8/P9); adds ``out`` and ``parse_stage``.

    The intermediates (last bracket list, object matches, line scan) and the
    result struct are separate projections: each is referenced more than
    once downstream, so Catalyst keeps them as computed columns instead of
    inlining (and re-evaluating) the parse in every consumer.
    """
    st = eval_stages(F.col(text_col))
    # The object and line stages run only where the stages before found nothing.
    nothing = F.col("_tw_lst").isNull()
    staged = (df.withColumn("_tw_lst", st["last_list"])
              .withColumn("_tw_objs", F.when(nothing, st["objects"]))
              .withColumn("_tw_lines", F.when(nothing & (F.size("_tw_objs") == 0), st["lines"])))
    res = eval_result(F.col(text_col), F.col("_tw_lst"), F.col("_tw_objs"), F.col("_tw_lines"))
    return (staged.withColumn("_tw_res", res)
            .withColumn(out, F.col("_tw_res.tags"))
            .withColumn("parse_stage", F.col("_tw_res.stage"))
            .drop("_tw_lst", "_tw_objs", "_tw_lines", "_tw_res"))


def with_exact(df: DataFrame, pred: str | Column, gold: str | Column, normalise: bool = True) -> DataFrame:
    """Add exact_match_precision / recall / f1 for name arrays (O-A6 / O-A7).

    The two name sets and their intersection size are staged as columns, so
    each is computed once per record and the three metrics are arithmetic.
    """
    p = F.col(pred) if isinstance(pred, str) else pred
    g = F.col(gold) if isinstance(gold, str) else gold
    staged = (df.withColumn("_tw_np", F.size(p)).withColumn("_tw_ng", F.size(g))
              .withColumn("_tw_ps", M.name_set(p, normalise)).withColumn("_tw_gs", M.name_set(g, normalise))
              .withColumn("_tw_inter", F.size(F.array_intersect("_tw_ps", "_tw_gs"))))
    s = M.prf_from_counts(F.col("_tw_inter"), F.size("_tw_ps"), F.size("_tw_gs"),
                          F.col("_tw_np"), F.col("_tw_ng"))
    return (staged.withColumn("_em", s)
            .withColumn("exact_match_precision", F.col("_em.precision"))
            .withColumn("exact_match_recall", F.col("_em.recall"))
            .withColumn("exact_match_f1", F.col("_em.f1"))
            .drop("_em", "_tw_np", "_tw_ng", "_tw_ps", "_tw_gs", "_tw_inter"))


def names(df: DataFrame, col: str, out: str) -> DataFrame:
    """Tag names of a tag-struct list (O-P11)."""
    return df.withColumn(out, tag_names(F.col(col)))


def file_metrics(scored: DataFrame, gold_names: str = "gold_names", key: str = "file_name",
                 semantic: bool = True, fail_below: float = 0.5) -> DataFrame:
    """Per-file metrics (O-A13, O-P21).

    total_samples counts rows without an error; valid_samples those with a
    non-empty gold list; the means run over valid rows; failed_cases_count
    counts valid rows with exact F1 or semantic accuracy below ``fail_below``
    (exact F1 only when no semantic scores are present). Files without a
    valid row are left out.
    """
    ok = scored.where(F.col("error").isNull()) if "error" in scored.columns else scored
    valid = F.size(F.col(gold_names)) > 0
    metric_cols = EXACT + (SEMANTIC if semantic else [])
    failed = F.col("exact_match_f1") < fail_below
    if semantic:
        failed = failed | (F.col("semantic_accuracy") < fail_below)
    aggs = [F.count(F.lit(1)).alias("total_samples"), F.count_if(valid).alias("valid_samples")]
    aggs += [F.avg(F.when(valid, F.col(m))).alias(m) for m in metric_cols]
    aggs += [F.count_if(valid & failed).alias("failed_cases_count")]
    return ok.groupBy(key).agg(*aggs).where(F.col("valid_samples") > 0)


def overall(metrics: DataFrame, semantic: bool = True, micro: bool = False) -> DataFrame:
    """Overall summary (O-A14): unweighted (macro) mean of the per-file means
    and sums of the counts. ``micro`` weights each file's mean by its valid
    rows instead, i.e. the mean over all valid rows."""
    metric_cols = EXACT + (SEMANTIC if semantic else [])
    if micro:
        means = [(F.sum(F.col(m) * F.col("valid_samples")) / F.sum("valid_samples")).alias(m)
                 for m in metric_cols]
    else:
        means = [F.avg(m).alias(m) for m in metric_cols]
    return metrics.agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sum("total_samples").alias("total_samples"),
        F.sum("valid_samples").alias("valid_samples"),
        *means,
        F.sum("failed_cases_count").alias("failed_cases_count"))


def compare_runs(before: DataFrame, after: DataFrame, key: str = "file_name",
                 metrics: tuple[str, ...] = ("exact_match_f1",)) -> DataFrame:
    """O-J5: before/after metrics of two separately computed runs joined on
    ``key`` (model or file), with the change per metric. Both inputs are
    per-key summaries (one row per key), so the join is small."""
    b = before.select(key, *[F.col(m).alias(f"before_{m}") for m in metrics])
    a = after.select(key, *[F.col(m).alias(f"after_{m}") for m in metrics])
    out = b.join(a, key)
    for m in metrics:
        out = out.withColumn(f"delta_{m}", F.col(f"after_{m}") - F.col(f"before_{m}"))
    return out


def failed_cases(scored: DataFrame, order_key: str, gold_names: str = "gold_names",
                 text: Column | None = None, k: int = 5, key: str = "file_name",
                 semantic: bool = True, fail_below: float = 0.5) -> DataFrame:
    """First ``k`` failed cases per file by ``order_key`` (O-F5, O-T2, O-P20).

    The reference keeps the first five in file order; a DataFrame has no
    order, so ``order_key`` defines it. Failed rows are ranked first inside
    the window and the filter comes after it: a filter on the scores below
    the window would be pushed into the scan with the whole score expression
    inlined. ``row_number() <= k`` is planned as a window group limit, so each
    task forwards at most k rows per file through the exchange (a hot file
    does not funnel to one task), and ``text`` (an expression over the row,
    e.g. the truncated input) is evaluated only for the rows that survive.
    """
    valid = F.size(F.col(gold_names)) > 0
    failed = F.col("exact_match_f1") < fail_below
    if semantic:
        failed = failed | (F.col("semantic_accuracy") < fail_below)
    is_case = valid & failed
    if "error" in scored.columns:
        is_case = is_case & F.col("error").isNull()
    staged = scored.withColumn("_tw_case", is_case)
    w = W.partitionBy(key).orderBy(F.col("_tw_case").desc(), F.col(order_key))
    out = (staged.withColumn("case_rank", F.row_number().over(w))
           .where((F.col("case_rank") <= k) & F.col("_tw_case")))
    if text is not None:
        # Evaluated on the surviving rows only (at most k per file).
        out = out.withColumn("input_preview", preview(text))
    return out.drop("_tw_case")


# ---------------------------------------------------------------------------
# Semantic scoring: embeddings joined on distinct tags (O-J3, O-M6)

def attach_grid(records: DataFrame, embed, key: str, gold: str, pred: str, keep: list[str] | None = None,
                max_broadcast_rows: int = DEFAULT_MAX_ROWS) -> DataFrame:
    """Add ``grid`` (similarities of gold x predicted names) and ``encoded``
    (whether any pair of the record has one), with the columns ``keep``.

    ``key`` identifies a record. Vectors never meet the records: every distinct
    pair of names of the whole table gets its cosine once, and the scalar is
    joined back to the records' pairs, so what is shuffled does not depend on
    the vectors' size. A pair without a vector on both sides has similarity 0.
    Wide columns ride on one marker row per record, which also keeps records
    without pairs; the regroup holds the pairs of one record.
    """
    keep = [c for c in dict.fromkeys([*(keep or []), gold, pred]) if c != key]
    g, p = F.col(gold), F.col(pred)
    pairs = F.flatten(F.transform(g, lambda a, i: F.transform(p, lambda b, j: F.struct(
        i.alias("i"), j.alias("j"), a.alias("g"), b.alias("p")))))
    distinct = explode_rows(records, [], pairs, "x").select("x.g", "x.p").distinct()
    names = distinct.select(F.col("g").alias("tag")).union(distinct.select("p")).distinct()
    vectors = bounded_broadcast(embed(names).select("tag", M.unit(F.col("vec")).alias("vec")), max_broadcast_rows)
    one, two = (vectors.select(F.col("tag").alias(c), F.col("vec").alias("v" + c)) for c in ("g", "p"))
    sims = bounded_broadcast(distinct.join(one, "g").join(two, "p").select("g", "p", M.dot(F.col("vg"), F.col("vp")).alias("s")),
                             max_broadcast_rows)
    marker = F.array(F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(None).cast("string").alias("g"),
                              F.lit(None).cast("string").alias("p")))
    rows = explode_rows(records, [key, *keep], F.concat(marker, F.coalesce(pairs, F.array().cast(
        "array<struct<i:int,j:int,g:string,p:string>>"))), "x")
    rows = rows.select(key, F.col("x.i").alias("_tw_i"), F.col("x.j").alias("_tw_j"), F.col("x.g").alias("g"), F.col("x.p").alias("p"),
                       F.when(F.col("x.i") < 0, F.struct(*keep)).alias("_tw_kept"))
    found = rows.join(sims, ["g", "p"], "left").groupBy(key).agg(
        F.first("_tw_kept", ignorenulls=True).alias("_tw_kept"),
        F.map_from_entries(F.collect_list(F.when(F.col("s").isNotNull(), F.struct(
            (F.col("_tw_i") * GRID_WIDTH + F.col("_tw_j")).alias("at"), "s")))).alias("_tw_sims"))
    cells = F.transform(F.col("_tw_kept")[gold], lambda a, i: F.transform(F.col("_tw_kept")[pred], lambda b, j: F.coalesce(
        F.col("_tw_sims")[i * GRID_WIDTH + j], F.lit(0.0))))
    return found.select(key, *[F.col("_tw_kept")[c].alias(c) for c in keep], cells.alias("grid"),
                        (F.size("_tw_sims") > 0).alias("encoded"))


# More names than one record's list ever holds, so that a cell has one number.
GRID_WIDTH = 1 << 15


def with_semantic_grid(df: DataFrame, gold: str, pred: str, threshold: float = 0.8) -> DataFrame:
    """``with_semantic`` over name lists and the ``grid`` of ``attach_grid``."""
    g, p = F.col(gold), F.col(pred)
    staged = df.withColumn("_tw_hits", M.grid_hits(F.col("grid"), F.size(p), threshold))
    out = staged.withColumn("_s", M.scores_from_hits(F.col("_tw_hits"), F.size(g), F.size(p)))
    failed = ~F.col("encoded") & (F.size(g) > 0) & (F.size(p) > 0)
    return (out.withColumn("semantic_accuracy", F.col("_s.accuracy")).withColumn("semantic_f1", F.col("_s.f1"))
            .withColumn("semantic_precision", F.col("_s.precision")).withColumn("semantic_recall", F.col("_s.recall"))
            .withColumn("sft_semantic_f1", F.when(failed, M.exact_prf(p, g, normalise=False)["f1"]).otherwise(F.col("_s.sft_f1")))
            .drop("_s", "_tw_hits"))


def best_match_rows(df: DataFrame, key: str, gold: str, pred: str) -> DataFrame:
    """One row per gold tag with its best predicted tag (O-A9), from the ``grid``."""
    bm = M.best_from_grid(F.col(gold), F.col(pred), F.col("grid"))
    return (df.where(F.size(F.col(pred)) > 0)
            .transform(lambda d: posexplode_rows(d, [key], bm, "gold_pos", "m"))
            .select(key, "gold_pos", F.col("m.gold_tag").alias("gold_tag"),
                    F.col("m.pred_tag").alias("pred_tag"), F.col("m.similarity").alias("similarity")))
