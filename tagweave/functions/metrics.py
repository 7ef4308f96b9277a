"""Per-record tag metrics as array expressions (O-A6 .. O-A12).

Exact metrics work on ARRAY<STRING> of tag names. Semantic metrics work on
ARRAY<STRUCT<tag STRING, vec ARRAY<DOUBLE>>> with unit-length vectors, so a
dot product is the cosine. Everything stays inside one record: the gold x
predicted similarity grid is a nested ``transform`` over two short arrays,
never a join.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagweave.functions.jsonparse import let
from tagweave.functions.text import _c, lower_strip


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def name_set(names, normalise: bool = True) -> Column:
    """Distinct tag names, lower-cased and stripped when ``normalise``."""
    n = _c(names)
    return F.array_distinct(F.transform(n, lower_strip) if normalise else n)


def prf_from_counts(inter, n_pset, n_gset, n_pred, n_gold) -> Column:
    """STRUCT<precision, recall, f1> from the intersection size, the set sizes
    and the raw list sizes (emptiness rules on the raw lists)."""
    prec = F.coalesce(_ratio(inter, n_pset), F.lit(0.0))
    rec = F.coalesce(_ratio(inter, n_gset), F.lit(0.0))
    both_empty = (n_pred == 0) & (n_gold == 0)
    one_empty = (n_pred == 0) | (n_gold == 0)

    def pick(v):
        return F.when(both_empty, 1.0).when(one_empty, 0.0).otherwise(v)

    return F.struct(pick(prec).alias("precision"), pick(rec).alias("recall"), pick(_f1(prec, rec)).alias("f1"))


def exact_prf(pred, gold, normalise: bool = True) -> Column:
    """STRUCT<precision, recall, f1> over tag-name sets.

    ``normalise`` lower-cases and strips names before the set comparison
    (evaluation preset, O-A7); without it names compare raw (SFT preset,
    O-A6). Emptiness is tested on the raw lists: both empty -> 1, one empty
    -> 0.
    """
    p_raw, g_raw = _c(pred), _c(gold)
    if normalise:
        p = F.array_distinct(F.transform(p_raw, lower_strip))
        g = F.array_distinct(F.transform(g_raw, lower_strip))
    else:
        p, g = F.array_distinct(p_raw), F.array_distinct(g_raw)
    inter = F.size(F.array_intersect(p, g))
    prec = F.coalesce(_ratio(inter, F.size(p)), F.lit(0.0))
    rec = F.coalesce(_ratio(inter, F.size(g)), F.lit(0.0))
    f1 = _f1(prec, rec)
    n_p, n_g = F.size(p_raw), F.size(g_raw)
    both_empty = (n_p == 0) & (n_g == 0)
    one_empty = (n_p == 0) | (n_g == 0)

    def pick(v):
        return F.when(both_empty, 1.0).when(one_empty, 0.0).otherwise(v)

    return F.struct(pick(prec).alias("precision"), pick(rec).alias("recall"), pick(f1).alias("f1"))


def dot(a, b) -> Column:
    """Dot product of two numeric arrays (no built-in cosine in Spark 4.1)."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def unit(vec) -> Column:
    """Scale a vector to unit length (zero vectors stay zero)."""
    v = F.transform(_c(vec), lambda x: x.cast("double"))
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))


def sim_grid(gold, pred) -> Column:
    """gold x pred cosine grid: ARRAY<ARRAY<DOUBLE>> (rows = gold)."""
    return F.transform(_c(gold), lambda g: F.transform(_c(pred), lambda p: similarity(g, p)))


def similarity(g, p) -> Column:
    """Cosine of two tags' unit vectors; 0 when one of them has no vector."""
    return F.coalesce(dot(g["vec"], p["vec"]), F.lit(0.0))


def grid_hits(grid, n_pred, threshold: float = 0.8) -> Column:
    """Matched counts of a similarity grid: STRUCT<gold, pred, gold_ge, pred_ge>
    (gold rows / predicted columns with some cell > threshold, and >=)."""
    grid, n_p = _c(grid), _c(n_pred)
    idx = F.sequence(F.lit(0), F.greatest(n_p - 1, F.lit(0)))

    def rows(op):
        return F.size(F.filter(grid, lambda row: F.exists(row, lambda s: op(s))))

    def cols(op):
        return F.size(F.filter(idx, lambda j: (j < n_p) & F.exists(grid, lambda row: op(F.get(row, j)))))

    gt, ge = (lambda s: s > threshold), (lambda s: s >= threshold)
    return F.struct(rows(gt).alias("gold"), cols(gt).alias("pred"),
                    rows(ge).alias("gold_ge"), cols(ge).alias("pred_ge"))


def scores_from_hits(hits, n_gold, n_pred) -> Column:
    """Semantic metrics of one record from its matched counts (evaluation
    preset, strict '>'):

    accuracy  : share of gold tags with some predicted tag above threshold;
                both empty -> 1, one empty -> 0 (O-A8)
    f1/p/r    : recall over gold, precision over predicted, duplicates
                counted; either side empty -> 0 (O-A10, O-A11)
    sft_f1    : the SFT variant with '>=' and both empty -> 1 (O-A12)
    """
    h, n_g, n_p = _c(hits), _c(n_gold), _c(n_pred)
    any_empty = (n_g == 0) | (n_p == 0)
    both_empty = (n_g == 0) & (n_p == 0)
    rec = F.when(any_empty, 0.0).otherwise(_ratio(h["gold"], n_g))
    prec = F.when(any_empty, 0.0).otherwise(_ratio(h["pred"], n_p))
    acc = F.when(both_empty, 1.0).when(any_empty, 0.0).otherwise(_ratio(h["gold"], n_g))
    sft_f1 = F.when(both_empty, 1.0).when(any_empty, 0.0).otherwise(
        _f1(_ratio(h["pred_ge"], n_p), _ratio(h["gold_ge"], n_g)))
    return F.struct(acc.alias("accuracy"), _f1(prec, rec).alias("f1"), prec.alias("precision"),
                    rec.alias("recall"), sft_f1.alias("sft_f1"))


def semantic_scores(gold, pred, threshold: float = 0.8) -> Column:
    """Semantic metrics of one record in one expression (see scores_from_hits).
    Inside DataFrame jobs ``score.with_semantic`` stages the grid and the
    counts as columns so the grid is computed once per record."""
    g, p = _c(gold), _c(pred)
    return scores_from_hits(grid_hits(sim_grid(g, p), F.size(p), threshold), F.size(g), F.size(p))


def best_matches(gold, pred) -> Column:
    """For each gold tag, the most similar predicted tag (first on ties) and
    its similarity (O-A9): ARRAY<STRUCT<gold_tag, pred_tag, similarity>>."""
    g, p = _c(gold), _c(pred)

    def per_gold(gt):
        start = F.struct(F.lit(-1).alias("j"), F.lit(float("-inf")).alias("s"))

        def best_of(sims):
            return F.aggregate(
                F.sequence(F.lit(0), F.greatest(F.size(p) - 1, F.lit(0))), start,
                lambda acc, j: F.when((j < F.size(p)) & (F.get(sims, j) > acc["s"]),
                                      F.struct(j.alias("j"), F.get(sims, j).alias("s"))).otherwise(acc))

        # The similarity list of this gold tag is computed once (let).
        best = let(F.transform(p, lambda pt: similarity(gt, pt)), best_of)
        return F.struct(gt["tag"].alias("gold_tag"), F.get(p, best["j"])["tag"].alias("pred_tag"),
                        best["s"].alias("similarity"))

    return F.when(F.size(p) > 0, F.transform(g, per_gold)).otherwise(
        F.transform(g, lambda gt: F.struct(gt["tag"].alias("gold_tag"),
                                           F.lit(None).cast("string").alias("pred_tag"),
                                           F.lit(None).cast("double").alias("similarity"))))


def best_from_grid(gold, pred, grid) -> Column:
    """``best_matches`` of name lists from their similarity grid."""
    g, p, rows = _c(gold), _c(pred), _c(grid)

    def per_gold(name, i):
        def best_of(sims):
            start = F.struct(F.lit(-1).alias("j"), F.lit(float("-inf")).alias("s"))
            at = F.transform(sims, lambda s, j: F.struct(j.alias("j"), s.alias("s")))
            return F.aggregate(at, start, lambda acc, x: F.when(x["s"] > acc["s"], x).otherwise(acc))

        best = let(F.get(rows, i), best_of)
        return F.struct(name.alias("gold_tag"), F.get(p, best["j"]).alias("pred_tag"),
                        F.when(F.size(p) > 0, best["s"]).alias("similarity"))

    return F.transform(g, per_gold)


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_bag(tag) -> Column:
    """Stand-in tag encoder as JVM expressions: counts of the 26 letters a-z
    in the lower-cased tag (case, spaces, underscores and punctuation do not
    matter, so spelling variants of one tag share a vector)."""
    t = F.lower(_c(tag))
    return F.array(*[(F.length(t) - F.length(F.replace(t, F.lit(ch), F.lit("")))).cast("double")
                     for ch in LETTERS])

