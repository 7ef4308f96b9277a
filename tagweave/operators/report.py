"""Distribution and quality reports (O-A2 .. O-A5, O-T1 .. O-T3, O-K5, O-A19).

All reports aggregate first (partial + final hash aggregation keyed by file,
side, position, tag) and only then apply windows, which therefore run over
the small aggregated table: one window partition holds the distinct tags of
one (file, side, position), never the raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagweave.functions.jsonparse import has_key
from tagweave.functions.rows import explode_rows
from tagweave.functions.text import lower_strip
from tagweave.session import checkpoint_dir


def positional_tags(df: DataFrame, side_cols: dict[str, str], key: str = "file_name") -> DataFrame:
    """(key, side, pos, tag) with raw list positions (O-P13): an element's tag,
    NULL tags kept as their own value. Every record whose list is present
    (even empty) also yields one marker row with pos -1, so reports can tell
    files without any list apart in the same pass. All sides come out of one
    explode, so the records are read once. A side may also be a list of VARIANT
    elements: an object gives its tag, a string itself, anything else its JSON."""
    def side_items(side: str, col: str):
        stored = df.schema[col].dataType.elementType.simpleString() == "variant"
        items = F.transform(F.col(col), lambda x, i: F.struct(
            F.lit(side).alias("side"), i.alias("pos"), (element_tag(x) if stored else x["tag"]).alias("tag")))
        marker = F.array(F.struct(F.lit(side).alias("side"), F.lit(-1).alias("pos"),
                                  F.lit(None).cast("string").alias("tag")))
        empty = F.array().cast("array<struct<side:string,pos:int,tag:string>>")
        return F.when(F.col(col).isNotNull(), F.concat(marker, items)).otherwise(empty)

    rows = F.concat(*[side_items(side, col) for side, col in side_cols.items()])
    return explode_rows(df, [key], rows, "t").select(
        key, F.col("t.side").alias("side"), F.col("t.pos").alias("pos"), F.col("t.tag").alias("tag"))


def element_tag(x) -> Column:
    """Tag of a VARIANT list element (O-P13): an object's ``tag``, a string
    itself, any other value as JSON."""
    kind = F.schema_of_variant(x)
    return (F.when(has_key(x, "tag"), F.coalesce(F.try_variant_get(x, "$.tag", "string"), F.lit("null")))
            .when(kind == "STRING", F.try_variant_get(x, "$", "string")).otherwise(F.to_json(x)))


def tag_distribution(pos_tags: DataFrame, positions=(0, 1, 2, 3), key: str = "file_name",
                     require_side: str | None = None) -> DataFrame:
    """O-A2 + O-T3: per (key, side, pos): each tag's count and share, plus the
    position total and the number of distinct tags. With ``require_side``, a
    key without any list on that side is left out entirely (both sides), as
    the reference skips a file without generated lists. Totals are a second,
    smaller aggregate joined back, so no task holds all tags of a file."""
    counts = (pos_tags.where(F.col("pos").isin([-1] + list(positions)))
              .groupBy(key, "side", "pos", "tag").agg(F.count(F.lit(1)).alias("n")))
    # The counts feed the totals and the result: written once to the checkpoint
    # folder (one row per distinct tag), so the records are read once.
    checkpoint_dir(pos_tags.sparkSession)
    counts = counts.checkpoint(eager=True)
    totals = counts.groupBy(F.col(key).alias("_tw_key"), F.col("side").alias("_tw_side"), F.col("pos").alias("_tw_at")).agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_distinct"))
    listed = counts.where(F.col("pos") >= 0)
    out = listed.join(totals, listed[key].eqNullSafe(totals["_tw_key"]) & (listed["side"] == totals["_tw_side"])
                      & (listed["pos"] == totals["_tw_at"])).drop("_tw_key", "_tw_side", "_tw_at")
    if require_side is not None:
        having = totals.where((F.col("_tw_side") == require_side) & (F.col("_tw_at") == -1)).select("_tw_key")
        out = out.join(having, out[key].eqNullSafe(having["_tw_key"]), "left_semi")
    return out.withColumn("pct", F.col("n") * 100.0 / F.col("total"))


def topic_top(pos_tags: DataFrame, k: int = 30, side: str = "gen", key: str = "file_name") -> DataFrame:
    """O-A3 + O-T1: topics (positions >= 4 pooled) per key: top k by count,
    ties by tag, with the pooled total and distinct count."""
    counts = (pos_tags.where((F.col("side") == side) & (F.col("pos") >= 4))
              .groupBy(key, "tag").agg(F.count(F.lit(1)).alias("n")))
    # The totals are an aggregate of their own, so the rank's group limit runs
    # before the exchange: every task forwards at most k topics per key.
    totals = counts.groupBy(F.col(key).alias("_tw_key")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_distinct"))
    w = W.partitionBy(key).orderBy(F.col("n").desc(), F.col("tag").asc_nulls_first())
    top = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.join(totals, top[key].eqNullSafe(totals["_tw_key"])).drop("_tw_key")


def generation_quality(df: DataFrame, tags_col: str, key: str = "file_name") -> DataFrame:
    """O-A4: per key, records with a tag list, empty lists, incomplete lists
    (1-4 tags), complete lists (5+), and the complete share in percent.
    Rows without a list are left out through conditional counts rather than
    a filter (a filter would be pushed below and re-derive the list)."""
    n = F.size(F.col(tags_col))
    has = F.col(tags_col).isNotNull()
    out = df.groupBy(key).agg(
        F.count_if(has).alias("records"),
        F.count_if(has & (n == 0)).alias("empty"),
        F.count_if(has & (n >= 1) & (n <= 4)).alias("incomplete"),
        F.count_if(has & (n >= 5)).alias("complete"),
    )
    return out.where(F.col("records") > 0).withColumn(
        "success_pct", F.col("complete") * 100.0 / F.col("records"))


def position_compare(df: DataFrame, gen_names: str, gold_names: str, key: str = "file_name",
                     max_pos: int = 5, gen_list: str | None = None, gold_list: str | None = None) -> DataFrame:
    """O-A5: generated vs gold names position by position (lower + strip,
    first min(len, len, 5)); exact when matches == number of gold names,
    partial when > 0, else none. Records with an empty side are skipped but
    stay in the denominator (total_samples). Emptiness is that of the stored
    lists where ``gen_list`` and ``gold_list`` name them (a list without any
    name is not empty), else of the names. ``rate_pos<i>`` is the share of all
    records, in percent, that match at the position."""
    g = F.transform(F.col(gen_names), lower_strip)
    t = F.transform(F.col(gold_names), lower_strip)
    eq = F.zip_with(F.slice(g, 1, max_pos), F.slice(t, 1, max_pos),
                    lambda a, b: F.coalesce(a == b, F.lit(False)))
    skip = (F.size(F.col(gen_list or gen_names)) <= 0) | (F.size(F.col(gold_list or gold_names)) <= 0)
    matches = F.size(F.filter(eq, lambda x: x))
    scored = df.select(key, skip.alias("skip"), matches.alias("m"),
                       F.size(F.col(gold_names)).alias("ng"), eq.alias("eq"))
    aggs = [F.count(F.lit(1)).alias("total_samples"),
            F.count_if(~F.col("skip") & (F.col("m") == F.col("ng"))).alias("exact_matches"),
            F.count_if(~F.col("skip") & (F.col("m") != F.col("ng")) & (F.col("m") > 0)).alias("partial_matches"),
            F.count_if(~F.col("skip") & (F.col("m") != F.col("ng")) & (F.col("m") == 0)).alias("no_matches")]
    aggs += [F.count_if(~F.col("skip") & F.coalesce(F.get(F.col("eq"), i), F.lit(False))).alias(f"match_pos{i}")
             for i in range(max_pos)]
    counts = scored.groupBy(key).agg(*aggs)
    return counts.select("*", *[(F.col(f"match_pos{i}") * 100.0 / F.col("total_samples")).alias(f"rate_pos{i}") for i in range(max_pos)])


def rows_per_file(df: DataFrame, key: str = "file_name") -> DataFrame:
    """O-A19: rows loaded per file."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
