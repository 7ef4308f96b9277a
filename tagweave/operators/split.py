"""Splits, samples and ordered selections (O-U1 .. O-U3, O-S9, O-F6).

The reference relies on list order ("first n", prefix split). A DataFrame has
no order, so every operator takes an explicit order. Exact positional cuts
use ``global_ordinal``: a range-partitioned sort, per-partition row counts
(one number per partition) and their prefix sums, broadcast back. Cuts in
source order use ``source_ordinal``, which counts rows by byte range and
sorts no row. No unpartitioned window over the data and no driver loop over
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagweave.functions.sizing import bounded_broadcast
from tagweave.session import checkpoint_dir

def key_hash(key: str, seed: int = 0) -> Column:
    """Hash of a key of any type as 32 hex digits (MD5 of 'seed:key'), the
    same in every engine; a null key hashes as the empty text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))


def hash_split(df: DataFrame, key: str, eval_fraction: float = 0.2, seed: int = 0) -> DataFrame:
    """O-U2 (scalable form): train/eval by the first eight hex digits of the key
    hash; no shuffle, stable under re-computation and data growth."""
    cut = f"{min(round((1 - eval_fraction) * 2**32), 2**32 - 1):08x}"
    return df.withColumn("split", F.when(F.substring(key_hash(key, seed), 1, 8) < cut, "train").otherwise("eval"))


def global_ordinal(df: DataFrame, order: list[Column], out: str = "ordinal", total: str | None = None) -> DataFrame:
    """0-based position of every row in a total order (the caller breaks ties);
    ``total`` names a column for the number of all rows.

    1. range-partitioned sort; each row records its partition id and its
       monotonically increasing id (partition id << 33 | row in partition),
    2. the sorted rows are checkpointed to the session's checkpoint folder so
       both passes below see the same partitioning,
    3. row counts per partition (one row per partition) and their running
       sums give each partition's offset; that table is bounded by the
       number of partitions, so it is broadcast.
    The checkpoint holds every column of ``df``: pass only the key and the
    order columns and join a wide payload back by key afterwards.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    ordered = (df.orderBy(*order)
               .withColumn("_tw_pid", F.spark_partition_id())
               .withColumn("_tw_mid", F.monotonically_increasing_id()))
    ordered = ordered.checkpoint(eager=True)
    counts = ordered.groupBy("_tw_pid").agg(F.count(F.lit(1)).alias("_tw_n"))
    w = W.orderBy("_tw_pid").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    every = W.partitionBy(F.lit(0))
    offsets = counts.select("_tw_pid", F.coalesce(F.sum("_tw_n").over(w), F.lit(0)).alias("_tw_off"),
                            *([F.sum("_tw_n").over(every).alias(total)] if total else []))
    local = F.col("_tw_mid") - F.shiftleft(F.col("_tw_pid").cast("long"), 33)
    return (ordered.join(F.broadcast(offsets), "_tw_pid")
            .withColumn(out, F.col("_tw_off") + local)
            .drop("_tw_pid", "_tw_mid", "_tw_off"))


def source_ordinal(df: DataFrame, out: str = "ordinal") -> DataFrame:
    """0-based position, in source order, of every row of a scan (columns
    ``file_name`` and ``pos`` of the readers: files by name, their rows as they
    stand in them), without sorting or keeping the rows.

    A task reads a byte range from its start to its end, so a row's place is
    that of its range's first row and its own number in the range. A first
    scan counts the rows of every range; running sums over these counts (by
    range-partitioned sort, as in ``global_ordinal``) are joined to a second
    scan under a size check. Use within ``session.fixed_splits``: files that are
    cut otherwise by the second scan, or have got more rows, are an error."""
    checkpoint_dir(df.sparkSession)
    numbered = df.withColumn("_tw_row", F.monotonically_increasing_id()).withColumn("_tw_block", F.col("pos.block"))
    ranges = numbered.groupBy("file_name", "_tw_block").agg(F.count(F.lit(1)).alias("_tw_n"), F.min("_tw_row").alias("_tw_first"))
    ordered = ranges.orderBy("file_name", "_tw_block").withColumn("_tw_pid", F.spark_partition_id()).checkpoint(eager=True)
    parts = ordered.groupBy("_tw_pid").agg(F.sum("_tw_n").alias("_tw_n"))
    before = lambda w: F.coalesce(F.sum("_tw_n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("_tw_pid", before(W.orderBy("_tw_pid")).alias("_tw_off"))  # one row per partition
    within = ordered.withColumn("_tw_at", before(W.partitionBy("_tw_pid").orderBy("file_name", "_tw_block")))
    starts = within.join(F.broadcast(offsets), "_tw_pid").select(
        "file_name", "_tw_block", "_tw_n", "_tw_first", (F.col("_tw_off") + F.col("_tw_at")).alias("_tw_start"))
    local = F.col("_tw_row") - F.col("_tw_first")
    place = F.when((local >= 0) & (local < F.col("_tw_n")), F.col("_tw_start") + local).otherwise(
        F.raise_error(F.concat(F.lit("rows or byte ranges changed between two scans of "), F.col("file_name"))).cast("bigint"))
    return numbered.join(bounded_broadcast(starts), ["file_name", "_tw_block"], "left").withColumn(out, place).select(*df.columns, out)


def grouped_ordinal(df: DataFrame, group: str, order: list[Column], out: str = "ordinal") -> DataFrame:
    """0-based position of every row within its group: its place in one sort by
    group and ``order``, less the place of the group's first row. The sort cuts
    groups over tasks by range, so a group may hold any share of the rows; the
    first places are one number for each group (joined back under a size check)."""
    placed = global_ordinal(df, [F.col(group).asc_nulls_first(), *order], out)
    first = placed.groupBy(F.col(group).alias("_tw_group")).agg(F.min(out).alias("_tw_first"))
    return (placed.join(bounded_broadcast(first), F.col(group).eqNullSafe(F.col("_tw_group")))
            .withColumn(out, F.col(out) - F.col("_tw_first")).drop("_tw_group", "_tw_first"))


def prefix_split(df: DataFrame, key: str, eval_fraction: float = 0.2) -> DataFrame:
    """O-U2 (exact form): the first int((1 - eval_fraction) * n) rows by key
    are train, the rest eval."""
    ranked = global_ordinal(df, [F.col(key)], total="_tw_total")
    cut = F.floor(F.lit(1 - eval_fraction) * F.col("_tw_total"))
    return ranked.withColumn("split", F.when(F.col("ordinal") < cut, "train").otherwise("eval")).drop("_tw_total")


def top_fraction(df: DataFrame, score: str, key: str, ratio: float) -> DataFrame:
    """O-F6: keep the top ``ratio`` share of rows by score (ties by key):
    exactly floor(ratio * n) rows."""
    ranked = global_ordinal(df, [F.col(score).desc(), F.col(key).asc()], total="_tw_total")
    return ranked.where(F.col("ordinal") < F.floor(F.lit(ratio) * F.col("_tw_total"))).drop("_tw_total")


def seeded_sample(df: DataFrame, key: str, n: int = 50, seed: int = 0) -> DataFrame:
    """O-U3: min(n, rows) rows chosen by key hash (seeded, reproducible).
    Planned as a distributed top-n (each task keeps n rows)."""
    return df.orderBy(key_hash(key, seed), F.col(key)).limit(n)


def per_group_limit(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """O-S9 per-file ``num_samples``: first n rows of each group by order.
    ``row_number() <= n`` is planned with a window group limit, so every
    task keeps at most n rows per group before the exchange (a group holding
    a third of the data does not reach one task whole)."""
    w = W.partitionBy(group).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def row_range(df: DataFrame, key: str, start: int = 0, end: int | None = None,
              limit: int | None = None) -> DataFrame:
    """O-S9 global range [start, end) in key order, optionally capped."""
    stop = end
    if limit is not None:
        stop = start + limit if stop is None else min(stop, start + limit)
    ranked = global_ordinal(df, [F.col(key)])
    cond = F.col("ordinal") >= start
    if stop is not None:
        cond = cond & (F.col("ordinal") < stop)
    return ranked.where(cond)


def concat(*dfs: DataFrame) -> DataFrame:
    """O-U1: append datasets by column name, no dedupe."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out
