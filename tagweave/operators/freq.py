"""Rare-tag filter (O-A1, O-F1, O-F2, O-J2, O-A17, O-K6).

Counts come from the unfiltered data in one pass (no fixpoint). Plan shape:
  1. first-4 tag rows (projection + explode),
  2. (pos, tag) counts: hash aggregate with map-side partial counts, so a
     hot tag (a language holding a third of all rows) is pre-summed in
     every task before the exchange,
  3. rare keys (n < min_freq) joined back to the checked rows with a
     null-safe key; the rare set is written to the checkpoint folder and
     broadcast when its rows and bytes are under bounds, otherwise the join stays a
     shuffle join and AQE splits the partition of a hot key,
  4. distinct bad sample keys (same size check), then a left-anti join to
     keep samples: with the keys broadcast the records are not shuffled.
Nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagweave.functions.sizing import DEFAULT_MAX_ROWS, bounded_broadcast
from tagweave.operators.parse import first_tags
from tagweave.operators.split import grouped_ordinal
from tagweave.session import checkpoint_dir

DEFAULT_POSITIONS = (0, 1, 2, 3)


def tag_frequencies(tag_rows: DataFrame) -> DataFrame:
    """O-A1: (pos, tag, n) over all responses; NULL tags form one group."""
    return tag_rows.groupBy("pos", "tag").agg(F.count(F.lit(1)).alias("n"))


def _checked_rare_rows(tag_rows: DataFrame, freq: DataFrame, min_freq: int, positions,
                       max_broadcast_rows: int) -> DataFrame:
    rare = freq.where(F.col("n") < min_freq).select(
        F.col("pos").alias("_tw_rpos"), F.col("tag").alias("_tw_rtag"), F.col("n").alias("n"))
    rare = bounded_broadcast(rare, max_broadcast_rows)
    checked = tag_rows.where(F.col("pos").isin(list(positions)))
    cond = (F.col("pos") == F.col("_tw_rpos")) & F.col("tag").eqNullSafe(F.col("_tw_rtag"))
    return checked.join(rare, cond, "inner").drop("_tw_rpos", "_tw_rtag")


class RareFilter:
    """Outputs of the rare-tag filter, built on first access (so asking for the
    frequency table does not run the size checks of the other outputs).

    kept     samples whose checked tags all have count >= min_freq
    removed  removed sample keys with up to 3 reasons (response order, then
             position order) as rows (key, reason_rank, pos, tag, n)
    freq     the (pos, tag, n) table
    stats    one row: original_count, kept_count, removed_count, retention_pct
    """

    def __init__(self, cleaned: DataFrame, min_freq: int, positions, key: str, max_broadcast_rows: int):
        self.cleaned, self.min_freq, self.key = cleaned, min_freq, key
        self.positions = list(positions) if positions else list(DEFAULT_POSITIONS)
        self.max_rows = max_broadcast_rows
        self._cache: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = getattr(self, "_" + name)()
        return self._cache[name]

    def _rows(self) -> DataFrame:
        # The narrow (key, response, pos, tag) table feeds both the counts and
        # the rare-key join: written once to the checkpoint folder so the
        # responses are parsed once for both.
        checkpoint_dir(self.cleaned.sparkSession)
        return first_tags(self.cleaned, 4, self.key).checkpoint(eager=True)

    def _freq(self) -> DataFrame:
        return tag_frequencies(self["rows"])

    def _bad_rows(self) -> DataFrame:
        return _checked_rare_rows(self["rows"], self["freq"], self.min_freq, self.positions, self.max_rows)

    def _bad_keys(self) -> DataFrame:
        # Removed samples are usually few: with a checked count they are
        # broadcast and the anti join keeps the records where they are.
        return bounded_broadcast(self["bad_rows"].select(self.key).distinct(), self.max_rows)

    def _kept(self) -> DataFrame:
        return self.cleaned.join(self["bad_keys"], self.key, "left_anti")

    def _removed(self) -> DataFrame:
        order = F.array_position(F.array(*[F.lit(p) for p in self.positions]), F.col("pos"))
        w = W.partitionBy(self.key).orderBy("response_pos", order)
        return (self["bad_rows"].withColumn("reason_rank", F.row_number().over(w))
                .where(F.col("reason_rank") <= 3)
                .select(self.key, "reason_rank", "pos", "tag", "n"))

    def _stats(self) -> DataFrame:
        # original = a count of the records (no column is read), removed = the
        # distinct bad keys (already small): one union, no join, no second
        # pass over the records for the kept side.
        counts = self.cleaned.select(F.lit(1).alias("o"), F.lit(0).alias("r")).unionByName(
            self["bad_keys"].select(F.lit(0).alias("o"), F.lit(1).alias("r")))
        agg = counts.agg(F.coalesce(F.sum("o"), F.lit(0)).alias("original_count"),
                         F.coalesce(F.sum("r"), F.lit(0)).alias("removed_count"))
        return agg.select(
            "original_count", (F.col("original_count") - F.col("removed_count")).alias("kept_count"),
            "removed_count",
            (F.try_divide((F.col("original_count") - F.col("removed_count")).cast("double"),
                          F.col("original_count").cast("double")) * 100).alias("retention_pct"))


    def _settings(self) -> DataFrame:
        """The filter's settings, one row (O-K6)."""
        spark = self.cleaned.sparkSession
        return spark.createDataFrame([(self.min_freq, self.positions)], "min_freq int, positions array<int>")

    def _first_removed(self) -> DataFrame:
        """The first 50 removed keys in order (O-K6, O-T2)."""
        return self["bad_keys"].orderBy(self.key).limit(50)

    def _first_reasons(self) -> DataFrame:
        """The first 20 removal reasons by key and rank (O-K6, O-T2)."""
        return self["removed"].orderBy(self.key, "reason_rank").limit(20)


def rare_filter(cleaned: DataFrame, min_freq: int = 2, positions=DEFAULT_POSITIONS,
                key: str = "index", max_broadcast_rows: int = DEFAULT_MAX_ROWS) -> RareFilter:
    """O-F1 + O-F2 + O-A17: the filter's outputs (``kept``, ``removed``,
    ``freq``, ``stats``), each built when first asked for."""
    return RareFilter(cleaned, min_freq, positions, key, max_broadcast_rows)


def top_tags(freq: DataFrame, k: int = 10, checked=DEFAULT_POSITIONS, min_freq: int = 2) -> DataFrame:
    """The filter report's tag table (O-T1): tags per position by count, ties
    by tag. Checked positions list every tag with ``passes`` (n >= min_freq);
    unchecked positions list their ``k`` most frequent tags (passes NULL).
    A checked position may hold every distinct tag of the data, so ranks come
    from a range-partitioned sort (``split.grouped_ordinal``), not from a window
    by position."""
    checked = list(checked) if checked else list(DEFAULT_POSITIONS)
    is_checked = F.col("pos").isin(checked)
    ranked = grouped_ordinal(freq, "pos", [F.col("n").desc(), F.col("tag").asc_nulls_first()], "rank")
    return (ranked.withColumn("rank", (F.col("rank") + 1).cast("int")).where(is_checked | (F.col("rank") <= k))
            .withColumn("passes", F.when(is_checked, F.col("n") >= min_freq)))
