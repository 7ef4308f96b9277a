"""Array-to-rows helpers.

``explode`` / ``posexplode`` make Catalyst infer ``size(arr) > 0`` on the
child and push that filter down through the projections, inlining the whole
expression that built the array (for a parsed tag list: the parse and the
text derivation, many times over). The ``_outer`` generators infer no such
filter; the NULL row they emit for an empty array is dropped right after the
generator, where no pushdown can reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(df: DataFrame, keep: list, arr: Column | str, value: str = "value") -> DataFrame:
    """One row per array element: keep + [value]."""
    a = F.col(arr) if isinstance(arr, str) else arr
    return (df.select(*keep, F.posexplode_outer(a).alias("_tw_pos", value))
            .where(F.col("_tw_pos").isNotNull()).drop("_tw_pos"))


def posexplode_rows(df: DataFrame, keep: list, arr: Column | str, pos: str = "pos",
                    value: str = "value") -> DataFrame:
    """One row per array element with its 0-based position: keep + [pos, value]."""
    a = F.col(arr) if isinstance(arr, str) else arr
    return (df.select(*keep, F.posexplode_outer(a).alias(pos, value))
            .where(F.col(pos).isNotNull()))


def once(value: Column) -> Column:
    """``value`` as the output of a generator of one row: filters on it stay
    above the generator, where they would otherwise be pushed below the
    projection and each evaluate the whole expression (a JSON parse) again."""
    return F.explode_outer(F.array(value))
