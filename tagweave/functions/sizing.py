"""Size-checked broadcasting.

A side is broadcast only after its size is known to be under a bound. The
side is first written to the session's checkpoint folder (which also cuts its
lineage, so the checks and the join read the same rows and nothing is
computed twice); its row count and its size in bytes (estimated per column from the schema:
string lengths, 8 bytes per number or array element) are measured in one
pass. Beyond either bound the plain
DataFrame is returned and the join stays a shuffle join, where AQE's
skew-join splitting handles hot keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.session import checkpoint_dir

# Default bounds for a table shipped to every executor.
DEFAULT_MAX_ROWS = 2_000_000
DEFAULT_MAX_BYTES = 256 << 20


def _row_bytes(df: DataFrame) -> F.Column:
    """Estimated bytes of one row: strings by their UTF-8 length, arrays of
    numbers by 8 bytes per element, arrays of strings by their joined length,
    other values by their JSON text (an over-estimate), plus 8 per column."""
    from pyspark.sql import types as T

    parts = []
    for f in df.schema.fields:
        c, t = F.col(f.name), f.dataType
        if isinstance(t, T.StringType):
            e = F.octet_length(c)
        elif isinstance(t, T.ArrayType) and isinstance(t.elementType, T.NumericType):
            e = F.size(c) * 8
        elif isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StringType):
            e = F.octet_length(F.array_join(c, "")) + F.size(c) * 8
        elif isinstance(t, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)):
            e = F.lit(8)
        else:
            e = F.octet_length(F.to_json(F.struct(c)))
        parts.append(F.coalesce(e, F.lit(0)) + 8)
    return sum(parts[1:], parts[0]) if parts else F.lit(0)


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_MAX_ROWS,
                      max_bytes: int = DEFAULT_MAX_BYTES) -> DataFrame:
    """``broadcast(df)`` when df has at most ``max_rows`` rows and about
    ``max_bytes`` bytes, else ``df``. Rows and bytes are measured in one pass
    over the checkpointed side."""
    checkpoint_dir(df.sparkSession)
    small = df.checkpoint(eager=True)
    n, size = small.agg(F.count(F.lit(1)), F.coalesce(F.sum(_row_bytes(small)), F.lit(0))).first()
    return F.broadcast(small) if n <= max_rows and size <= max_bytes else small
