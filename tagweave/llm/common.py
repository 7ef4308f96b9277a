"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.session import checkpoint_dir, small_batches

# Rows handed to a per-batch function at once: texts are long, so slices stay
# small whatever the session's Arrow batch size is.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from there.

    The copy has no lineage, survives the loss of executors, and its rows stay
    the same however often they are read.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_name(wanted: str, *taken) -> str:
    """``wanted``, with underscores put before it until no table has it."""
    names = {c.lower() for df in taken for c in getattr(df, "columns", df)}
    while wanted.lower() in names:
        wanted = "_" + wanted
    return wanted


def id_bucket(column, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(modulus))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_rows(df: DataFrame, fields: list[T.StructField], make: Callable, rows: int = SLICE_ROWS,
             keep: list[str] | None = None) -> DataFrame:
    """Add ``fields`` to ``df``, computed slice by slice in Arrow batches.

    ``make()`` runs once per task and returns a function from a slice (a
    RecordBatch with the columns of ``df``) to a list of arrays, one per
    field. ``keep`` names the columns of ``df`` to keep (all by default); one
    that has the name of a field is replaced by it.
    """
    small_batches(df.sparkSession)
    made_names = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in made_names]
    at = [df.columns.index(c) for c in kept]
    schema = T.StructType([df.schema.fields[i] for i in at] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for piece in slices(batches, rows):
            made = work(piece)
            yield pa.RecordBatch.from_arrays([piece.column(i) for i in at] + made,
                                             names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
