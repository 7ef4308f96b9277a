"""Keyed outputs that are continued run after run (O-R1 .. O-R3, O-J1).

An output folder holds the results of every batch in a folder of its own
(``ok=true/batch=<label>``; a batch that is replayed replaces its folder), rows
that failed (``ok=false/batch=<label>``), and a ledger of the keys that have a
usable result. A key is looked up in the ledger alone, never in the results.

The ledger is Parquet, in 2^depth buckets by key hash; a batch reads the buckets
of its own keys. When buckets have grown to ``BUCKET_KEYS`` keys, or hold too many small
files, the ledger is rewritten with more buckets (each key once for every
doubling, as in a growing hash table). So the bytes that a batch reads depend on
its own keys, not on the size of the output.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.functions.sizing import bounded_broadcast
from tagweave.session import checkpoint_dir, held_conf, list_folders, path_exists, remove_path

BUCKET_KEYS = 100_000
BUCKET_FILES = 32
FIRST_DEPTH = 4
# Buckets named in a read; a batch with keys in more of them reads the whole ledger.
MOST_NAMED = 4096
KEY_DDL = "id string, bucket int, batch string"


def row_id(df: DataFrame, key: str | None) -> Column:
    """The row's identity as text: its key or, where that is null (or without a
    key column), a digest of the whole row, so that rows without key stay apart."""
    content = F.concat(F.lit("\u0000"), F.sha2(F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"}), 256))
    return F.coalesce(F.col(key).cast("string"), content) if key else content


@dataclass
class Read:
    """What a look-up read: buckets, files and keys."""
    buckets: int = 0
    files: int = 0
    keys: int = 0


class KeyLedger:
    def __init__(self, spark: SparkSession, path: str, bucket_keys: int = BUCKET_KEYS, first_depth: int = FIRST_DEPTH):
        self.spark, self.path, self.bucket_keys = spark, path.rstrip("/"), bucket_keys
        # A rewrite counts once it is complete; until then the former one does.
        found = sorted(int(n[6:]) for n in list_folders(spark, self.path) if n.startswith("depth="))
        done = found[:1] + [d for d in found[1:] if path_exists(spark, f"{self._folder(d)}/_SUCCESS")]
        self.depth, self.last_read = max(done, default=first_depth), Read()

    def _folder(self, depth: int) -> str:
        return f"{self.path}/depth={depth}"

    def _bucketed(self, ids: DataFrame, depth: int) -> DataFrame:
        return ids.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(1 << depth)).cast("int"))

    def known(self, ids: DataFrame, batch: str) -> DataFrame:
        """The keys (column ``id``) among ``ids`` that other batches have put in."""
        folder = self._folder(self.depth)
        if not path_exists(self.spark, folder):
            self.last_read = Read()
            return self.spark.createDataFrame([], "id string")
        wanted = [r[0] for r in self._bucketed(ids, self.depth).select("bucket").distinct().limit(MOST_NAMED + 1).collect()]
        held = self.spark.read.schema(KEY_DDL).parquet(folder)
        if len(wanted) <= MOST_NAMED:
            there = {int(n[7:]) for n in list_folders(self.spark, folder) if n.startswith("bucket=")}
            paths = [f"{folder}/bucket={b}" for b in wanted if b in there]
            if not paths:
                self.last_read = Read(len(wanted))
                return self.spark.createDataFrame([], "id string")
            held = self.spark.read.schema(KEY_DDL).option("basePath", folder).parquet(*paths)
        self.last_read = Read(len(wanted), len(held.inputFiles()), held.count())  # a count reads the files' footers
        return held.where(F.col("batch") != batch).select("id").join(ids.select("id"), "id", "left_semi").distinct()

    def add(self, ids: DataFrame, batch: str) -> None:
        """Put keys in; a batch that is replayed replaces what it had put into these buckets."""
        rows = self._bucketed(ids.select("id").distinct(), self.depth).withColumn("batch", F.lit(batch))
        (rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("bucket", "batch").parquet(self._folder(self.depth)))
        read = self.last_read
        if read.buckets and (read.keys > self.bucket_keys * read.buckets or read.files > BUCKET_FILES * read.buckets):
            self.grow()

    def grow(self) -> None:
        """Rewrite with twice as many buckets, or as many as the keys need; each bucket and batch is one file."""
        held = self.spark.read.schema(KEY_DDL).parquet(self._folder(self.depth))
        depth = self.depth + 1
        while held.count() > self.bucket_keys << depth:
            depth += 1
        (self._bucketed(held, depth).withColumn("batch", F.lit("compacted")).select("id", "bucket", "batch").repartition("bucket")
         .write.mode("overwrite").partitionBy("bucket", "batch").parquet(self._folder(depth)))
        old, self.depth = self._folder(self.depth), depth
        remove_path(self.spark.sparkContext, old)


def append_new(spark: SparkSession, rows: DataFrame, out_path: str, batch: str, key: str | None,
               transform: Callable[[DataFrame], DataFrame] | None = None, usable: Column | None = None,
               ledger: KeyLedger | None = None, keep_failed: bool = True, stable: bool = False,
               options: dict | None = None) -> KeyLedger:
    """Run ``transform`` on the rows whose key has no usable result yet, and
    write what it returns, once.

    Repeated keys of the batch are dropped first: the row that comes first
    stays. Rows are told apart by their number in the batch, so only numbers
    and keys are grouped, joined and kept; the rows themselves are read where
    they are. Rows that would not be the same, in the same order and tasks, if
    read again (``stable``: they are; a scan of files within
    ``session.fixed_splits``) are copied first. ``transform`` (a model call,
    say) must keep the column ``row_id``. Rows for which ``usable`` is not true
    are written apart, do not enter the ledger, and are asked again by the next
    batch that brings them; with ``keep_failed`` their input rows are kept for
    that (``retry_rows``). ``options`` are the writer's.
    """
    ledger = ledger or KeyLedger(spark, f"{out_path}/_ledger")
    checkpoint_dir(spark)
    rows = rows if stable else rows.checkpoint(eager=True)
    numbered = rows.withColumn("row_id", row_id(rows, key)).withColumn("_tw_n", F.monotonically_increasing_id())
    every = numbered.select(F.col("row_id").alias("id"), "_tw_n").checkpoint(eager=True)
    first = every.groupBy("id").agg(F.min("_tw_n").alias("_tw_n"))
    known = ledger.known(first.select("id"), batch)
    left_out = every.select("_tw_n").join(first.join(known, "id", "left_anti"), "_tw_n", "left_anti")
    todo = numbered.join(bounded_broadcast(left_out), "_tw_n", "left_anti").drop("_tw_n")
    made = transform(todo) if transform else todo
    good = F.lit(True) if usable is None else F.coalesce(usable, F.lit(False))
    options = options or {}
    # Two files open in a task, instead of a sort of its rows by ``ok``.
    with held_conf(made.sparkSession, {"spark.sql.maxConcurrentOutputFileWriters": "2"}):
        (made.withColumn("ok", good).withColumn("batch", F.lit(batch)).write.mode("overwrite").options(**options)
         .option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", "false").partitionBy("ok", "batch").json(out_path))
    written = {ok: f"{out_path}/ok={str(ok).lower()}/batch={batch}" for ok in (True, False)}
    ids = {ok: spark.read.schema("row_id string").json(p).select(F.col("row_id").alias("id"))
           for ok, p in written.items() if path_exists(spark, p)}
    if False in ids and keep_failed:
        asked = first.join(ids[False], "id", "left_semi").select("_tw_n")
        (numbered.join(bounded_broadcast(asked), "_tw_n", "left_semi").drop("_tw_n", "row_id").write.mode("overwrite").options(**options)
         .option("ignoreNullFields", "false").json(f"{out_path}/_retry/batch={batch}"))
    if True in ids:
        ledger.add(ids[True], batch)
    return ledger


def retry_rows(spark: SparkSession, out_path: str, schema) -> DataFrame | None:
    """Input rows of failed results, for another try (those that have a result
    by now are dropped by the ledger); None if there are none."""
    if not list_folders(spark, f"{out_path}/_retry"):
        return None
    columns = spark.createDataFrame([], schema).columns
    return spark.read.schema(schema).json(f"{out_path}/_retry").select(*columns)


def drop_retries(spark: SparkSession, out_path: str, batches: list[str]) -> None:
    """Forget input rows that a later batch has taken up."""
    for b in batches:
        remove_path(spark.sparkContext, f"{out_path}/_retry/batch={b}")


def results(spark: SparkSession, out_path: str, schema, batch: str | None = None) -> DataFrame:
    """The usable results of all batches and, where ``batch`` is given, its failed ones."""
    columns = spark.createDataFrame([], schema).columns
    parts = [f"{out_path}/ok=true"] + ([f"{out_path}/ok=false/batch={batch}"] if batch else [])
    parts = [p for p in parts if path_exists(spark, p)]
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", out_path).json(parts).select(*columns)
