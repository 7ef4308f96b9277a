"""Resumable, incremental runs with Structured Streaming (O-R1 .. O-R4, O-J1).

The reference re-reads its own output file, skips keys already present and
rewrites the whole file every few rows. Here new input files are picked up
by a file source with ``trigger(availableNow=True)``; each micro-batch goes
through ``ledger.append_new``, which looks its keys up in a bucketed ledger and
writes results by batch, so a replayed batch replaces what it wrote. Running
tables take the changed rows of a streaming aggregation and rewrite only the
buckets that hold them. The streaming checkpoint (in the shared checkpoint
folder) records progress.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.session import checkpoint_dir, fixed_splits, list_folders
from tagweave.streaming.ledger import KeyLedger, append_new, drop_retries, results, retry_rows


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """O-J1: rows whose key is not in the earlier output (left anti join). A
    row without a key is never done."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def resumable_append(spark: SparkSession, in_path: str, out_path: str, checkpoint: str, schema,
                     key: str, transform: Callable[[DataFrame], DataFrame] | None = None,
                     glob: str = "*.jsonl", usable: Column | None = None, files_per_batch: int = 64,
                     options: dict | None = None) -> KeyLedger:
    """O-R1 / O-R2 / O-R3: process every input file not processed yet, and
    append results whose key has none yet. Runs to completion (availableNow).

    Rows whose result is not ``usable`` are taken up again at the start of the
    next run, also without new files. Rows without a key are told apart by
    their content. ``transform`` runs on new rows only and keeps ``row_id``.
    ``options`` are the writer's (a compression, say). Read the output with
    ``ledger.results``."""
    ledger = KeyLedger(spark, f"{out_path}/_ledger")
    before = list_folders(spark, f"{out_path}/_retry")
    again = retry_rows(spark, out_path, schema)
    if again is not None:
        # A label of its own for each round, so that earlier results stay.
        rounds = sum(n.startswith("batch=retry") for n in list_folders(spark, f"{out_path}/ok=true") + list_folders(spark, f"{out_path}/ok=false"))
        # Rows are read from their files again and again, unless a folder of that label is there and gets replaced.
        with fixed_splits(spark):
            append_new(spark, again, out_path, f"retry-{rounds}", key, transform, usable, ledger,
                       stable=f"batch=retry-{rounds}" not in before, options=options)
        drop_retries(spark, out_path, [n[6:] for n in before if n != f"batch=retry-{rounds}"])
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", glob)
              .option("maxFilesPerTrigger", files_per_batch).json(in_path))

    def batch(df: DataFrame, epoch: int) -> None:
        query = df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        with fixed_splits(df.sparkSession):
            append_new(df.sparkSession, df, out_path, f"{query}-{epoch}", key, transform, usable, ledger, stable=True, options=options)

    q = (stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return ledger


def running_tag_counts(spark: SparkSession, in_path: str, checkpoint: str, schema,
                       tag_rows: Callable[[DataFrame], DataFrame], out_path: str) -> DataFrame:
    """O-R4: running (pos, tag) counts over arriving files; no watermark
    because counts never close (the aggregation state keeps one row per
    (pos, tag)). A run that finds no new files leaves the last table. Nothing
    is held on the driver."""
    stream = spark.readStream.schema(schema).json(in_path)
    counts = tag_rows(stream).groupBy("pos", "tag").agg(F.count(F.lit(1)).alias("n"))
    return _running_table(spark, counts, ["pos", "tag"], out_path, checkpoint)


TABLE_BUCKETS = 64


def _running_table(spark: SparkSession, totals: DataFrame, keys: list[str], out_path: str, checkpoint: str,
                   buckets: int = TABLE_BUCKETS) -> DataFrame:
    """Run the available files through a streaming aggregation in update mode
    and keep its table at ``out_path``, in buckets by key hash: a batch reads and
    rewrites the buckets of the rows it changes, and no other. Totals are
    absolute and carry their epoch, so a replayed batch writes the same rows
    and an older one changes nothing."""
    stored = totals.withColumn("epoch", F.lit(0).cast("long")).withColumn("bucket", F.lit(0)).schema

    def merge(df: DataFrame, epoch: int) -> None:
        session = df.sparkSession
        checkpoint_dir(session)
        changed = (df.withColumn("epoch", F.lit(epoch).cast("long")).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
                   .checkpoint(eager=True))
        touched = [r[0] for r in changed.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        there = {int(n[7:]) for n in list_folders(session, out_path) if n.startswith("bucket=")}
        paths = [f"{out_path}/bucket={b}" for b in touched if b in there]
        held = session.read.schema(stored).option("basePath", out_path).parquet(*paths) if paths else session.createDataFrame([], stored)
        newest = F.max_by(F.struct(*[c for c in stored.names if c not in keys]), "epoch")
        merged = (held.unionByName(changed).groupBy(*keys).agg(newest.alias("row")).select(*keys, "row.*")
                  .select(*stored.names).checkpoint(eager=True))
        (merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(out_path))

    q = (totals.writeStream.outputMode("update").foreachBatch(merge)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    if not any(n.startswith("bucket=") for n in list_folders(spark, out_path)):
        return spark.createDataFrame([], totals.schema)
    return spark.read.schema(stored).parquet(out_path).select(*totals.columns)


RESULT_DDL = ("file_name string, index bigint, raw_response string, gold_names array<string>, "
              "error string")


def running_file_metrics(spark: SparkSession, results_path: str, checkpoint: str, out_path: str,
                         schema: str = RESULT_DDL) -> DataFrame:
    """O-A13 over result files as they arrive (the periodic result files of
    O-R3): each new row is parsed and scored (stateless projection), and a
    stateful aggregation keeps per-file sums and counts; the means are
    derived from the sums, so they equal the batch metrics over all rows
    seen. Runs the available files (availableNow) and returns the table."""
    from tagweave.functions.extract import tag_names
    from tagweave.operators import score

    stream = spark.readStream.schema(schema).json(results_path)
    rows = score.parse_generated(stream.where(F.col("error").isNull()), "raw_response")
    rows = score.with_exact(rows.withColumn("pred_names", tag_names(F.col("generated_tags"))),
                            "pred_names", "gold_names")
    valid = F.size("gold_names") > 0
    sums = rows.groupBy("file_name").agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.count_if(valid).alias("valid_samples"),
        *[F.sum(F.when(valid, F.col(m))).alias("sum_" + m) for m in score.EXACT],
        F.count_if(valid & (F.col("exact_match_f1") < 0.5)).alias("failed_cases_count"))
    t = _running_table(spark, sums, ["file_name"], out_path, checkpoint)
    return t.where(F.col("valid_samples") > 0).select(
        "file_name", "total_samples", "valid_samples",
        *[(F.col("sum_" + m) / F.col("valid_samples")).alias(m) for m in score.EXACT],
        "failed_cases_count")
