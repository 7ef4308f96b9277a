"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import SparkSession

# Settings every job relies on: AQE re-plans joins and coalesces partitions at
# run time, skew-join splitting covers hot keys, and the session time zone is
# pinned so that timestamps compare equal across engines.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Model-call steps receive Arrow batches of records with long texts: keep
    # batches small so a batch stays far below a Python worker's memory.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
    # Checkpoints written by size checks and ordinals are removed once the
    # DataFrames that use them are gone.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Rows of an Arrow batch between the JVM and a Python worker, at most.
BATCH_ROWS = 1024


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the session's Arrow batches to BATCH_ROWS rows (``rows``, if those
    are more): whole texts are long, and a batch is held on both sides of every
    task at once."""
    name, most = "spark.sql.execution.arrow.maxRecordsPerBatch", max(BATCH_ROWS, rows)
    if not 0 < int(spark.conf.get(name)) <= most:
        spark.conf.set(name, str(most))


@contextmanager
def held_conf(spark: SparkSession, values: dict):
    """Within this, the session's settings are ``values``; afterwards what they were."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def fixed_splits(spark: SparkSession):
    """Within this, a scan that is run again cuts its files into the same byte
    ranges and deals them to the same tasks, also when executors have joined
    or left meanwhile (else their cores have a say in it)."""
    cores = spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or str(spark.sparkContext.defaultParallelism)
    name = "spark.sql.files.minPartitionNum"
    return held_conf(spark, {name: spark.conf.get(name, None) or cores})


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "tagweave", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the settings above.

    Without ``master`` the one that was submitted counts (spark-submit, or
    ``local[*]`` where nothing was).
    """
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a private one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder (HDFS, S3, ...)
    and is used as is; a cluster session without one is an error. Only a
    local session without one (tests) gets a fresh temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not sc.master.startswith("local"):
        # A machine-local folder is not readable by other executors.
        raise RuntimeError("spark.checkpoint.dir is not set: point it at a folder shared by the cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tagweave-ckpt-"))
    return sc.getCheckpointDir()


def _file_system(sc: SparkContext, path: str):
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(sc._jsc.hadoopConfiguration()), where


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there; a store that cannot be reached raises."""
    fs, where = _file_system(spark.sparkContext, path)
    return fs.exists(where)


def list_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none where it is not there."""
    fs, where = _file_system(spark.sparkContext, path)
    return [x.getPath().getName() for x in fs.listStatus(where) if x.isDirectory()] if fs.exists(where) else []


def remove_path(sc: SparkContext, path: str) -> None:
    fs, where = _file_system(sc, path)
    fs.delete(where, True)


_scratch: list[str] = []


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder for files that a job
    writes and reads back; removed when the program ends."""
    if not _scratch:
        atexit.register(_remove_scratch)
    _scratch.append(f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _scratch[-1]


def _remove_scratch() -> None:
    sc = SparkContext._active_spark_context
    for path in _scratch if sc is not None and sc._jsc is not None else []:
        remove_path(sc, path)


def scale_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 128 << 20,
               shuffle_fraction: float = 0.25, max_shuffle_partitions: int = 100_000) -> dict:
    """Partition sizing for a cluster run over ``input_bytes`` of input.

    * scan splits of 2 x ``target_partition_bytes`` (documents carry long
      texts; one split stays well within a task's memory after decoding);
    * the initial shuffle partition count sized for the data that actually
      crosses exchanges. These jobs shuffle narrow rows (keys, counts, tag
      rows, previews) after partial aggregation, estimated as
      ``shuffle_fraction`` of the input, at ``target_partition_bytes`` per
      partition, never fewer than two waves of tasks and capped so the
      map-output bookkeeping (maps x reducers) stays manageable;
    * AQE coalescing and skew splitting around the same advisory size.
    Pass the result as ``extra`` to ``build_session``.
    """
    wanted = -(-int(input_bytes * shuffle_fraction) // target_partition_bytes)
    shuffle_parts = min(max(2 * total_cores, wanted), max(max_shuffle_partitions, 2 * total_cores))
    return {
        "spark.sql.files.maxPartitionBytes": str(2 * target_partition_bytes),
        "spark.sql.shuffle.partitions": str(shuffle_parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": str(target_partition_bytes // 4),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    }
