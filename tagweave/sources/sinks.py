"""Writers (O-K1 .. O-K7). Every sink is a parallel DataFrame write: JSON
Lines (one object per line, non-ASCII kept), partitioned by run and file
where the reference mirrored paths. Appends go through task commit, so a lost
executor re-runs its task without duplicating committed output."""

from __future__ import annotations

import re
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Writer options of texts that are written to be read again: at a low level
# gzip takes little more time than plain text, and repeats of a text in one line
# (a prompt, its source, the prompt that was sent) take next to nothing.
GZIP = {"compression": "gzip", "zlib.compress.level": "FOUR"}


def write_jsonl(df: DataFrame, path: str, mode: str = "append", keep_nulls: bool = True,
                partition_by: list[str] | None = None, options: dict | None = None) -> None:
    """O-K1 / O-K2 / O-K6: JSON Lines; nulls written unless ``keep_nulls`` is off."""
    w = df.write.mode(mode).options(**(options or {})).option("ignoreNullFields", str(not keep_nulls).lower())
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(path)


def run_name(model_path: Column) -> Column:
    """O-K3: a run name from a model path: path separators become '_'."""
    return F.regexp_replace(model_path, r"[/\\]", "_")


def write_results(df: DataFrame, path: str, run: str) -> None:
    """O-K3: the results of a run, in the run's partition, ``file_name`` as a
    column (a folder per input file would take one file from every task). A
    run that is repeated replaces its partition and no other, also by a run
    without rows."""
    folder = quote(re.sub(r"[/\\]", "_", run), safe=" -_.~@+,()")
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/run={folder}")


def write_failed_cases(cases: DataFrame, path: str) -> None:
    """O-F5: the failed cases of a run, one object per line."""
    write_jsonl(cases, path, mode="overwrite")


def write_summary(overall: DataFrame, per_file: DataFrame, path: str) -> None:
    """O-K4: the overall row and the per-file rows, two small JSON outputs."""
    write_jsonl(overall, f"{path}/overall", mode="overwrite")
    write_jsonl(per_file, f"{path}/per_file", mode="overwrite")


def write_report(report: DataFrame, path: str) -> None:
    """O-K5: the long-form distribution report (file, section, pos, tag, n, pct)."""
    report.write.mode("overwrite").option("header", "true").csv(path)


def append_run(record: DataFrame, path: str) -> None:
    """O-K7: append one run record (counts, configuration, before/after) to a runs table."""
    write_jsonl(record.withColumn("recorded_at", F.current_timestamp()), path, mode="append")
