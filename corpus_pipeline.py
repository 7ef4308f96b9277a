"""A training-data pipeline over ``documents``: language ID, near-duplicates,
secrets, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run``
writes each as Parquet to the shared checkpoint folder and hands what it reads
back to the next one. All stages but the last return the columns of ``docs``.
No stage can be expressed in SQL as a whole, so there is no oracle; the tests
compare the stages with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm import lang_id, queries, secret_scan, simhash_dedup, soft_mixing
from tagweave.llm.common import id_bucket, table
from tagweave.session import scratch_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go (so do those without a letter)."""
    model = lang_id.fit(docs.filter(id_bucket("doc_id", 3) != 1))
    prefix = "__lang_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return lang_id.annotate(docs, model, prefix=prefix).filter(~F.col(prefix + "rejected")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id."""
    return simhash_dedup.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every reported secret is replaced by its kind; no document goes."""
    return secret_scan.redact(docs, length="n_chars" if "n_chars" in docs.columns else None)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated until their domains have the target weights. No
    rate is below one: every document stays, and the tokens grow as much as
    the domain furthest above its target makes them."""
    model = soft_mixing.fit(docs, queries.labelled_domains(spark, sf_dir))
    return soft_mixing.mix(docs, model, queries.MIX_TARGETS, floor=1.0, epochs=None)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and decoded bytes of every document, as digests."""
    return queries.bpe_digests(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scans", redact_secrets),
    ("mix_sources", mix_domains),
    ("byte_bpe", encode_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
