"""Readers for record files (O-S1 .. O-S9).

JSON Lines are read as text and parsed with the strict sentinel parse, so
one bad line never fails a job and ``_corrupt_record`` pruning pitfalls do
not apply. Files are discovered by Spark's own listing (recursive lookup,
glob filter) and every row keeps its source path as ``file_name``. All
readers return DataFrames with VARIANT payloads for polymorphic fields and
typed columns for the rest; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.functions.jsonparse import allow_repeated_keys, has_key, is_object, record_value
from tagweave.functions.rows import explode_rows, once
from tagweave.sources.documents import document_texts

# Fixed container keys of the judge loader, in lookup order.
CONTAINER_KEYS = ["data", "results", "items", "samples"]
# Bytes of a VARIANT, at most.
MAX_VARIANT = 128 << 20


def _text_lines(spark: SparkSession, path, glob: str | None = None, recursive: bool = False, position: bool = False) -> DataFrame:
    """Lines with their file and, if asked for, their place in it (``pos``): the
    start of the byte range that Spark reads and the row's number in the task.
    In a file, ``pos`` ascends as the lines do."""
    r = spark.read.format("text")
    if glob:
        r = r.option("pathGlobFilter", glob)
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    paths = path if isinstance(path, (list, tuple)) else [path]
    df = r.load(list(paths))
    return df.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file_name"), *(
        [F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("pos")] if position else []))


def jsonl_variant(spark: SparkSession, path, glob: str | None = "*.jsonl",
                  recursive: bool = False, position: bool = False) -> DataFrame:
    """Each line parsed as one record: (file_name, line, v VARIANT or NULL when invalid)."""
    allow_repeated_keys(spark)
    lines = _text_lines(spark, path, glob, recursive, position)
    return lines.select("*", once(record_value(F.col("line"))).alias("v"))


def tolerant_jsonl(spark: SparkSession, path, glob: str | None = "*.jsonl",
                   recursive: bool = False, position: bool = False) -> DataFrame:
    """O-S1 / O-S2: keep lines that parse to a non-empty JSON object; blank,
    broken and non-object lines are skipped. Returns (file_name, v), and the
    source position ``pos`` if asked for."""
    df = jsonl_variant(spark, path, glob, recursive, position)
    ok = df.v.isNotNull() & is_object(df.v) & (F.schema_of_variant(df.v) != "OBJECT<>")
    return df.where(ok).select("file_name", "v", *(["pos"] if position else []))


def jsonl_rejects(spark: SparkSession, path, glob: str | None = "*.jsonl", recursive: bool = False) -> DataFrame:
    """What ``tolerant_jsonl`` skips, counted per file: blank lines, lines that
    are not one JSON value (invalid), values other than objects, empty objects."""
    df = jsonl_variant(spark, path, glob, recursive)
    reason = (F.when(F.trim("line") == "", "blank").when(df.v.isNull(), "invalid")
              .when(~is_object(df.v), "not_object").when(F.schema_of_variant(df.v) == "OBJECT<>", "empty_object"))
    return df.select("file_name", reason.alias("reason")).where(F.col("reason").isNotNull()).groupBy(
        "file_name", "reason").agg(F.count(F.lit(1)).alias("n"))


def document_rows(spark: SparkSession, path, glob: str | None = "*.json", recursive: bool = False) -> DataFrame:
    """(file_name, kind, v, error, pos) of every record of the JSON documents under
    ``path``. A document is read by as many tasks as it has byte ranges
    (``documents.document_texts``), so only a record is bounded by the size of
    a VARIANT; one that exceeds it or is not one JSON value is an error row,
    and the others of its document are kept."""
    allow_repeated_keys(spark)
    rows = document_texts(spark, path, glob, recursive)
    failed = F.col("kind") == "error"
    v = F.when(~failed, record_value(F.trim(F.regexp_replace("doc", r"^[\r\n\t]+|[\r\n\t]+$", ""))))
    why = F.when(F.octet_length("doc") > MAX_VARIANT, "element too large").otherwise("element is not one JSON value")
    return rows.select("*", once(v).alias("v")).select(
        "file_name", F.when(F.col("v").isNull(), "error").otherwise(F.col("kind")).alias("kind"), "v",
        F.when(failed, F.col("doc")).when(F.col("v").isNull(), why).alias("error"), F.struct("block", "row").alias("pos"))


def json_documents(spark: SparkSession, path, glob: str | None = "*.json",
                   recursive: bool = False, position: bool = False) -> DataFrame:
    """O-S3: JSON documents: a top-level list gives one row per element, a
    single object one row, JSON Lines (this library's own output) one row per
    object. What cannot be read is left to ``document_rejects``."""
    rows = document_rows(spark, path, glob, recursive)
    return rows.where((F.col("kind") == "item") | (F.col("kind").isin("value", "line") & is_object(F.col("v")))).select(
        "file_name", "v", *(["pos"] if position else []))


def document_rejects(spark: SparkSession, path: str, glob: str | None = "*.json", recursive: bool = False) -> DataFrame:
    """(file_name, error) of every document, or element, that cannot be read."""
    return document_rows(spark, path, glob, recursive).where(F.col("kind") == "error").select("file_name", "error")


def strict_jsonl(spark: SparkSession, path, glob: str | None = "*.jsonl") -> DataFrame:
    """O-S4 (line form): every non-blank line must be one JSON value; the
    first bad line fails the job when it is read (``raise_error``), it is
    never skipped. Returns (file_name, v)."""
    allow_repeated_keys(spark)
    lines = _text_lines(spark, path, glob).where(F.trim(F.col("line")) != "")
    v = record_value(F.col("line"))
    msg = F.concat(F.lit("invalid JSON line in "), F.col("file_name"))
    return lines.select("file_name", F.coalesce(v, F.raise_error(msg)).alias("v"))


def judge_input(spark: SparkSession, path: str) -> DataFrame:
    """O-S4: strict JSON Lines files, or JSON documents holding a list or an
    object whose first list-valued key among data / results / items /
    samples holds the rows. A document without such a list fails the job."""
    lines = strict_jsonl(spark, path, "*.jsonl")
    docs = container_rows(document_rows(spark, path, "*.json"))
    return lines.unionByName(docs)


def container_rows(docs: DataFrame) -> DataFrame:
    """O-S4 container form over ``document_rows``: a document that is an object
    yields the first of data / results / items / samples that is a list, a list
    its elements as they are, whatever keys they own, JSON Lines their rows. A
    document without such a list, or one that cannot be read, fails the job."""
    inner = F.coalesce(*[F.try_variant_get(F.col("v"), f"$.{k}", "array<variant>") for k in CONTAINER_KEYS])
    fail = F.raise_error(F.concat(F.lit("no rows in "), F.col("file_name"), F.lit(": "), F.coalesce("error", F.lit("no list in the document"))))
    rows = F.when(F.col("kind").isin("item", "line"), F.array("v")).when(inner.isNotNull(), inner).otherwise(fail.cast("array<variant>"))
    return explode_rows(docs, ["file_name"], rows, "v")


def positional_record(v) -> F.Column:
    """O-S7: a record stored as [index, prompt, parsed_tags] (length >= 3) or
    as an object with prompt and parsed_tags -> STRUCT<index, prompt,
    parsed_tags VARIANT>; anything else NULL."""
    arr = F.try_variant_get(v, "$", "array<variant>")
    from_list = F.struct(
        F.try_variant_get(F.get(arr, 0), "$", "bigint").alias("index"),
        F.try_variant_get(F.get(arr, 1), "$", "string").alias("prompt"),
        F.get(arr, 2).alias("parsed_tags"))
    has = F.variant_get(v, "$.prompt", "variant").isNotNull() & F.variant_get(v, "$.parsed_tags", "variant").isNotNull()
    from_obj = F.struct(
        F.try_variant_get(v, "$.index", "bigint").alias("index"),
        F.try_variant_get(v, "$.prompt", "string").alias("prompt"),
        F.variant_get(v, "$.parsed_tags", "variant").alias("parsed_tags"))
    return (F.when(arr.isNotNull() & (F.size(arr) >= 3), from_list)
            .when(is_object(v) & has, from_obj))


def preference_dir(spark: SparkSession, path: str, glob: str = "*.{jsonl,json}") -> DataFrame:
    """O-S5: non-recursive JSON Lines of preference rows (``*.jsonl``, or the
    ``*.json`` parts that ``sinks.write_jsonl`` leaves): (file_name, prompt,
    chosen, rejected, weight VARIANT, has_weight). Raises when no valid row
    loads (checked with one ``limit(1)``)."""
    rows = tolerant_jsonl(spark, path, glob, recursive=False)
    out = rows.select(
        "file_name",
        F.variant_get(F.col("v"), "$.prompt", "variant").alias("prompt"),
        F.variant_get(F.col("v"), "$.chosen", "variant").alias("chosen"),
        F.variant_get(F.col("v"), "$.rejected", "variant").alias("rejected"),
        F.variant_get(F.col("v"), "$.weight", "variant").alias("weight"),
        F.variant_get(F.col("v"), "$.weight", "variant").isNotNull().alias("has_weight"))
    if not out.limit(1).take(1):
        raise ValueError(f"no valid preference rows under {path}")
    return out


def evaluation_rows(spark: SparkSession, path: str) -> DataFrame:
    """O-S6 + O-S2 + O-S3: every ``.json`` / ``.jsonl`` under ``path``
    (recursive), rows as (file_name, v, pos): ``pos`` orders the rows of a file
    as the file does."""
    lines = tolerant_jsonl(spark, path, "*.jsonl", recursive=True, position=True)
    docs = json_documents(spark, path, "*.json", recursive=True, position=True)
    return lines.unionByName(docs.where(is_object(F.col("v"))))


def source_fields(rows: DataFrame) -> DataFrame:
    """Typed view of evaluation rows (FIXTURES A1): index, prompt, input,
    context, parsed_tags (VARIANT), error, and key presence of input/prompt."""
    v = F.col("v")

    def s(k):
        return F.try_variant_get(v, f"$.{k}", "string")

    return rows.select(
        "file_name", F.try_variant_get(v, "$.index", "bigint").alias("index"),
        s("prompt").alias("prompt"), s("input").alias("input"), s("context").alias("context"),
        F.variant_get(v, "$.parsed_tags", "variant").alias("parsed_tags"),
        F.variant_get(v, "$.generated_tags", "variant").alias("generated_tags"),
        # A present key counts as an error, whatever its value.
        F.coalesce(s("error"), F.when(has_key(v, "error"), F.lit("null"))).alias("error"), v.alias("v"),
        *(["pos"] if "pos" in rows.columns else []))
