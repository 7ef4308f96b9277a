"""Cleaning jobs over generation records (O-P5, O-P6, O-P7, O-P12, O-P13).

``clean_responses`` rewrites the responses array in place with a nested
``transform`` (no explode, no shuffle): each response text is parsed
leniently; a parsed list keeps its elements with normalised tags, anything
else keeps the raw text and an error class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.functions.jsonparse import lenient_value, tag_items_with_flag
from tagweave.functions.rows import posexplode_rows
from tagweave.functions.text import normalize_tag

PARSE_ERROR = "JSONDecodeError"


def clean_responses(df: DataFrame, col: str = "responses", normalise: bool = True) -> DataFrame:
    """O-P7: responses -> ARRAY<STRUCT<response_id, temperature, items, raw_text,
    text_error, parsed_kind>>.

    ``items`` is the parsed list (ARRAY<STRUCT<tag, explanation, is_tag,
    is_str, text>>) or NULL when the text did not parse to a list;
    ``parsed_kind`` is 'list', 'other' (valid JSON, not a list) or NULL.
    """
    step1 = F.transform(F.col(col), lambda r: F.struct(
        r["response_id"].alias("response_id"), r["temperature"].alias("temperature"),
        r["text"].alias("raw_text"), lenient_value(r["text"]).alias("v")))

    def step2(r):
        lst = F.try_variant_get(r["v"], "$", "array<variant>")
        return F.struct(
            r["response_id"].alias("response_id"), r["temperature"].alias("temperature"),
            tag_items_with_flag(lst, normalise=normalise).alias("items"),
            r["raw_text"].alias("raw_text"),
            F.when(r["raw_text"].isNotNull() & r["v"].isNull(), F.lit(PARSE_ERROR)).alias("text_error"),
            F.when(lst.isNotNull(), "list").when(r["v"].isNotNull(), "other").alias("parsed_kind"))

    return df.withColumn(col, F.transform(step1, step2))


def response_tags(cleaned: DataFrame, key: str = "index", col: str = "responses") -> DataFrame:
    """All tag items of all cleaned responses with their raw index position:
    (key, response_id, raw_pos, is_tag, tag, text) (O-P13 positions)."""
    r = posexplode_rows(cleaned, [key], col, "response_pos", "r")
    r = posexplode_rows(r.select(key, "response_pos", F.col("r.response_id").alias("response_id"), "r"),
                        [key, "response_pos", "response_id"], F.col("r.items"), "raw_pos", "it")
    return r.select(
        key, "response_pos", "response_id", "raw_pos", F.col("it.is_tag").alias("is_tag"),
        F.col("it.tag").alias("tag"), F.col("it.text").alias("text"))


def first_tags(cleaned: DataFrame, n: int = 4, key: str = "index", col: str = "responses") -> DataFrame:
    """O-P12: the first ``n`` elements of each response list, keeping objects
    with a ``tag`` key; positions compact after the filter:
    (key, response_pos, response_id, pos, tag)."""
    def firsts(r):
        return F.filter(F.slice(F.coalesce(r["items"], F.array()), 1, n), lambda x: x["is_tag"])

    r = posexplode_rows(cleaned, [key], col, "response_pos", "r")
    r = posexplode_rows(r.select(key, "response_pos", F.col("r.response_id").alias("response_id"), "r"),
                        [key, "response_pos", "response_id"], firsts(F.col("r")), "pos", "it")
    return r.select(key, "response_pos", "response_id", "pos", F.col("it.tag").alias("tag"))


def normalised_tags(cleaned_raw: DataFrame, key: str = "index", col: str = "responses") -> DataFrame:
    """Rows (key, response_id, pos, raw_tag, tag) for every tag object of every
    parsed response, before and after normalisation (O-P5)."""
    c = clean_responses(cleaned_raw, col, normalise=False)
    t = response_tags(c, key, col).where(F.col("is_tag"))
    return t.select(key, "response_id", F.col("raw_pos").alias("pos"),
                    F.col("tag").alias("raw_tag"), normalize_tag(F.col("tag")).alias("tag"))


def variant_map(norm_rows: DataFrame) -> DataFrame:
    """Which raw spellings merged into which normalised tag: (raw_tag, tag, n)."""
    return norm_rows.groupBy("raw_tag", "tag").agg(F.count(F.lit(1)).alias("n"))
