"""Strict and lenient JSON parsing into VARIANT, and tag-list views of it.

``try_parse_json`` and ``from_json`` accept trailing junk, so a strict parse
wraps the text in a sentinel object: the text is valid JSON exactly when the
wrapper parses and its closing key is readable.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagweave.functions.text import _c, strip_ws, normalize_tag

_END_KEY = "__tw_end"


def _wrap(c) -> Column:
    return F.try_parse_json(F.concat(F.lit('{"v":'), _c(c), F.lit(f',"{_END_KEY}":1}}')))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and apply ``body`` to it: a one-element
    ``transform`` binds the value to a lambda variable, so an expensive
    expression (a JSON parse) used twice in ``body`` is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _complete(w: Column) -> Column:
    return F.try_variant_get(w, f"$.{_END_KEY}", "int") == 1


def strict_valid(c) -> Column:
    """TRUE when the whole text is one JSON value, FALSE otherwise (NULL text: FALSE)."""
    return F.coalesce(_complete(_wrap(c)), F.lit(False))


def strict_value(c) -> Column:
    """The parsed VARIANT, or NULL when the text is not exactly one JSON value."""
    return let(_wrap(c), lambda w: F.when(_complete(w), F.variant_get(w, "$.v", "variant")))


def record_value(c) -> Column:
    """The parsed VARIANT of a stored record, or NULL when the text is not one
    JSON value. Takes what Python's reader takes: of repeated keys the last
    one counts (``allow_repeated_keys``), NaN and Infinity are numbers, and a
    string may be as long as a VARIANT holds (128 MiB)."""
    text = F.concat(F.lit('{"v":'), _c(c), F.lit(f',"{_END_KEY}":1}}'))
    options = {"allowNonNumericNumbers": "true", "maxStringLen": str(2**31 - 1)}
    wrapped = F.coalesce(F.try_parse_json(text), F.from_json(text, "variant", options))
    return let(wrapped, lambda w: F.when(_complete(w), F.variant_get(w, "$.v", "variant")))


def allow_repeated_keys(spark) -> None:
    """Let JSON objects with a repeated key parse, the last occurrence winning."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def strict_list(c) -> Column:
    """ARRAY<VARIANT> when the text is exactly one JSON array, else NULL."""
    return let(_wrap(c), lambda w: F.when(_complete(w), F.try_variant_get(w, "$.v", "array<variant>")))


def lenient_text(c) -> Column:
    """Text after the lenient clean-up: strip, strip back-ticks, drop a leading
    'json' (any case), strip (the second attempt of O-P6)."""
    t = strip_ws(_c(c))
    t = F.regexp_replace(t, r"^`+|`+\z", "")
    t = F.regexp_replace(t, r"(?i)^json", "")
    return strip_ws(t)


def lenient_value(c) -> Column:
    """Strict parse, else the lenient clean-up then a strict parse (O-P6)."""
    return F.coalesce(strict_value(c), strict_value(lenient_text(c)))


def is_object(v) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def has_key(v, key: str) -> Column:
    """Key presence on a JSON object (a present JSON null counts as present)."""
    return is_object(v) & F.variant_get(v, f"$.{key}", "variant").isNotNull()


def variant_str(v, key: str) -> Column:
    """String form of a key's value; a present JSON null gives 'None' like str(None)."""
    return F.coalesce(F.try_variant_get(v, f"$.{key}", "string"),
                      F.when(has_key(v, key), F.lit("None")))


def tag_items_with_flag(arr, normalise: bool = False) -> Column:
    """Like tag_items but adds ``is_tag`` (object with a ``tag`` key) and
    ``is_str`` and ``text`` (the element's string or JSON form)."""
    def one(x):
        tag = F.when(has_key(x, "tag"), F.try_variant_get(x, "$.tag", "string"))
        if normalise:
            tag = normalize_tag(tag)
        is_str = F.schema_of_variant(x) == "STRING"
        return F.struct(
            tag.alias("tag"),
            F.try_variant_get(x, "$.explanation", "string").alias("explanation"),
            has_key(x, "tag").alias("is_tag"),
            is_str.alias("is_str"),
            F.when(is_str, F.try_variant_get(x, "$", "string")).otherwise(F.to_json(x)).alias("text"),
        )
    return F.transform(arr, one)
