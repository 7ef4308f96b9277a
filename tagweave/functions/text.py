"""String expressions: whitespace handling, tag normalisation, truncation,
templates and previews. All return Columns built from JVM functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.strip() removes Unicode whitespace; Spark's trim only U+0020.
_STRIP = r"(?U)^\s+|\s+\z"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Whitespace strip with Python str.strip() semantics."""
    return F.regexp_replace(_c(c), _STRIP, "")


def lower_strip(c) -> Column:
    return strip_ws(F.lower(_c(c)))


def normalize_tag(c) -> Column:
    """Tag spelling normalisation (O-P5).

    '_' becomes a space, the value is stripped, a space goes before every
    capital that is not the first character, spaces around '-' and '/' are
    removed, runs of whitespace collapse to one space, and it is stripped
    again. ``MachineLearning`` -> ``Machine Learning``, ``NLP`` -> ``N L P``.
    NULL stays NULL.
    """
    t = F.regexp_replace(_c(c), "_", " ")
    t = strip_ws(t)
    t = F.regexp_replace(t, "(?<!^)(?=[A-Z])", " ")
    t = F.regexp_replace(t, r"(?U)\s*-\s*", "-")
    t = F.regexp_replace(t, r"(?U)\s*/\s*", "/")
    t = F.regexp_replace(t, r"(?U)\s+", " ")
    return strip_ws(t)


def word_tokens(c) -> Column:
    """Whitespace tokens of the whole text (stand-in for a model tokenizer)."""
    return F.regexp_extract_all(_c(c), F.lit(r"\S+"), F.lit(0))


def token_pieces(c) -> Column:
    """The whitespace tokens, each with the white space after it: the text from
    its first token on. One pass, whatever the text holds."""
    return F.regexp_extract_all(_c(c), F.lit(r"\S+\s*"), F.lit(0))


def _head(c, pieces: Column, n: int) -> Column:
    """The text up to the end of its n-th token."""
    kept = F.array_join(F.slice(pieces, 1, n), "")
    return F.concat(F.regexp_extract(_c(c), r"^\s*", 0), F.regexp_replace(kept, r"(?<!\s)\s+\z", ""))


TRUNCATION_MARKER = "\n\n[Content truncated]\n\n"


def truncate_head_tail(c, max_tokens: int = 600, tokens=None) -> Column:
    """Head + tail truncation (O-P3).

    When the text has more than ``max_tokens`` tokens, keep the first and the
    last ``max_tokens // 2`` tokens around a marker; otherwise keep the text
    unchanged. The kept parts are cut from the original text at token
    boundaries, so their own whitespace (line breaks) is preserved, like
    decoding a slice of tokens. Token counting runs over the whole text. Pass
    ``tokens`` (a column already holding ``token_pieces`` of the text) to
    tokenise once per row when several truncations or counts share it.
    """
    half = max_tokens // 2
    pieces = token_pieces(c) if tokens is None else _c(tokens)
    n = F.size(pieces)
    tail = F.array_join(F.slice(pieces, F.greatest(n - half + 1, F.lit(1)), F.lit(half)), "")
    return F.when(n <= max_tokens, _c(c)).otherwise(
        F.concat(_head(c, pieces, half), F.lit(TRUNCATION_MARKER), tail))


def cap_tokens(c, max_tokens: int) -> Column:
    """Keep the first ``max_tokens`` tokens (O-P4), cut from the original text
    at the token boundary (its own whitespace preserved); shorter texts are
    kept whole."""
    # Bound once, as the pieces are used twice.
    return F.get(F.transform(F.array(token_pieces(c)), lambda p: F.when(F.size(p) <= max_tokens, _c(c)).otherwise(
        _head(c, p, max_tokens))), 0)


def fill_template(template: str, **fields) -> Column:
    """Fill ``{name}`` placeholders of a fixed template with columns (O-P2).

    Braces inside the substituted values stay literal because the template is
    split once at build time, never re-scanned.
    """
    import re

    parts = re.split(r"\{(\w+)\}", template)
    cols = []
    for i, p in enumerate(parts):
        if i % 2 == 0:
            if p:
                cols.append(F.lit(p))
        else:
            cols.append(F.coalesce(_c(fields[p]).cast("string"), F.lit("")))
    return F.concat(*cols) if cols else F.lit("")


def chat_wrap(c, user_marker: str = "<start_of_turn>user\n",
              end_marker: str = "<end_of_turn>\n",
              model_marker: str = "<start_of_turn>model\n") -> Column:
    """Single-turn chat wrapping with configurable markers (O-P17)."""
    return F.concat(F.lit(user_marker), _c(c), F.lit(end_marker), F.lit(model_marker))


def preview(c, n: int = 300) -> Column:
    """First ``n`` characters plus '...', 'N/A' when missing (O-P20)."""
    return F.concat(F.substring(F.coalesce(_c(c), F.lit("N/A")), 1, n), F.lit("..."))
