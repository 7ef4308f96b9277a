"""Token ids by a tokenizer callable (O-P3, O-P4, O-P16; SURVEY 2.12).

A tokenizer is any object with ``encode(text) -> ids`` and ``decode(ids) ->
text``; ``factory`` builds it once per task. Texts go through Arrow batches, are
encoded whole, and only what was asked for leaves: counts, or texts cut on
token ids and decoded back. The whitespace tokens of ``functions.text`` stay the
default elsewhere, as they need no Python.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

register_pickle_by_value(sys.modules[__name__])

# Texts are long: rows handed to the tokenizer at once.
ROWS = 256
# Code points of a stand-in token, and the bits that hold one.
PIECE, POINT_BITS = 3, 21


class PieceTokenizer:
    """Stand-in subword tokenizer: pieces of up to three characters without
    white space, or one white-space character. An id holds its piece's code
    points, so ids are decoded without a vocabulary. Both ways are array
    operations over the whole text."""

    def encode(self, text: str) -> list[int]:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        if not len(points):
            return []
        space, at = (points == 0x20) | (points >= 0x09) & (points <= 0x0D), np.arange(len(points))
        # A piece starts at white space and at every PIECE-th character after it.
        starts = space | ((at - np.maximum.accumulate(np.where(space, at, -1)) - 1) % PIECE == 0)
        first = np.flatnonzero(starts)
        place = at - np.repeat(first, np.diff(first, append=len(points)))
        return np.add.reduceat((points.astype(np.int64) + 1) << POINT_BITS * place, first).tolist()

    def decode(self, ids) -> str:
        points = np.asarray(ids, np.int64)[:, None] >> POINT_BITS * np.arange(PIECE) & (1 << POINT_BITS) - 1
        return (points[points > 0] - 1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def _step(df: DataFrame, text_cols: list[str], factory: Callable, fields: list[T.StructField], work: Callable) -> DataFrame:
    """Add ``fields`` computed from the text columns of a row: ``work(tokenizer, *texts)`` gives their values."""
    clash = {f.name.lower() for f in fields} & {c.lower() for c in df.columns}
    if clash:
        raise ValueError(f"columns already there: {sorted(clash)}")
    at = [df.columns.index(c) for c in text_cols]
    schema = T.StructType([*df.schema.fields, *fields])
    arrow = [{"int": pa.int32(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64())}[f.dataType.simpleString()] for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = factory()
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                piece = batch.slice(start, ROWS)
                made = [work(tokenizer, *texts) for texts in zip(*[piece.column(i).to_pylist() for i in at])]
                yield pa.RecordBatch.from_arrays([*piece.columns, *[pa.array(c, t) for c, t in zip(zip(*made), arrow)]], names=schema.fieldNames())

    return df.mapInArrow(run, schema)


def with_ids(df: DataFrame, text: str, factory: Callable, out: str = "ids") -> DataFrame:
    """Add the token ids of a text (null text: null)."""
    return _step(df, [text], factory, [T.StructField(out, T.ArrayType(T.LongType()))],
                 lambda tok, t: (None if t is None else list(tok.encode(t)),))


def _head_tail(tokenizer, ids, text: str, max_tokens: int, marker: str) -> str:
    half = max_tokens // 2
    if len(ids) <= max_tokens:
        return text
    return tokenizer.decode(ids[:half]) + marker + tokenizer.decode(ids[len(ids) - half:])


def truncate_ids(df: DataFrame, text: str, factory: Callable, max_tokens: int = 600, out: str = "truncated_text",
                 count: str = "n_tokens") -> DataFrame:
    """O-P3 on token ids: a text of more than ``max_tokens`` tokens becomes its
    first and last ``max_tokens // 2`` tokens around a marker, decoded."""
    from tagweave.functions.text import TRUNCATION_MARKER as marker

    def work(tokenizer, t):
        if t is None:
            return None, None
        ids = tokenizer.encode(t)
        return len(ids), _head_tail(tokenizer, ids, t, max_tokens, marker)

    return _step(df, [text], factory, [T.StructField(count, T.IntegerType()), T.StructField(out, T.StringType())], work)


def cap_ids(df: DataFrame, text: str, factory: Callable, max_tokens: int, out: str = "capped_text") -> DataFrame:
    """O-P4 on token ids: the first ``max_tokens`` tokens, decoded."""
    def work(tokenizer, t):
        if t is None:
            return (None,)
        ids = tokenizer.encode(t)
        return (t if len(ids) <= max_tokens else tokenizer.decode(ids[:max_tokens]),)

    return _step(df, [text], factory, [T.StructField(out, T.StringType())], work)


def token_budget(df: DataFrame, query_col: str, target_col: str, factory: Callable, max_len: int = 2048,
                 prompt_cap: int = 1800, eos: str | None = None) -> DataFrame:
    """O-P16 with a tokenizer: ``prompts.token_budget`` in its tokens. The query
    is capped on ids; prompt and full text are encoded as they would be in
    training (the prompt by itself, then prompt and target together)."""
    # Imported here: executors get this module by value and need no other one.
    from tagweave.functions.text import fill_template
    from tagweave.operators.prompts import EOS, SFT_TEMPLATE, budget_columns

    eos = EOS if eos is None else eos
    capped = cap_ids(df, query_col, factory, prompt_cap, "_tw_query")
    texts = capped.withColumn("_tw_prompt", fill_template(SFT_TEMPLATE, query=F.col("_tw_query"))).withColumn(
        "_tw_full", F.concat("_tw_prompt", F.coalesce(target_col, F.lit("")), F.lit(" " + eos))).drop("_tw_query")
    counted = _step(texts, ["_tw_prompt", "_tw_full"], factory, [T.StructField(c, T.IntegerType()) for c in ("n_prompt", "n_total")],
                    lambda tok, p, t: (len(tok.encode(p)), len(tok.encode(t))))
    return budget_columns(counted.drop("_tw_prompt", "_tw_full"), max_len)
