"""Document fingerprints by Order MinHash.

The k-mers of a text (k code points) are numbered by occurrence, so that a
repeated k-mer counts as often as it occurs. For each of the fingerprint's
components, a permutation of the numbered k-mers selects the ``length``
smallest; these are put in the order in which they stand in the text and the
tuple of their k-mers is hashed to 32 bits. Two texts agree in a component
about as often as they share k-mers in the same order, so likeness (the share
of equal components) falls with the edit distance, moved passages included.

Cases: a text shorter than k is one k-mer of its own length, an empty text has
a fixed fingerprint; equal texts have equal fingerprints; very long texts are
worked through in pieces of bounded size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.llm.common import map_rows, parallelism

K = 8
LENGTH = 2
COMPONENTS = 32
# k-mers permuted at once.
STEP = 2048
LOWEST = -(1 << 63)

_rng = np.random.Generator(np.random.PCG64(77003))
_MULTIPLIERS = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0xA24BAED4963EE407)
_OCCURRENCE = np.uint64(0x9FB21C651E98DF25)


def _mix(h):
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def kmers(text: str, k: int) -> np.ndarray:
    """Hashes of the k-mers in text order."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    k = min(k, len(codes))
    if not k:
        return np.empty(0, np.uint64)
    n = len(codes) - k + 1
    h = codes[:n].copy()
    for i in range(1, k):
        h *= _BASE
        h += codes[i:i + n]
    return _mix(h + np.uint64(k))


def numbered(h: np.ndarray) -> np.ndarray:
    """The k-mers' hashes with their occurrence numbers mixed in."""
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    same = np.flatnonzero(ranked[1:] == ranked[:-1]) + 1
    if not len(same):
        return h
    new = np.ones(len(h), bool)
    new[same] = False
    starts = np.flatnonzero(new)
    number = np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))
    out = h.copy()
    out[order[same]] = _mix(h[order[same]] ^ (number[same].astype(np.uint64) * _OCCURRENCE))
    return out


def fingerprint(text: str, k: int = K, length: int = LENGTH, components: int = COMPONENTS) -> np.ndarray:
    """The components as 32-bit integers."""
    h = kmers(text, k)
    if not len(h):
        return np.zeros(components, np.uint32)
    unique = numbered(h)
    factors = _MULTIPLIERS[:components, None]
    take = min(length, len(h))
    least = np.full((components, take), np.iinfo(np.uint64).max)
    place = np.full((components, take), -1)
    rows = np.arange(components)
    for at in range(0, len(h), STEP):
        values = unique[None, at:at + STEP] * factors
        found, where = [least], [place]
        for _ in range(min(take, values.shape[1])):
            smallest = values.argmin(axis=1)
            found.append(values[rows, smallest][:, None].copy())
            where.append(smallest[:, None] + at)
            values[rows, smallest] = np.iinfo(np.uint64).max
        both, spots = np.concatenate(found, axis=1), np.concatenate(where, axis=1)
        best = np.argsort(both, axis=1, kind="stable")[:, :take]
        least, place = np.take_along_axis(both, best, 1), np.take_along_axis(spots, best, 1)
    in_order = h[np.sort(place, axis=1)]
    total = np.full(components, length, np.uint64)
    for i in range(take):
        total = _mix(total * _BASE + in_order[:, i])
    return (total >> np.uint64(32)).astype(np.uint32)


def text_form(print_: np.ndarray) -> str:
    return print_.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprints(df: DataFrame, text: str = "text", k: int = K, length: int = LENGTH, components: int = COMPONENTS,
                 out: str = "fingerprint") -> DataFrame:
    """Add the fingerprint (eight hex digits per component) to every row."""
    at = df.columns.index(text)

    def start():
        return lambda piece: [pa.array([text_form(fingerprint(t or "", k, length, components))
                                        for t in piece.column(at).to_pylist()], pa.string())]

    return map_rows(df, [T.StructField(out, T.StringType())], start)


def with_next(df: DataFrame, work, fields: list[T.StructField], doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``work(id, text, next text, state, next state)`` for every document and
    the one that follows it in ascending id (after the last: the first).

    Texts are shuffled once. The ids' quantiles cut them into ranges that
    begin with a document of their own; that document is also sent, as the
    follower of the last, to the range before. A range is sorted (spilling if
    need be) and streamed with one text held back. Null ids come first; rows
    with equal ids follow each other by text.
    """
    rows = df.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n_ranges = 3 * parallelism(df.sparkSession)
    shares = [i / n_ranges for i in range(1, n_ranges)]
    first, nulls, cuts = rows.agg(F.min("doc_id"), F.count_if(F.col("doc_id").isNull()),
                                  F.percentile_approx("doc_id", shares, F.lit(10000))).first()
    begins = np.array(sorted({LOWEST if nulls else first, *([] if cuts is None else [first, *cuts])} - {None}), np.int64)
    out_schema = T.StructType([T.StructField("doc_id", T.LongType())] + fields)
    if not len(begins):
        return df.sparkSession.createDataFrame([], out_schema)
    dealt_schema = "range int, follower boolean, doc_id long, text string"

    def deal(batches):
        for batch in batches:
            ids = batch.column(0).fill_null(LOWEST).to_numpy(zero_copy_only=False)
            home = np.searchsorted(begins, ids, side="right") - 1
            heads = np.flatnonzero(begins[home] == ids)
            take = np.concatenate([np.arange(len(ids)), heads])
            ranges = np.concatenate([home, (home[heads] - 1) % len(begins)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ranges), pa.array(np.arange(len(take)) >= len(ids)), batch.column(0).take(pa.array(take)),
                                              batch.column(1).take(pa.array(take))], names=["range", "follower", "doc_id", "text"])

    ordered = (rows.mapInArrow(deal, dealt_schema).repartition("range")
               .sortWithinPartitions("range", "follower", "doc_id", "text"))

    def stream(batches):
        held, closed = None, None
        for batch in batches:
            made = []
            for at in range(batch.num_rows):
                part, follower, doc_id = (batch.column(c)[at].as_py() for c in range(3))
                if part == closed:
                    continue  # further copies of the range's follower
                current = [part, doc_id, batch.column(3)[at].as_py() or "", {}]
                if held is not None:
                    made.append((held[1], *work(held[2], current[2], held[3], current[3])))
                held, closed = (None, part) if follower else (current, None)
                if len(made) >= 256:
                    yield record(made)
                    made = []
            if made:
                yield record(made)

    arrow = [pa.int64()] + [{"string": pa.string(), "bigint": pa.int64(), "double": pa.float64()}[f.dataType.simpleString()] for f in fields]

    def record(made):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), arrow, strict=True)],
                                          names=[f.name for f in out_schema.fields])

    return ordered.mapInArrow(stream, out_schema)


def edited(text: str, other: str) -> str:
    """The text with its last half replaced by as much of the other's beginning."""
    half = len(text) // 2
    return text[:len(text) - half] + other[:half]


def compare_edited(df: DataFrame, doc: str = "doc_id", text: str = "text", k: int = K, length: int = LENGTH,
                   components: int = COMPONENTS) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness."""
    def work(own, other, state, next_state):
        prints = []
        for s, t in ((state, own), (next_state, other)):
            if "print" not in s:
                s["print"] = fingerprint(t, k, length, components)
            prints.append(s["print"])
        changed = edited(own, other)
        print_ = prints[0] if changed == own else fingerprint(changed, k, length, components)
        return (len(own), hashlib.sha256(changed.encode()).hexdigest(), text_form(prints[0]), text_form(print_),
                likeness(prints[0], print_), likeness(prints[0], prints[1]))

    fields = [T.StructField("n_chars", T.LongType()), *[T.StructField(n, T.StringType()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")],
              T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())]
    return with_next(df, work, fields, doc, text)
