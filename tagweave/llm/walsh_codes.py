"""Vector codes: product quantisation in integers, distances by a Walsh-Hadamard transform.

A component x becomes floor(4096 x). A vector is cut into equal consecutive
parts (zeros fill up a last part that would be shorter), and each part
position has a codebook. Parts and entries are padded with zeros to a power of
two, P, and transformed by an integer Walsh-Hadamard transform, which
multiplies every squared distance by P exactly. Squared differences are then
added up coefficient by coefficient, those of few sign changes first (they
hold most of the distance of smooth parts), and an entry is out as soon as
its sum passes the whole distance of an entry that is known to be near. No
floating point is used after the first floor. Components too large for 64-bit
arithmetic go through the same code with Python integers.

The codebooks are learned by rounds of assignment and floor means. In a round
every task adds up its parts by entry and sends 32-bit limbs of the sums, which
Spark adds up; the driver holds the codebooks (parts x entries x width numbers)
and nothing else. ``df`` is read once a round: hand in a table, or cut a
costly plan first.

Cases: null vectors, and those that hold null or non-finite components, take
no part. Shorter vectors are filled up with zeros to the length of the longest,
an empty vector too. Rows of one id each count; the first codebook takes one of
them, the smallest in the order of arrays. Rows without an id are coded and
counted, and are never among the smallest ids. With fewer ids than entries the
codebook is that short; without any row the result is empty, without any id
every code is empty and the error null. Errors beyond 64 bits are null.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.functions.sizing import bounded_broadcast
from tagweave.llm.common import small_batches

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
# Vectors coded at once.
ROWS = 1024
LIMB = 32


@dataclass
class Codebooks:
    """``entries`` has the shape (parts, entries, width), of whole numbers."""
    length: int
    entries: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for x in self.entries.ravel()).encode()).hexdigest()


def sequency(size: int) -> np.ndarray:
    """The transform's coefficients (in the order the butterfly leaves them) by their number of sign changes."""
    row = np.arange(size)
    signs = np.bitwise_count(row[:, None] & row[None, :]) & 1
    return np.argsort((signs[:, 1:] != signs[:, :-1]).sum(axis=1), kind="stable")


def transform(parts: np.ndarray) -> np.ndarray:
    """Integer Walsh-Hadamard transform of the last axis, zero-padded to a power of two, in sequency order."""
    width = parts.shape[-1]
    size = 1 << max(0, width - 1).bit_length()
    out = np.zeros((*parts.shape[:-1], size), parts.dtype)
    out[..., :width] = parts
    step = 1
    while step < size:
        pairs = out.reshape(*out.shape[:-1], -1, 2, step)
        out = np.stack([pairs[..., 0, :] + pairs[..., 1, :], pairs[..., 0, :] - pairs[..., 1, :]], axis=-2).reshape(out.shape)
        step *= 2
    return out[..., sequency(size)]


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each transformed part its nearest entry (ties: the first) and the scaled squared distance."""
    first = (x[:, :1] - entries[None, :, 0]) ** 2
    lead = first.argmin(axis=1)
    bound = ((x - entries[lead]) ** 2).sum(axis=1)
    row, entry = np.nonzero(first <= bound[:, None])
    total = first[row, entry]
    for j in range(1, x.shape[1]):
        total = total + (x[row, j] - entries[entry, j]) ** 2
        left = total <= bound[row]
        row, entry, total = row[left], entry[left], total[left]
    start = np.searchsorted(row, np.arange(len(x)))
    least = np.minimum.reduceat(total, start) if len(x) else total
    best = np.flatnonzero(total == least[row])
    best = best[np.searchsorted(row[best], np.arange(len(x)))]
    return entry[best], total[best]


def whole_numbers(column: pa.Array, length: int) -> np.ndarray:
    """floor(4096 x) of every component, rows filled up with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        scaled = np.floor(flat * SCALE)
    small = not len(flat) or np.abs(scaled).max() < 2**62
    made = scaled.astype(np.int64) if small else np.array([int(v) if np.isfinite(v) else int(x) * SCALE for v, x in zip(scaled, flat)], object)
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == length).all():
        return made.reshape(len(sizes), length)
    out = np.zeros((len(sizes), length), made.dtype)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = made
    return out


def code_parts(vectors: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts (rows, parts, width), each one's entry and its squared distance."""
    n_parts, _, width = entries.shape
    parts = vectors.reshape(len(vectors), n_parts, width)
    size = 1 << max(0, width - 1).bit_length()
    top = max((int(np.abs(a).max()) for a in (parts, entries) if a.size), default=0)
    if 4 * size**3 * (top + 1) ** 2 >= 2**63:
        parts, entries = parts.astype(object), entries.astype(object)
    elif entries.dtype == object:
        entries = entries.astype(np.int64)
    code = np.zeros((len(vectors), n_parts), np.int64)
    error = np.zeros((len(vectors), n_parts), parts.dtype)
    for p in range(n_parts):
        code[:, p], error[:, p] = nearest(transform(parts[:, p]), transform(entries[p]))
    return parts, code, error // size


def limbs(value: int) -> list[int]:
    """Signed base 2^32 digits, the lowest first."""
    out, sign, rest = [], -1 if value < 0 else 1, abs(value)
    while rest:
        out.append(sign * (rest & (1 << LIMB) - 1))
        rest >>= LIMB
    return out


def task_sums(batches, entries: np.ndarray, length: int):
    """Per part, entry and position the limbs of the sums over a task's vectors (position -1: their number)."""
    n_parts, k, width = entries.shape
    sums, held = np.zeros((n_parts, k, width), object), np.zeros((n_parts, k), np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            parts, code, _ = code_parts(whole_numbers(batch.column(0).slice(at, ROWS), length), entries)
            for p in range(n_parts):
                held[p] += np.bincount(code[:, p], minlength=k)
                for e in np.unique(code[:, p]):
                    sums[p, e] += parts[code[:, p] == e, p].astype(object).sum(axis=0)
    rows = [(p, e, j, i, x) for (p, e, j), v in np.ndenumerate(sums) for i, x in enumerate(limbs(int(v)))]
    rows += [(p, e, -1, 0, int(n)) for (p, e), n in np.ndenumerate(held) if n]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32()] * 4 + [pa.int64()])],
                                         names=["part", "entry", "position", "limb", "value"])


def kept(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows whose vector is there and holds finite numbers only."""
    c = F.col(vector)
    return df.filter(c.isNotNull() & ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def first_codebooks(rows: DataFrame, vec_id: str, vector: str, n_parts: int, n_entries: int) -> Codebooks:
    longest = rows.agg(F.max(F.size(vector))).first()[0] or 0
    length = -(-max(longest, 1) // n_parts) * n_parts
    ids = [r[0] for r in rows.select(vec_id).filter(F.col(vec_id).isNotNull()).distinct().orderBy(vec_id).limit(n_entries).collect()]
    found = dict(rows.filter(F.col(vec_id).isin(ids)).groupBy(vec_id).agg(F.min(vector)).collect()) if ids else {}
    start = whole_numbers(pa.array([found[i] for i in ids], pa.list_(pa.float64())), length)
    return Codebooks(length, start.reshape(len(ids), n_parts, length // n_parts).transpose(1, 0, 2).copy())


def learn(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", n_parts: int = PARTS, n_entries: int = ENTRIES,
          rounds: int = ROUNDS) -> Codebooks:
    """Codebooks after ``rounds`` of assignment and floor means; an entry without parts stays."""
    rows = kept(df, vector)
    small_batches(df.sparkSession)
    books = first_codebooks(rows, vec_id, vector, n_parts, n_entries)
    if not books.entries.shape[1]:
        return books
    for _ in range(rounds):
        entries, length = books.entries, books.length
        added = (rows.select(vector).mapInArrow(lambda batches: task_sums(batches, entries, length),  # noqa: B023
                                                "part int, entry int, position int, limb int, value long")
                 .groupBy("part", "entry", "position", "limb").agg(F.sum("value")).collect())
        held, sums = {}, {}
        for p, e, j, i, value in added:
            if j < 0:
                held[p, e] = value
            else:
                sums[p, e, j] = sums.get((p, e, j), 0) + (value << LIMB * i)
        new = entries.astype(object)
        for (p, e), n in held.items():
            new[p, e] = [sums.get((p, e, j), 0) // n for j in range(new.shape[2])]
        books = Codebooks(length, new)
    return books


def encode(df: DataFrame, books: Codebooks, vec_id: str = "vec_id", vector: str = "embedding", others: tuple[str, ...] = ()) -> DataFrame:
    """``vec_id``, ``others``, code (two hex digits a part) and error of the kept
    rows. Other columns are left out, so none clashes; those named code or
    error in ``others`` are not allowed."""
    if {"code", "error"} & {c.lower() for c in (vec_id, *others)}:
        raise ValueError("code and error are names of the result")
    rows = kept(df, vector).select(vec_id, *others, vector)
    small_batches(df.sparkSession)
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    last, entries, length = len(rows.columns) - 1, books.entries, books.length

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                piece = batch.slice(at, ROWS)
                if entries.shape[1]:
                    _, code, error = code_parts(whole_numbers(piece.column(last), length), entries)
                    codes = [r.tobytes().hex() for r in code.astype(np.uint8)]
                    errors = [e if e < 2**63 else None for e in map(int, error.astype(object).sum(axis=1))]
                else:
                    codes, errors = [""] * piece.num_rows, [None] * piece.num_rows
                yield pa.RecordBatch.from_arrays([*piece.columns[:last], pa.array(codes, pa.string()), pa.array(errors, pa.int64())],
                                                 names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


def compress(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", n_parts: int = PARTS,
             n_entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error (the errors of
    equal labels, nulls together) and codebooks_sha256."""
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    books = learn(rows, "vec_id", "vector", n_parts, n_entries, rounds)
    coded = encode(rows, books, "vec_id", "vector", ("label",))
    # Sums by label are added up in every task first, so a label with a third of all rows is one row a task.
    whole = F.when(F.count("error") == F.count(F.lit(1)), F.sum(F.col("error").cast("decimal(38,0)")))
    sums = coded.groupBy(F.col("label").alias("of")).agg(
        F.when(whole <= F.lit(2**63 - 1).cast("decimal(38,0)"), whole).cast("long").alias("label_error"))
    joined = coded.join(bounded_broadcast(sums), F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
