"""SimHash near-duplicates by a byte-position inverted index with count filter.

A fingerprint has eight positional bytes. Two fingerprints that differ in at
most ``max_bits`` bits differ in at most as many bytes, so they share at least
``8 - max_bits`` positional bytes: the guaranteed minimum. Postings on single
(position, byte) pairs would have 256 values each and grow with the square of
the corpus, so the index posts every choice of that many positions with its
bytes (28 postings of six bytes for two bits): two fingerprints meet in a
posting list if and only if their tally of shared positional bytes reaches the
minimum. Equal fingerprints are posted once.

The members of a list agree in six bytes, so however large a group of copies
is, a list holds at most 2^16 fingerprints. Within a list the pairs are
verified by their bit distance; what leaves it is one link per member to the
smallest member it reaches, never all pairs, and no link between different
fingerprints is lost for the components.

Cases: a null or wordless text has fingerprint zero and is linked like any
other; repeated rows share a class; a null document id never names a
component (a component of null ids only has a null id); an empty table gives
an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.llm.common import cut, free_name, map_rows
from tagweave.llm.components import components

WORDS = 3
MAX_BITS = 2
SEED = 42
# Hashes whose bits are unpacked at once.
STEP = 1 << 14


def shingles(text: str, words: int = WORDS) -> list[bytes]:
    """Word shingles of the text with A-Z lower-cased; words end at ASCII white space."""
    found = text.encode().lower().split()
    if len(found) < words:
        return [b" ".join(found)] if found else []
    return [b" ".join(s) for s in zip(*[found[i:] for i in range(words)], strict=False)]


def fingerprint(text: str, words: int = WORDS) -> int:
    """The 64 majority bits of the shingles' XXH64 values, as an unsigned integer."""
    grams = shingles(text, words)
    if not grams:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(grams), STEP):
        h = np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams[at:at + STEP]], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(grams), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", words: int = WORDS, out: str = "fingerprint",
                 keep: list[str] | None = None) -> DataFrame:
    """Add the fingerprint (a signed 64-bit integer with the same bits) to every row."""
    at = df.columns.index(text)

    def start():
        return lambda piece: [pa.array(np.array([fingerprint(t or "", words) for t in piece.column(at).to_pylist()],
                                                np.uint64).view(np.int64), pa.int64())]

    return map_rows(df, [T.StructField(out, T.LongType())], start, keep=keep)


def _posting(fp, positions: tuple[int, ...], number: int):
    """List key: the bytes at the positions, with the number of the choice of positions."""
    mask = sum(0xFF << 8 * p for p in positions)
    signed = mask - (1 << 64) if mask >> 63 else mask
    return F.xxhash64(F.lit(number), fp.bitwiseAND(F.lit(signed)))


def list_links(members: np.ndarray, max_bits: int) -> np.ndarray:
    """For each member of a list (sorted, unsigned) the smallest member that it
    reaches over verified pairs of the list."""
    n = len(members)
    label = np.arange(n)
    if n <= 64:
        near = np.bitwise_count(members[:, None] ^ members[None, :]) <= max_bits
        while True:
            new = np.where(near, label[None, :], n).min(axis=1)
            if (new == label).all():
                return members[label]
            label = new[new]
    bits = [1 << b for b in range(64) if ((members[0] ^ members) >> np.uint64(b) & np.uint64(1)).any()]
    masks = [sum(c) for k in range(1, max_bits + 1) for c in combinations(bits, k)]
    pairs = []
    for mask in masks:
        other = members ^ np.uint64(mask)
        at = np.minimum(np.searchsorted(members, other), n - 1)
        hit = np.flatnonzero(members[at] == other)
        pairs.append((hit, at[hit]))
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        new = new[new]
        if (new == label).all():
            return members[label]
        label = new


def links(distinct: DataFrame, fp: str = "fingerprint", max_bits: int = MAX_BITS) -> DataFrame:
    """u, v: verified links between different fingerprints that connect exactly
    those that pairs within ``max_bits`` connect."""
    choices = list(combinations(range(8), 8 - max_bits))
    col = F.col(fp)
    posted = distinct.select(col.alias("fp"), F.explode(F.array(*[_posting(col, c, i) for i, c in enumerate(choices)])).alias("key"))
    lists = posted.groupBy("key").agg(F.collect_list("fp").alias("members")).filter(F.size("members") > 1).select("members")

    def run(batches):
        for batch in batches:
            u, v = [], []
            for members in batch.column(0):
                m = np.unique(members.values.to_numpy().view(np.uint64))
                least = list_links(m, max_bits)
                moved = least != m
                u.append(m[moved])
                v.append(least[moved])
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (u, v)], names=["u", "v"])

    return lists.mapInArrow(run, "u long, v long").distinct()


def classes(prints: DataFrame, doc: str = "doc_id", fp: str = "fingerprint", max_bits: int = MAX_BITS) -> DataFrame:
    """fingerprint, component_id: the smallest document reached from each distinct fingerprint."""
    per_class = cut(prints.groupBy(F.col(fp).alias("fp")).agg(F.min(doc).alias("first")))
    stars = components(links(per_class, "fp", max_bits))
    rooted = per_class.join(stars, per_class.fp == stars.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(least, "root").select(F.col("fp").alias(fp), "component_id")


def near_duplicates(df: DataFrame, doc: str = "doc_id", text: str = "text", words: int = WORDS,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: its id, fingerprint (signed integer) and component_id."""
    rows = df.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    prints = cut(fingerprints(rows, words=words, keep=["doc_id"]))
    return prints.join(classes(prints, max_bits=max_bits), "fingerprint").select("doc_id", "fingerprint", "component_id")


def hex_digits(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(df: DataFrame, doc: str = "doc_id", text: str = "text", words: int = WORDS,
             max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``df`` less all but one document of every component.

    The document with the smallest id stays (nulls last; among rows with that
    id one by row hash). Rows that are equal in every column are one document.
    """
    plain = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]  # maps are not comparable
    rows = df.dropDuplicates(plain)
    row, mark = free_name("__row", df), free_name("__kept", df)
    marked = rows.withColumn(row, F.xxhash64(*[F.col(c) for c in plain]))
    narrow = marked.select(F.col(doc).alias("doc_id"), F.col(row).alias("row"), F.col(text).alias("text"))
    prints = cut(fingerprints(narrow, words=words, keep=["doc_id", "row"]))
    named = prints.withColumn("name", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    kept = classes(named, "name", max_bits=max_bits).select("component_id").distinct().select(F.col("component_id.row").alias(mark))
    return marked.join(kept, marked[row] == kept[mark], "left_semi").select(*df.columns)
