"""Approximate nearest neighbours by a permutation index.

Every vector is represented by its nearest pivots in order of nearness. The
vectors are dealt into blocks; in a block each pivot has an inverted file of the
vectors on whose list it is, with its weight there (list length less place). A
query reads the files of its own pivots only, an eighth of all where there are
512 pivots, and adds up what they share with it: the footrule distance of two
lists is a constant less twice the sum of the smaller weights. The best
candidates of a block by that distance are then reranked by the inner product of
the original vectors in double precision, and the blocks' lists are merged.

The number of pivots grows with the table up to ``MOST_PIVOTS``, and the candidates
of a query grow with the table's size to the power ``GROWTH``, so their share falls:
a third of 2,000 rows, an eighth of 50,000, a hundredth of 200 million.

Inner products become nearness by one more component that brings all vectors
to the norm of the longest (queries keep a zero there); vectors of one norm
are unchanged by it.

The pivots are a bounded sample: the different vectors with the smallest
hashes. Every vector is indexed. Queries are a stated set, met with all rows
block by block; the work of a block is bounded by its two sizes.

Cases: vectors that are null, zero, of another than the most frequent length,
or that hold null or non-finite components take no part, nor do rows without
id; rows with the same id count once, by the smallest vector; equal vectors
tie to the smaller id; with fewer candidates than asked for, all are returned;
only id and vector are read, so other columns cannot clash; an empty table
gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.llm.common import cut, map_rows, parallelism

LEAST_PIVOTS, MOST_PIVOTS = 128, 512
NEAR = 64
# Different vectors that a query reranks: CANDIDATES * n ** GROWTH, and at least LEAST in a block.
CANDIDATES, GROWTH = 3.2, 0.7
LEAST = 64
BLOCK_ROWS = 16384
QUERY_ROWS = 4096


def usable(df: DataFrame, vec: str, embedding: str) -> tuple[DataFrame, int]:
    """id and vector (doubles) of the rows that take part, and the vectors' length."""
    x = F.col("v")
    rows = df.select(F.col(vec).alias("id"), F.col(embedding).cast("array<double>").alias("v")).filter("id IS NOT NULL")
    fine = rows.filter(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0))
    top = fine.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if top is None:
        return fine, 0
    return fine.filter(F.size("v") == top["n"]).groupBy("id").agg(F.min("v").alias("v")), top["n"]


def pivots(rows: DataFrame, n: int) -> np.ndarray:
    """The n different vectors with the smallest hashes."""
    hashed = rows.withColumn("h", F.xxhash64("v"))
    drawn = [r["h"] for r in hashed.select("h").distinct().orderBy("h").limit(n).collect()]
    found = hashed.filter(F.col("h").isin(drawn)).dropDuplicates(["h"]).orderBy("h").collect()
    return np.array([r["v"] for r in found], np.float64)


def lengthen(x: np.ndarray, norm: float) -> np.ndarray:
    """One more component that brings every row to the given norm."""
    rest = norm * norm - np.einsum("ij,ij->i", x, x)
    rest[rest < 1e-6 * norm * norm] = 0
    return np.concatenate([x, np.sqrt(rest)[:, None]], axis=1)


def nearest_pivots(x: np.ndarray, centres: np.ndarray, near: int) -> np.ndarray:
    """Numbers of the nearest pivots of each row, nearest first (ties to the smaller number)."""
    return np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :near].astype(np.uint16)


def matrix(column) -> np.ndarray:
    held = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return held.flatten().to_numpy(zero_copy_only=False).reshape(len(held), -1) if len(held) else np.empty((0, 0))


def search_block(ids, x, lists, query_ids, q, query_lists, n_pivots: int, k: int, share: float, least: int):
    """(query, id, score) of the k best reranked vectors of a block for each query.

    Copies of a vector are posted and ranked once, so they take one place in the
    reranked share; no query needs more than the k + 1 smallest ids of each."""
    order = np.argsort(ids, kind="stable")
    ids, x, lists = ids[order], np.ascontiguousarray(x[order]) + 0.0, lists[order]  # -0.0 becomes 0.0
    _, first, which = np.unique(x.view(np.void(x.itemsize * x.shape[1]).dtype).ravel() if len(x) else np.empty(0), return_index=True, return_inverse=True)
    by_vector = np.argsort(which, kind="stable")
    begin = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(first)))]).astype(int)
    x, lists, n = x[first], lists[first], len(first)
    near = lists.shape[1]
    # The inverted files: vectors by pivot, ascending, with the pivot's weight on their lists.
    flat = lists.ravel()
    by_pivot = np.argsort(flat, kind="stable")
    files = np.searchsorted(flat[by_pivot], np.arange(n_pivots + 1))
    posted, weights = by_pivot // max(near, 1), near - by_pivot % max(near, 1)
    take = min(n, max(least, 2 * k, math.ceil(share * n)))
    out = []
    for query, vector, its in zip(query_ids, q, query_lists, strict=True):
        read = [slice(files[p], files[p + 1]) for p in its]
        shared = np.bincount(np.concatenate([posted[r] for r in read]), minlength=n, weights=np.concatenate(
            [np.minimum(weights[r], near - place) for place, r in enumerate(read)]))
        if take < n:
            bar = np.partition(shared, n - take)[n - take]
            above = np.flatnonzero(shared > bar)
            chosen = np.concatenate([above, np.flatnonzero(shared == bar)[:take - len(above)]])
        else:
            chosen = np.arange(n)
        score = (x[chosen] * vector).sum(axis=1)
        if len(chosen) > k + 1:  # one may be the query's own vector
            some = np.flatnonzero(score >= np.partition(score, len(score) - k - 1)[len(score) - k - 1])
            chosen, score = chosen[some], score[some]
        copies = [by_vector[begin[c]:begin[c + 1]][:k + 1] for c in chosen]
        score = np.repeat(score, [len(c) for c in copies])
        held = ids[np.concatenate(copies)] if copies else ids[:0]
        score, held = score[held != query], held[held != query]
        best = np.lexsort((held, -score))[:k]
        out.append((np.full(len(best), query), held[best], score[best]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def search(df: DataFrame, is_query, vec: str = "vec_id", embedding: str = "embedding", k: int = 20, n_pivots: int | None = None,
           near: int = NEAR, share: float | None = None, least: int = LEAST, block_rows: int = BLOCK_ROWS,
           query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose id
    satisfies ``is_query`` (a function of the id column). ``n_pivots`` and the
    ``share`` of a block that is reranked follow from the number of rows unless given."""
    spark = df.sparkSession
    kept, width = usable(df, vec, embedding)
    rows = cut(kept)
    n, n_query, square = rows.agg(F.count(F.lit(1)), F.count_if(is_query(F.col("id"))),
                                  F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))).first()
    schema = "query_id bigint, vec_id bigint, score double"
    if not n_query:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    norm = math.sqrt(square)
    share = min(1.0, CANDIDATES * n ** (GROWTH - 1)) if share is None else share
    plain = pivots(rows, n_pivots or min(MOST_PIVOTS, max(LEAST_PIVOTS, n // 8)))
    centres, n_centres = lengthen(plain, norm), len(plain)
    near = min(near, n_centres)

    def start():
        def work(piece):
            x = matrix(piece.column(1))
            own, asked = nearest_pivots(lengthen(x, norm), centres, near), nearest_pivots(x, centres[:, :-1], near)
            return [pa.array([r.tobytes() for r in m], pa.binary()) for m in (own, asked)]

        return work

    index = map_rows(rows, [T.StructField("list", T.BinaryType()), T.StructField("asked", T.BinaryType())], start, rows=4096)
    n_blocks = max(math.ceil(n / block_rows), min(parallelism(spark), math.ceil(n / 2048)))
    n_query_blocks = math.ceil(n_query / query_rows)
    held = index.select("id", "v", "list", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("block"),
                        F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1))).alias("part"))
    asked = (index.filter(is_query(F.col("id")))
             .select("id", "v", "asked", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"),
                     F.pmod(F.xxhash64("id"), F.lit(n_query_blocks)).cast("int").alias("part")))

    def tile(key, left, right):
        lists = [np.frombuffer(b"".join(t[c].to_pylist()), np.uint16).reshape(-1, near) for t, c in ((left, "list"), (right, "asked"))]
        if not left.num_rows or not right.num_rows:
            found = search_block(np.empty(0), np.empty((0, width)), np.empty((0, near), np.uint16), [], [], [], n_centres, k, share, least)
        else:
            found = search_block(left["id"].to_numpy(), matrix(left["v"]), lists[0], right["id"].to_numpy(), matrix(right["v"]),
                                 lists[1], n_centres, k, share, least)
        return pa.table([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())],
                        names=["query_id", "vec_id", "score"])

    best = held.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(tile, schema)
    return (best.select("query_id", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)").alias("rank"),
                        "vec_id", "score").filter(F.col("rank") <= k))
