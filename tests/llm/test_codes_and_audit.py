"""Vector codes and the filter audit: oracle SQL, brute force, edge rows."""

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.llm import filter_audit, queries, walsh_codes

SF = "/root/testdata/sf0.001"


def plain_compress(rows, n_parts=8, k=16, rounds=6):
    """(vec_id, vector, label) rows of one length, in Python integers."""
    kept = [(i, [int(np.floor(np.float64(x) * 4096)) if abs(x) < 1e300 else int(x) * 4096 for x in v], l) for i, v, l in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    w = len(kept[0][1]) // n_parts
    part = lambda v, p: v[p * w:(p + 1) * w]
    first = {}
    for i, v, _ in sorted(kept, key=lambda r: (r[0] is None, r[0], r[1])):
        if i is not None:
            first.setdefault(i, v)
    books = [[part(first[i], p) for i in sorted(first)[:k]] for p in range(n_parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(part(v, p), c)), e) for e, c in enumerate(books[p])) for p in range(n_parts)] for _, v, _ in kept]

    for _ in range(rounds):
        near = assign()
        for p in range(n_parts):
            for e in range(len(books[p])):
                own = [part(v, p) for (_, v, _), n in zip(kept, near) if n[p][1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    near, errors = assign(), Counter()
    for (_, _, label), n in zip(kept, near):
        errors[label] += sum(d for d, _ in n)
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted((i is None, i, "".join(f"{e:02x}" for _, e in n), sum(d for d, _ in n), errors[l], sha) for (i, _, l), n in zip(kept, near))


def compressed(df, **sizes):
    return sorted((r.vec_id is None, r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in walsh_codes.compress(df, **sizes).collect())


def test_op12_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = sorted(con.execute(queries.ORACLE_SQL["op12_vector_codes"]).fetchall())
    assert sorted(tuple(r) for r in queries.op12_vector_codes(spark, SF).collect()) == want
    rows = con.execute("SELECT vec_id, embedding, label FROM embeddings").fetchall()[:80]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert compressed(df, n_parts=4, n_entries=5, rounds=3) == plain_compress(rows, 4, 5, 3)


def test_codes_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [1.0, -2.5], 1), (5, [0.25, 7.0], None), (3, [0.5, 0.5], None), (None, [9.0, -9.0], 2), (1, None, 1), (2, [nan, 0.0], 1),
            (4, [0.0, inf], 1), (6, [None, 1.0], 1), (8, [0.5, 0.5], 2), (9, [-0.00001, 0.0], 2), (9, [-0.00001, 0.0], 2)]
    schema = "vec_id long, embedding array<double>, label int"
    df = spark.createDataFrame(rows, schema)
    wide = df.withColumns({c: F.lit("clash") for c in ("code", "error", "label_error", "part", "of")})
    assert compressed(wide, n_parts=2, n_entries=3) == plain_compress(rows, 2, 3)
    assert compressed(spark.createDataFrame([], schema)) == [] == compressed(spark.createDataFrame([(1, None, 1)], schema))
    assert compressed(spark.createDataFrame([(None, [1.0], 1)], schema))[0][2:5] == ("", None, None)
    ragged = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1), (2, [], 1), (3, [1.0], None)], schema)
    padded = [(1, [1.0, 2.0, 3.0, 0.0], 1), (2, [0.0] * 4, 1), (3, [1.0, 0.0, 0.0, 0.0], None)]
    assert compressed(ragged, n_parts=2, n_entries=2) == plain_compress(padded, 2, 2)


def test_codes_of_huge_numbers_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(8) * 10.0 ** rng.integers(-3, 40, 8)).tolist(), i % 2) for i in range(40)] + [(99, [1.7e308] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = plain_compress(rows, 2, 4, 2)
    fits = lambda e: e if e is not None and e < 2**63 else None
    got = compressed(df, n_parts=2, n_entries=4, rounds=2)
    assert [(r[1], r[2], r[5]) for r in got] == [(r[1], r[2], r[5]) for r in want] and [r[3] for r in got] == [fits(r[3]) for r in want]
    assert {r[4] for r in got} == {None}


def test_transform_keeps_distances():
    rng = np.random.default_rng(1)
    for width in (1, 3, 8, 12):
        a, b = rng.integers(-99, 99, (2, 50, width))
        size = walsh_codes.transform(a).shape[1]
        assert size >= width and size < 2 * width + (width == 1)
        assert (((walsh_codes.transform(a) - walsh_codes.transform(b)) ** 2).sum(1) == size * ((a - b) ** 2).sum(1)).all()
    signs = walsh_codes.transform(np.eye(8, dtype=np.int64)).T
    assert [(r[1:] != r[:-1]).sum() for r in signs] == list(range(8))
    entry, total = walsh_codes.nearest(np.zeros((3, 2), np.int64), np.array([[1, 0], [0, -1], [0, 1], [0, 1]]))
    assert entry.tolist() == [0] * 3 and total.tolist() == [1] * 3  # ties: the first


def plain_audit(docs, labels):
    """The five filters applied one after another to lists of rows."""
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    words = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    rows = []
    for i, t, lang in docs:
        t = t or ""
        w = words(t)
        failed = "".join(f for f, x in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in "#$%&*|" for c in t),
            i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs))) if x)
        rows.append((lang or "", i, failed))
    out, total = [], Counter()
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[2]]
                left = [r for r in left if f not in r[2]]
                every = [r for r in rows if r[0] == part and f in r[2]]
                total[part, f] += len(gone)
                out.append((part, "".join(order), k + 1, len(left), len(gone), len(every) - len(gone), sum(r[2] == f for r in every),
                            sum(r[1] in good for r in gone), sum(r[1] in toxic for r in gone), f))
    return sorted((*r[:9], total[r[0], r[9]]) for r in out)


def test_op13_oracle_and_brute_force(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = sorted(tuple(r) for r in queries.op13_filter_audit(spark, SF).collect())
    assert got == sorted(con.execute(queries.ORACLE_SQL["op13_filter_audit"]).fetchall())
    assert got == plain_audit(con.execute("SELECT doc_id, text, lang FROM documents").fetchall(), con.execute("SELECT * FROM labels").fetchall())


def test_audit_of_odd_rows(spark):
    long = "word " * 30000 + "end"
    rows = [(1, None, "en"), (2, "", None), (3, long, "en"), (4, long, "de"), (4, long, "de"), (None, long, "en"), (None, None, None),
            (5, long + "x", "en"), (-7, long, None), (8, "A b c \U0001f600 #", ""), (9, "A b c \U0001f600 #", "en"), (9, "other", "en")]
    labels = [(3, 1, 0), (4, 0, 1), (4, 1, 0), (None, 1, 1), (9, None, 1), (77, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    wide = df.withColumns({c: F.lit("clash") for c in ("part", "mask", "range", "n", "good", "toxic", "quality")})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("mask", F.lit(1))
    want = plain_audit(rows, [r for r in labels if r[0] is not None])
    assert sorted(tuple(r) for r in filter_audit.audit(wide, marks).collect()) == want
    assert filter_audit.audit(df.limit(0), marks).count() == 0
    assert {r.good_lost for r in filter_audit.audit(df, marks.limit(0)).collect()} == {0}
    # tries that are handed on all the time give the same flags
    small = filter_audit.counts(filter_audit.masks(df, trie_bytes=1, range_bytes=1 << 10), marks)
    assert sorted(tuple(r) for r in filter_audit.report(small).collect()) == want


def test_trie_holds_smallest_ids():
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("ab"), rng.integers(0, 7))).encode() + b"\x00\xff" * int(rng.integers(0, 3)) for _ in range(400)]
    trie, copies = filter_audit.Trie(), []
    ids = rng.integers(0, 300, 400).tolist()
    for n, (i, t) in enumerate(zip(ids, texts)):
        copies += trie.insert(t, i, (n,))
    held = list(trie.traverse())
    assert [t for t, _, _ in held] == sorted(t for t, _, _ in held)
    least = {t: min(i for i, u in zip(ids, texts) if u == t) for t in texts}
    assert sorted(n for _, (n,) in copies) == [n for n, (i, t) in enumerate(zip(ids, texts)) if i > least[t]]
    assert sorted((t, i) for t, i, _ in held) == sorted((t, i) for i, t in zip(ids, texts) if i == least[t])


@pytest.mark.parametrize("prefix", ["", "x" * 5000])
def test_boundaries_adapt_to_shared_prefixes(spark, prefix):
    texts = [(prefix + f"{i:05d}" + "tail" * (i % 5)).encode() for i in range(600)]
    df = spark.createDataFrame([(t,) for t in texts] * 2, "text binary")
    edges = filter_audit.boundaries(df, 6, 1200)
    assert edges == sorted(set(edges)) and len(edges) == 5
    sizes = Counter(bisect_right(edges, t) for t in texts)
    assert max(sizes.values()) < 2.5 * len(texts) / 6
