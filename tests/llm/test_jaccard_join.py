"""The grouped prefix join against all pairs, and edge rows."""

import re
from itertools import combinations

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tagweave.llm import grouped_prefix_join as join, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def plain(rows, words=5, percent=80):
    """(doc_id, n, component) of every row, from all pairs of rows."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            label[top(a)] = top(b)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        ids.setdefault(top(i), []).append(doc_id)
    least = {t: min((i for i in found if i is not None), default=None) for t, found in ids.items()}
    return ordered((doc_id, len(s), least[top(i)] if s else doc_id) for i, ((doc_id, _), s) in enumerate(zip(rows, sets)))


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(x is None, x or 0) for x in r])


def test_op11_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = ordered(queries.op11_ngram_jaccard_join(spark, SF).collect())
    assert got == ordered(con.execute(queries.ORACLE_SQL["op11_ngram_jaccard_join"]).fetchall())
    assert got == plain(con.execute("SELECT doc_id, text FROM documents").fetchall())


def test_clusters_chains_and_shared_passages(spark):
    """Near copies around centres, chains whose ends do not link, a passage that most texts hold, and copies."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    text = lambda n: [word() for _ in range(n)]
    passage, docs = text(40), []
    for _ in range(6):
        centre = text(int(rng.integers(30, 120)))
        for _ in range(25):
            own = list(centre)
            for _ in range(int(rng.integers(0, 4))):
                own[int(rng.integers(len(own)))] = word()
            docs.append(own)
    for _ in range(60):
        docs.append(text(int(rng.integers(5, 200))) + passage + text(int(rng.integers(0, 30))))
    for _ in range(4):
        own = text(100)
        for _ in range(12):
            docs.append(list(own))
            own[int(rng.integers(100))] = word()
    docs += [text(int(rng.integers(1, 7))) for _ in range(20)] + [list(docs[3])] * 9 + [list(docs[-1])] * 3
    order = rng.permutation(len(docs)).tolist()
    rows = [(1000 - i, ("\n" if i % 3 else "  ").join(docs[j])) for i, j in enumerate(order)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for words, percent in ((5, 80), (2, 60), (1, 90)):
        got = join.near_duplicates(df, words=words, percent=percent, block_least=1 << 12, range_rows=1 << 9)
        assert ordered(got.collect()) == plain(rows, words, percent)


def test_odd_rows(spark):
    long = "lorem ipsum dolor sit amet " * 20000 + "end of it all"
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One Two"), (5, "one  two"), (5, "one  two"), (None, "ONE TWO"), (None, "alone here"),
            (None, None), (6, long), (7, long + " again"), (8, "a a a a a a a a"), (9, "a a a a a"), (10, "a a a a"), (11, "É\U0001f600 b"), (12, "é\U0001f600 b")]
    df = spark.createDataFrame(rows, SCHEMA)
    wide = df.withColumns({c: F.lit("clash") for c in ("n_shingles", "component_id", "set_id", "grp", "tokens", "block", "range", "root")})
    assert ordered(join.near_duplicates(wide).collect()) == plain(rows)
    assert join.near_duplicates(df.limit(0)).collect() == []


def test_prefix_and_overlap_bounds():
    for n in range(1, 60):
        least = min(o for o in range(n + 1) for m in range(1, 80) if o <= m and 100 * o >= 80 * (n + m - o))
        assert join.prefix_length(n) == n - least + 1
    assert (np.diff(join.frequency_class(np.arange(1, 10**6)).astype(int)) >= 0).all() and join.frequency_class(np.array([1]))[0] == 0
