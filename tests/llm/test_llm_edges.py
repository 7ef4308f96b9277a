"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing
extra columns for every operator."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.llm import (bpe, byte_cnn, chat_format, lang_id, ngram_lm, order_minhash, permutation_index, queries, secret_scan,
                          simhash_dedup, soft_mixing)
from tagweave.llm.common import id_bucket

RANKS, PATTERN = queries.public_tokenizers.path(queries.RANKS), queries.public_tokenizers.PATTERN
LONG = "lorem ipsum dolor " * 20000
ROWS = [(1, None, "en", "s1"), (2, "", "en", None), (3, "the cat sat on the mat and the dog", "en", "s1"),
        (4, "the cat sat on the mat and the dog", None, "s2"), (4, "the cat sat on the mat and the dog", None, "s2"),
        (None, "le chat est sur la table avec le chien", "fr", "s2"), (6, LONG, "la", "s3"), (7, "12 34 ?!", "en", "s3"),
        (8, "\U0001f600 naïve — café \x00 end", "fr", "s4")]
SCHEMA = "doc_id long, text string, lang string, source string"
EXTRA = {"fingerprint": "x", "score": 1.5, "ids": "y", "candidates": 2, "posterior": "p", "n_tokens": 9, "block": 3, "row": 4, "lang_pred": "q"}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def wide(docs):
    return docs.withColumns({k: F.lit(v) for k, v in EXTRA.items()})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows, name):
    return spark.createDataFrame(rows, f"doc_id long, {name} {'int' if name == 'label' else 'string'}")


def test_order_minhash(spark, wide, empty):
    got = order_minhash.compare_edited(wide).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)
    assert {r.n_chars for r in got if r.doc_id in (1, 2)} == {0}
    assert len({r.fingerprint for r in got if r.doc_id in (3, 4)}) == 1
    assert order_minhash.compare_edited(empty).collect() == []
    one = order_minhash.compare_edited(spark.createDataFrame([ROWS[2]], SCHEMA)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0  # it follows itself


def test_byte_cnn(spark, wide, empty):
    none = byte_cnn.fit(wide, labels(spark, [], "label"))
    assert {r.p for r in byte_cnn.score(wide, none, out="p").collect()} == {0.5}
    some = byte_cnn.fit(wide, labels(spark, [(3, 1), (3, 0), (6, 1), (99, 0), (None, 1), (8, None)], "label"))
    got = byte_cnn.score(wide, some).collect()  # takes the place of the input's score
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got) and byte_cnn.score(wide, some).columns.count("score") == 1
    assert byte_cnn.score(empty, some).count() == 0


def test_bpe(wide, empty):
    got = bpe.decode(bpe.encode(wide, RANKS, PATTERN, ids="own"), RANKS, PATTERN, ids="own").collect()
    assert [bytes(r.decoded) for r in got] == [(r[1] or "").encode() for r in ROWS] and got[0].ids == "y"
    assert bpe.encode(empty, RANKS, PATTERN).count() == 0
    got = bpe.decode(bpe.encode(wide, RANKS, PATTERN), RANKS, PATTERN)  # ids replaced
    assert got.columns.count("ids") == 1 and [bytes(r.decoded) for r in got.collect()] == [(r[1] or "").encode() for r in ROWS]


def test_simhash(spark, wide, empty):
    got = {r.doc_id: r for r in simhash_dedup.near_duplicates(wide).collect()}
    assert got[1].fingerprint == got[2].fingerprint == 0 and got[2].component_id == 1
    assert got[4].component_id == 3 and got[None].component_id is None
    kept = simhash_dedup.keep_one(wide)
    assert kept.columns == wide.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "6", "7", "8", "None"]
    assert simhash_dedup.near_duplicates(empty).count() == 0 and simhash_dedup.keep_one(empty).count() == 0
    mapped = wide.withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    assert simhash_dedup.keep_one(mapped).count() == 6


def test_mixing(spark, wide, empty):
    none = soft_mixing.fit(wide, labels(spark, [], "domain"))
    assert {r.rate for r in soft_mixing.rates(wide, none, {"a": 1.0}).collect()} == {1.0}
    model = soft_mixing.fit(wide, labels(spark, [(3, "a"), (6, "b"), (8, "b"), (8, "a"), (None, "a"), (7, None)], "domain"))
    got = soft_mixing.rates(wide, model, {"a": 0.5, "b": 0.5}).collect()
    assert len(got) == len(ROWS) and all(r.rate >= 0 for r in got)
    mixed = soft_mixing.mix(wide, model, {"a": 0.9, "b": 0.1}, floor=1.0)
    assert mixed.columns == wide.columns
    held = {str(r.doc_id) for r in mixed.collect()}
    assert held == {str(r[0]) for r in ROWS}
    assert soft_mixing.mix(empty, model, {"a": 1.0}).count() == 0 and soft_mixing.rates(empty, model, {"zz": 1.0}).count() == 0


def test_lm(wide, empty):
    got = ngram_lm.score(wide, id_bucket("doc_id", 5) != 1).collect()
    assert len(got) == len(ROWS) and {r.n_tokens for r in got if r.doc_id in (1, 2)} == {1}
    alone = ngram_lm.score(wide, F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and abs(r.score) < 1e-9 for r in alone)  # one unknown word holds all mass
    assert ngram_lm.score(empty, F.lit(True)).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "x"), (2, 0, "own role%\n", "### User: hi </turn>\n"),
            (None, 1, "assistant", LONG), (3, 0, "assistant", "\\</turn>\\"), (3, 1, "role.x", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted_", F.lit(1))
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(turns)).collect()}
    assert got[1].n_turns == 3 and got[2].n_turns == 1 and got[None].loss_chars == len(LONG) and got[3].loss_chars == 9
    assert chat_format.read_back(chat_format.format_turns(turns.limit(0))).count() == 0


def test_language_id(spark, wide, empty):
    model = lang_id.fit(wide)
    got = lang_id.annotate(wide, model, prefix="p_").collect()
    assert {r.p_lang_pred for r in got if r.doc_id in (1, 2, 7)} == {"und"}
    assert all(r.p_rejected for r in got if r.doc_id in (1, 2, 7)) and all(0 <= r.p_score <= 1 for r in got)
    nothing = lang_id.annotate(wide, lang_id.fit(empty), prefix="p_").collect()
    assert {r.p_lang_pred for r in nothing} == {"und"} and not any(r.p_rejected for r in nothing if r.doc_id == 3)
    assert lang_id.annotate(empty, model).count() == 0
    named = lang_id.annotate(wide, model)
    assert named.columns.count("lang_pred") == 1 and named.columns.count("score") == 1
    assert {r.lang_pred for r in named.select("doc_id", "lang_pred").collect() if r.doc_id in (1, 2, 7)} == {"und"}


def test_nearest(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0]), (None, [1.0, 1.0]),
            (6, [0.5, 0.5]), (7, [0.5, 0.5]), (20, [0.0, 2.0]), (9, [None, 1.0]), (8, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("list", F.lit("clash"))
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in permutation_index.search(table, lambda c: c % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 6, 0.5), (0, 2, 7, 0.5), (0, 3, 20, 0.0), (20, 1, 6, 1.0), (20, 2, 7, 1.0), (20, 3, 0, 0.0)]
    assert permutation_index.search(table.limit(0), lambda c: c % 20 == 0).count() == 0


def test_secrets(wide, empty):
    got = secret_scan.scan(wide).collect()
    assert len(got) == len(ROWS) and all(r.spans == [] for r in got)
    assert secret_scan.scan(empty).count() == 0 and secret_scan.redact(empty).count() == 0
    assert secret_scan.redact(wide).columns == wide.columns
    found = secret_scan.find_candidates(wide)
    assert found.columns.count("candidates") == 1 and all(r.candidates == [] for r in found.collect())


def test_other_results_replace_columns_of_their_names(wide):
    prints = order_minhash.fingerprints(wide)
    assert prints.columns.count("fingerprint") == 1 and len(prints.first().fingerprint) == 8 * order_minhash.COMPONENTS
    assert simhash_dedup.fingerprints(wide).select("fingerprint").first().fingerprint == 0
    model = soft_mixing.fit(wide, labels(wide.sparkSession, [(3, "a"), (6, "b"), (8, "b")], "domain"))
    told = soft_mixing.predict(wide, model)
    assert told.columns.count("posterior") == 1 and told.columns.count("n_tokens") == 1 and len(told.first().posterior) == 2


def test_long_runs_split_as_one_text(spark):
    encoding = bpe.make_encoding(bpe.read_ranks(RANKS), PATTERN)
    rng = np.random.default_rng(5)
    alphabet = list("ab1 \n\t'.") + [" " * 300, "\u00a0", "\u3000", "'s", "é", "日本", "\x1c", "\u200b"]
    for _ in range(200):
        text = "".join(rng.choice(alphabet, size=int(rng.integers(0, 60))))
        assert bpe.encode_text(encoding, text, chunk=7).tolist() == encoding.encode_ordinary(text)
    for text in (" " * 1_000_000 + "b", "\n" * 300_000, "a" * 200_000):
        assert bpe.decode_ids(encoding, bpe.encode_text(encoding, text)).decode() == text
