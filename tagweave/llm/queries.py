"""The registered queries of this subpackage: each applies one operator with
production parameters to its whole table and derives digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm import (bpe, byte_cnn, chat_format, filter_audit, grouped_prefix_join, lang_id, ngram_lm, order_minhash,
                          permutation_index, secret_scan, simhash_dedup, soft_mixing, walsh_codes)
from tagweave.llm.common import id_bucket, table

RANKS = "byte_bpe_multi_50k.tiktoken"
# Share of the tokens that each domain (quality and toxicity label) gets in the mixture.
MIX_TARGETS = {"q1t0": 0.82, "q0t0": 0.09, "q1t1": 0.07, "q0t1": 0.02}
SELF_QUOTING = r"\### Assistant: </turn> ok"


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.compare_edited(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(id_bucket("doc_id", 5) != 0).select("doc_id", F.col("quality").alias("label"))
    scored = byte_cnn.score(docs, byte_cnn.fit(docs, labels), keep=["doc_id"])
    return scored.select("doc_id", (id_bucket("doc_id", 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= byte_cnn.THRESHOLD).cast("int").alias("predicted"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    coded = bpe.encode_decode(docs.select("doc_id", "text"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, keep=["doc_id"])
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("fingerprint", simhash_dedup.hex_digits(F.col("fingerprint")))


def labelled_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and domain of the labelled documents: quality and toxicity label."""
    return table(spark, sf_dir, "labels").select(
        "doc_id", F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string")).alias("domain"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = soft_mixing.fit(docs, labelled_domains(spark, sf_dir))
    rated = soft_mixing.rates(docs, model, MIX_TARGETS)
    return rated.select("doc_id", "n_tokens", "domain", F.array_max("posterior").alias("domain_posterior"), "rate",
                        soft_mixing.copies(F.col("rate"), "doc_id").alias("copies"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_lm.score(docs, id_bucket("doc_id", 5) != 1)


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    quoting = spark.createDataFrame([(-7, 0, "user", SELF_QUOTING), (-7, 1, "assistant", SELF_QUOTING)], turns.schema)
    return chat_format.read_back(chat_format.format_turns(turns.union(quoting)))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learned = id_bucket("doc_id", 3) != 1
    named = lang_id.annotate(docs.select("doc_id", "text"), lang_id.fit(docs.filter(learned)))
    return named.select("doc_id", (~learned).alias("held_out"), "lang_pred", "score", "rejected")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), lambda vec_id: vec_id % 20 == 0)


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.array_join("base", ","), 256).alias("base_sha256"),
                        F.array_join("spans", ",").alias("spans"), "n_owner_specific", "n_widely_copied")


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped_prefix_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walsh_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (
    op1_document_fingerprints, op2_quality_classifier, op3_byte_bpe, op4_simhash_near_dedup, op5_mix_sources, op6_lm_scoring,
    op7_chat_formatting, op8_language_id, op9_nearest_neighbours, op10_secret_scans, op11_ngram_jaccard_join,
    op12_vector_codes, op13_filter_audit)}

_CHAT_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL
    SELECT CAST(-7 AS BIGINT), CAST(t AS BIGINT), r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)
), sized AS (
    SELECT *, length(CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant'
                     WHEN 'tool' THEN 'Tool' ELSE 'role.' || url_encode(role) END)
        + length('### : ') + length(text) + len(regexp_extract_all(text, '### [A-Za-z0-9%_.~-]*: |</turn>'))
        + length('</turn>') + 2 AS formatted
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(formatted) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""



def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Plain product quantisation, one pair of tables for each round."""
    sql = [f"""
WITH cells AS MATERIALIZED (
    SELECT vec_id, label, CAST((i - 1) // w AS INTEGER) AS part, CAST((i - 1) % w AS INTEGER) AS j,
        CAST(floor(CAST(embedding[i] AS DOUBLE) * 4096) AS BIGINT) AS x
    FROM (SELECT *, len(embedding) // {parts} AS w, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0)
), firsts AS (
    SELECT vec_id, CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS entry
    FROM (SELECT DISTINCT vec_id FROM cells) ORDER BY vec_id LIMIT {entries}
), book0 AS MATERIALIZED (SELECT part, entry, j, x AS c FROM cells JOIN firsts USING (vec_id))"""]
    for r in range(rounds + 1):
        sql.append(f"""near{r} AS MATERIALIZED (
    SELECT vec_id, label, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
        SELECT vec_id, label, part, entry, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d
        FROM cells JOIN book{r} USING (part, j) GROUP BY ALL) GROUP BY ALL
)""")
        if r < rounds:
            sql.append(f"""book{r + 1} AS MATERIALIZED (
    SELECT part, entry, j, coalesce(m, c) AS c FROM book{r} LEFT JOIN (
        SELECT part, entry, j, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m
        FROM (SELECT part, entry, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM cells JOIN near{r} USING (vec_id, part) GROUP BY ALL)
    ) USING (part, entry, j)
)""")
    sql.append(f"""coded AS (
    SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
    FROM near{rounds} GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, j)) FROM book{rounds}) AS codebooks_sha256
FROM coded""")
    return ", ".join(sql)


_AUDIT_SQL = r"""
WITH words AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), flags AS MATERIALIZED (
    SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
        100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
        coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), FALSE) AS e,
        coalesce(l.good, FALSE) AS good, coalesce(l.toxic, FALSE) AS toxic
    FROM words LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1) l USING (doc_id)
), masks AS MATERIALIZED (
    SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, good, toxic, count(*) AS n FROM flags GROUP BY ALL
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), orders AS (
    SELECT v.f || w.f || x.f || y.f || z.f AS o FROM letters v, letters w, letters x, letters y, letters z
    WHERE len(list_distinct([v.f, w.f, x.f, y.f, z.f])) = 5
), steps AS (
    SELECT o AS filter_order, k AS step, substr(o, k, 1) AS f, 1 << (ascii(substr(o, k, 1)) - 65) AS own,
        list_sum(list_transform(range(1, k), lambda i: 1 << (ascii(substr(o, i, 1)) - 65))) AS earlier
    FROM orders, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS k)
), effects AS (
    SELECT part, filter_order, step, f, own,
        coalesce(sum(n) FILTER (mask & (own | coalesce(earlier, 0)::INT) = 0), 0) AS kept,
        coalesce(sum(n) FILTER (mask & own <> 0 AND mask & coalesce(earlier, 0)::INT = 0), 0) AS removed,
        coalesce(sum(n) FILTER (mask & own <> 0 AND mask & coalesce(earlier, 0)::INT <> 0), 0) AS redundant,
        coalesce(sum(n) FILTER (mask = own), 0) AS unique_fails,
        coalesce(sum(n) FILTER (good AND mask & own <> 0 AND mask & coalesce(earlier, 0)::INT = 0), 0) AS good_lost,
        coalesce(sum(n) FILTER (toxic AND mask & own <> 0 AND mask & coalesce(earlier, 0)::INT = 0), 0) AS toxic_lost
    FROM masks, steps GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
    CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM effects
"""

_JACCARD_SQL = r"""
WITH RECURSIVE worded AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS MATERIALIZED (
    SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM worded
), grams AS MATERIALIZED (
    SELECT doc_id, len(s) AS n, unnest(s) AS gram FROM sets
), links AS MATERIALIZED (
    SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b USING (gram) WHERE a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
    SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT y, root FROM reach JOIN links ON x = node
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id
FROM sets JOIN (SELECT node AS doc_id, min(root) AS component_id FROM reach GROUP BY 1) USING (doc_id)
"""

ORACLE_SQL = {"op7_chat_formatting": _CHAT_SQL, "op11_ngram_jaccard_join": _JACCARD_SQL, "op12_vector_codes": _codes_sql(), "op13_filter_audit": _AUDIT_SQL}
