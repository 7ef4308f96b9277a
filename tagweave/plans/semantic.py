"""Semantic evaluation plan: tag names -> embeddings of the distinct tags ->
in-record similarity grids -> per-record, best-match and per-file metrics.

The stand-in embedding model is a lookup into the ``embeddings`` table (tag
'v<vec_id>' -> its vector); a real encoder plugs in through
``tagweave.operators.modelcall.embed_tags`` with the same (tag, vec) output.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave.operators import modelcall, score
from tagweave.session import checkpoint_dir, scratch_folder
from tagweave.sources import derived

# The vectors of the embeddings table are nearly orthogonal (no two above 0.52),
# so their queries take a threshold that some pairs pass; a job's default is 0.8.
THRESHOLD = 0.8
VECTOR_THRESHOLD = 0.25


def r6(c):
    return F.round(F.col(c), 6).alias(c)


def table_embedder(spark, sf_dir):
    """tags DataFrame[tag] -> DataFrame[tag, vec] by joining the embeddings table."""
    e = derived.table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("tag"), F.col("embedding").alias("vec"))
    return lambda tags: tags.join(e, "tag", "inner")


def scored_vectors(spark, sf_dir, threshold: float = VECTOR_THRESHOLD, embedder=None):
    # Read three times by the embedding join (distinct tags, explode, join
    # back): the narrow record table is written once to the checkpoint folder.
    checkpoint_dir(spark)
    recs = derived.vector_records(spark, sf_dir).checkpoint(eager=True)
    v = score.attach_grid(recs, embedder or table_embedder(spark, sf_dir), "rec_id", "gold", "pred", keep=["file_name"])
    v = score.with_exact(v, "pred", "gold", normalise=True)
    return score.with_semantic_grid(v, "gold", "pred", threshold)


def semantic_by_record(spark, sf_dir):
    s = scored_vectors(spark, sf_dir)
    return s.select("rec_id", "file_name", F.size("gold").alias("n_gold"), F.size("pred").alias("n_pred"),
                    r6("exact_match_f1"), r6("semantic_accuracy"), r6("semantic_f1"),
                    r6("semantic_precision"), r6("semantic_recall"), r6("sft_semantic_f1"))


def semantic_best_match(spark, sf_dir):
    s = scored_vectors(spark, sf_dir)
    b = score.best_match_rows(s, "rec_id", "gold", "pred")
    return b.select("rec_id", "gold_pos", "gold_tag", "pred_tag", r6("similarity"))


def semantic_file_metrics(spark, sf_dir):
    m = score.file_metrics(scored_vectors(spark, sf_dir), gold_names="gold", semantic=True)
    return m.select("file_name", "total_samples", "valid_samples",
                    *[r6(c) for c in score.EXACT + score.SEMANTIC], "failed_cases_count")


def letter_embedder(tags):
    """tags DataFrame[tag] -> DataFrame[tag, vec] with the bag-of-letters encoder."""
    from tagweave.functions.metrics import letter_bag

    return tags.select("tag", letter_bag(F.col("tag")).alias("vec"))


def semantic_doc_file_metrics(spark, sf_dir):
    """Full per-file metrics (exact + semantic) of the tags extracted from the
    model outputs of the document records against their gold tags."""
    from tagweave.plans.evaluation import scored_records

    r = scored_records(spark, sf_dir).withColumn("rid", F.col("doc_id"))
    # The narrow scored table is read three times (distinct tags, explode,
    # join back): written once to the checkpoint folder, parsed once.
    checkpoint_dir(spark)
    narrow = r.select("rid", "file_name", "pred_names", "gold_names", *score.EXACT).checkpoint(eager=True)
    v = score.attach_grid(narrow, letter_embedder, "rid", "gold_names", "pred_names", keep=["file_name", *score.EXACT])
    s = score.with_semantic_grid(v, "gold_names", "pred_names", THRESHOLD)
    m = score.file_metrics(s, gold_names="gold_names", semantic=True)
    return m.select("file_name", "total_samples", "valid_samples",
                    *[r6(c) for c in score.EXACT + score.SEMANTIC], "failed_cases_count")


def semantic_missing_vectors(spark, sf_dir):
    """Scores when the encoder fails for every third name and for all names of
    every fifth record: such names count and match nothing, records without any
    vector fall back to the exact F1 (O-A12)."""
    known = table_embedder(spark, sf_dir)
    number = F.substring("tag", 2, 20).cast("bigint")
    some = (number % 3 != 0) & (F.floor(number / 8) % 5 != 0)
    s = scored_vectors(spark, sf_dir, embedder=lambda tags: known(tags.where(some)))
    return s.select("rec_id", "encoded", r6("semantic_accuracy"), r6("semantic_f1"), r6("sft_semantic_f1"))


def embedding_cache_reuse(spark, sf_dir):
    """O-J3: two runs over one cache of vectors, the first over half of the documents. The encoders of the two runs
    mark their vectors, so the result shows that no tag is encoded twice."""
    d = derived.table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("-", "source", "lang", (F.col("n_chars") % 50).cast("string")).alias("tag"))
    path = scratch_folder(spark, "vector-cache")
    for n, rows in enumerate((d.where("doc_id % 2 = 0"), d), 1):
        encoder = lambda mark=n: lambda names: [[len(x), mark] for x in names]
        found = modelcall.cached_vectors(lambda tags: modelcall.embed_tags(tags, encoder), path, "marking")(rows.select("tag"))  # noqa: B023
    return found.select("tag", F.round(F.col("vec")[0], 6).alias("v0"), F.round(F.col("vec")[1], 6).alias("v1"))


def vowel_encoder():
    """Stand-in sentence encoder: how often each vowel stands in a name."""
    return lambda names: [[n.count(v) for v in "aeiou"] for n in names]


def encoded_tags(spark, sf_dir):
    """O-M6: every distinct generated tag encoded once by a model call, as a unit vector."""
    tags = derived.tag_records(spark, sf_dir).select(F.explode("gen_raw.tag").alias("tag")).distinct()
    e = modelcall.embed_tags(tags, lambda: vowel_encoder())
    return e.select("tag", *[F.round(F.col("vec")[i], 6).alias(f"v{i}") for i in range(5)])
