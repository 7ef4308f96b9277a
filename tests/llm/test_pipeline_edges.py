"""Every pipeline stage on nulls in any column, empty and very long texts,
ties, repeated rows, empty tables and clashing extra columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

LONG = "lorem ipsum dolor sit amet " * 20000
SECRET = "my password: hunter2hunter2 stays here"
ROWS = [(1, None, "en", "s1", None), (2, "", "en", None, 0), (3, "the cat sat on the mat and the dog", "en", "s1", 34),
        (4, "the cat sat on the mat and the dog", None, "s2", 34), (4, "the cat sat on the mat and the dog", None, "s2", 34),
        (None, "le chat est sur la table avec le chien", "fr", "s2", 38), (6, LONG, "la", "s3", len(LONG)), (7, "12 34 ?!", "en", "s3", None),
        (8, SECRET, "en", "s4", len(SECRET)), (None, None, None, None, None)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ("__lang_rejected", "__lang_score", "__row", "__kept", "__text_hash", "__spans", "__doc", "__h", "__tokens", "__posterior",
         "__rate", "fingerprint", "component_id", "spans", "candidates", "owner", "key", "ids", "decoded", "rejected", "value", "fp", "root")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Two folders of tables: one of edge rows, one of empty tables."""
    docs = spark.createDataFrame(ROWS, SCHEMA)
    labels = spark.createDataFrame([(3, 1, 0), (6, 0, 0), (8, 1, 1), (99, 0, 1), (None, 1, 0), (7, None, None), (3, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    folders = {}
    for name, take in (("rows", lambda d: d), ("empty", lambda d: d.limit(0))):
        folders[name] = str(tmp_path_factory.mktemp(name))
        take(docs).write.parquet(f"{folders[name]}/documents.parquet")
        take(labels).write.parquet(f"{folders[name]}/labels.parquet")
    return folders


def wide(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(c) for c in EXTRA})


EXPECTED = {
    "language_id": ["3", "4", "4", "6", "8", "None"],  # those without a letter are rejected
    "simhash_near_dedup": ["1", "3", "6", "7", "8", "None"],  # null and empty texts are one group
    "secret_scans": sorted(str(r[0]) for r in ROWS),
    "byte_bpe": sorted(str(r[0]) for r in ROWS),
}


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage(spark, sf_dir, name, stage):
    docs = wide(spark)
    done = stage(spark, docs, sf_dir["rows"])
    last = name == corpus_pipeline.STAGES[-1][0]
    assert last or done.columns == docs.columns
    rows = done.collect()
    ids = sorted(str(r.doc_id) for r in rows)
    if name == "mix_sources":  # every document stays at least once
        assert set(ids) == {str(r[0]) for r in ROWS} and len(ids) >= len(ROWS)
    else:
        assert ids == EXPECTED[name]
    if name == "secret_scans":
        held = {r.doc_id: r for r in rows if r.doc_id is not None}
        assert held[8].text == "my [assign] stays here" and held[8].n_chars == len(held[8].text)
        assert held[6].text == LONG and held[1].text is None and held[2].text == "" and held[8].spans == "spans"
    assert stage(spark, docs.limit(0), sf_dir["empty"]).collect() == []


def test_run(spark, sf_dir):
    done = corpus_pipeline.run(spark, sf_dir["rows"]).collect()
    assert {r.doc_id for r in done} == {3, 6, 8, None} and all(r.n_tokens > 0 for r in done)
    assert corpus_pipeline.run(spark, sf_dir["empty"]).collect() == []
