"""Record inputs derived from the driver tables.

The reference reads tagging records (prompt + ordered tag list), model
outputs, judge replies and tag embeddings. The test tables are generic
(documents, conversations, embeddings), so these functions derive those
shapes from them with column expressions only: every row of the source
table becomes a record, no row is dropped, and the work grows with the
table. The oracle SQL derives the same values independently.

Derivation rules (fixed; the oracle SQL states the same rules):
  generated tags of document d (c = n_chars, L = number of lines of text):
    pos0 domain    'Rare<doc_id>' if doc_id % 97 = 0, else by doc_id % 4:
                   'Health_Care', 'LegalTech', 'code - review', 'Finance / Banking'
    pos1 task      'Question' if c % 3 = 0 else 'Summary'
    pos2 level     'Easy' if c < 853, 'Medium' if c < 2676, else 'Hard'
    pos3 language  lang          (absent when doc_id % 13 = 0)
    pos4 topic     'lines<L>'    (absent when doc_id % 13 = 0)
    the whole list is empty when doc_id % 11 = 0
  gold tags:
    pos0 'General' if doc_id % 5 = 0, else by doc_id % 4:
         'Health Care', 'Legal Tech', 'code-review', 'Finance/Banking'
    pos1 'QUESTION'; pos2 'Easy' if c < 1475 else 'Hard'
    pos3 ' ' || upper(lang) || ' '; pos4 'lines<L>' (absent when doc_id % 3 = 0)
    the whole list is empty when doc_id % 17 = 0
  model output text of the generated list, by doc_id % 5:
    0 JSON list, 1 fenced ```json list, 2 list inside a sentence,
    3 bare objects joined by ',\\n', 4 'Tag: ' / 'Explanation: ' lines;
    doc_id % 23 = 0 gives a sentence without any tag.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.schemas import TAG_LIST_DDL

# Fixed explanation texts by position.
EXPLANATIONS = ["the domain", "the task type", "the difficulty", "the language", "the topic"]
NO_TAG_SENTENCE = "No labels could be produced for this text."
SENTENCE_BEFORE = "Here are the labels: "
SENTENCE_AFTER = " Hope this helps."
FENCE_OPEN = "```json\n"
FENCE_CLOSE = "\n```"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tag(tag, pos: int):
    return F.struct(tag.alias("tag"), F.lit(EXPLANATIONS[pos]).alias("explanation"))


def _keep_tags(*items):
    return F.filter(F.array(*items), lambda x: x["tag"].isNotNull())


def line_count(text="text"):
    """Lines of the whole text (newlines + 1); a single-character split is the
    fastest form in the JVM."""
    return F.size(F.split(F.col(text), "\n", -1))


def tag_records(spark: SparkSession, sf_dir: str, with_text: bool = False) -> DataFrame:
    """One record per document: doc_id, file_name, gen_raw, gold (tag lists),
    response (model output text), and the document text when asked.

    A pure projection of ``documents``: no shuffle.
    """
    d = table(spark, sf_dir, "documents")
    # The line count reads the whole text once; staged as a column so the
    # tag expressions below reference it instead of re-splitting the text.
    d = d.withColumn("_tw_topic", F.concat(F.lit("lines"), line_count().cast("string")))
    doc, c, lang = F.col("doc_id"), F.col("n_chars"), F.col("lang")
    topic = F.col("_tw_topic")
    short = (doc % 13 == 0)
    domain = (F.when(doc % 97 == 0, F.concat(F.lit("Rare"), doc.cast("string")))
              .when(doc % 4 == 0, "Health_Care").when(doc % 4 == 1, "LegalTech")
              .when(doc % 4 == 2, "code - review").otherwise("Finance / Banking"))
    gen = _keep_tags(
        _tag(domain, 0),
        _tag(F.when(c % 3 == 0, "Question").otherwise("Summary"), 1),
        _tag(F.when(c < 853, "Easy").when(c < 2676, "Medium").otherwise("Hard"), 2),
        _tag(F.when(~short, lang), 3),
        _tag(F.when(~short, topic), 4),
    )
    empty = F.expr(f"cast(array() as {TAG_LIST_DDL})")
    gen = F.when(doc % 11 == 0, empty).otherwise(gen)
    gold_domain = (F.when(doc % 5 == 0, "General").when(doc % 4 == 0, "Health Care")
                   .when(doc % 4 == 1, "Legal Tech").when(doc % 4 == 2, "code-review")
                   .otherwise("Finance/Banking"))
    gold = _keep_tags(
        _tag(gold_domain, 0),
        _tag(F.lit("QUESTION"), 1),
        _tag(F.when(c < 1475, "Easy").otherwise("Hard"), 2),
        _tag(F.concat(F.lit(" "), F.upper(lang), F.lit(" ")), 3),
        _tag(F.when(doc % 3 != 0, topic), 4),
    )
    gold = F.when(doc % 17 == 0, empty).otherwise(gold)
    cols = [doc.alias("doc_id"), F.col("source").alias("file_name"),
            gen.alias("gen_raw"), gold.alias("gold")]
    if with_text:
        cols.append(F.col("text"))
    out = d.select(*cols)
    return out.withColumn("response", model_output(F.col("doc_id"), F.col("gen_raw")))


def model_output(doc, tags):
    """The free-text 'model output' of a tag list, noisy by doc_id % 5."""
    js = F.to_json(tags)
    objects = F.array_join(F.transform(tags, lambda x: F.to_json(x)), ",\n")
    lines = F.array_join(F.transform(tags, lambda x: F.concat(
        F.lit("Tag: "), x["tag"], F.lit("\nExplanation: "), x["explanation"])), "\n")
    noise = doc % 5
    return (F.when(doc % 23 == 0, F.lit(NO_TAG_SENTENCE))
            .when(noise == 0, js)
            .when(noise == 1, F.concat(F.lit(FENCE_OPEN), js, F.lit(FENCE_CLOSE)))
            .when(noise == 2, F.concat(F.lit(SENTENCE_BEFORE), js, F.lit(SENTENCE_AFTER)))
            .when(noise == 3, objects)
            .otherwise(lines))


def generation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generation records: index, file_name, prompt-less responses array of two
    sampled answers (temperatures 0.5 and 0.9): the noisy model output of the
    generated tags, and the JSON of the gold tags. Pure projection."""
    r = tag_records(spark, sf_dir)
    resp = F.array(
        F.struct(F.lit(1).alias("response_id"), F.lit(0.5).alias("temperature"),
                 F.col("response").alias("text")),
        F.struct(F.lit(2).alias("response_id"), F.lit(0.9).alias("temperature"),
                 F.to_json(F.col("gold")).alias("text")),
    )
    return r.select(F.col("doc_id").alias("index"), "file_name", resp.alias("responses"))


def judge_pairs(spark: SparkSession, sf_dir: str, texts: bool = True) -> DataFrame:
    """Response pairs with a rule-derived judgement, one row per user turn.

    prompt = a user turn, response1/2 = the next two assistant turns of the
    conversation (response2 NULL when there is only one; user turns that no
    assistant turn follows give no pair); id = conv_id * 100000 + turn. The
    judgement columns stand in for the judge model: chosen 0 (a failed reply)
    when id % 19 = 0, otherwise the longer response (1 on ties); quality =
    length % 11; diversity = id % 6 + 3 and id % 4 + 4; privacy = 10 - id % 5
    and 10 - id % 3.

    One exchange by conversation: both windows share its sort. Without
    ``texts``, for plans that only need scores, lengths take the texts' place
    before the exchange.
    """
    from pyspark.sql import Window as W

    said = F.col("text") if texts else F.length("text").cast("string")
    conv = (table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))
            .select("conv_id", "turn", "role", said.alias("text")))
    after = W.partitionBy("conv_id").orderBy(F.col("turn").desc()).rowsBetween(W.unboundedPreceding, -1)
    answer = F.when(F.col("role") == "assistant", F.struct("text"))
    chained = conv.withColumn("a1", F.last(answer, ignorenulls=True).over(after))
    both = F.when(F.col("role") == "assistant", F.struct(F.col("text").alias("r1"), F.col("a1.text").alias("r2")))
    pairs = (chained.withColumn("a", F.last(both, ignorenulls=True).over(after))
             .where((F.col("role") == "user") & F.col("a.r1").isNotNull() & F.col("text").isNotNull())
             .select((F.col("conv_id") * 100000 + F.col("turn")).alias("id"), F.col("text").alias("prompt"),
                     F.col("a.r1").alias("response1"), F.col("a.r2").alias("response2")))
    i = F.col("id")
    l1, l2 = (F.length(c) if texts else F.col(c).cast("int") for c in ("response1", "response2"))
    return pairs.select(
        "id", "prompt", "response1", "response2",
        F.when(i % 19 == 0, 0).when(l1 >= l2, 1).when(l2.isNull(), 1).otherwise(2).alias("chosen"),
        (l1 % 11).cast("double").alias("q1"), (l2 % 11).cast("double").alias("q2"),
        (i % 6 + 3).cast("double").alias("d1"), (i % 4 + 4).cast("double").alias("d2"),
        (10 - i % 5).cast("double").alias("p1"), (10 - i % 3).cast("double").alias("p2"),
    )


def vector_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag-vector rows: (rec_id, file_name, side, pos, tag, vec_id).

    Every embedding row is one tag named 'v<vec_id>' of record vec_id div 8,
    in file 'part<vec_id div 96>' (12 whole records per file). It is a gold tag when label < 6 and a
    predicted tag when label >= 4 (labels 4 and 5 sit on both sides, so some
    tags match exactly). pos is the vec_id order inside the record.
    """
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    base = e.select(
        F.floor(F.col("vec_id") / 8).alias("rec_id"),
        F.concat(F.lit("part"), F.floor(F.col("vec_id") / 96).cast("string")).alias("file_name"),
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("tag"),
        "vec_id", "label")
    gold = base.where(F.col("label") < 6).withColumn("side", F.lit("gold"))
    pred = base.where(F.col("label") >= 4).withColumn("side", F.lit("pred"))
    return gold.unionByName(pred).drop("label")


def vector_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with gold and predicted tag-name lists in vec_id order:
    (rec_id, file_name, gold ARRAY<STRING>, pred ARRAY<STRING>).

    The regrouping collects at most 8 names per record (bounded by the
    derivation, whatever the table size).
    """
    t = vector_tags(spark, sf_dir)
    g = t.groupBy("rec_id").agg(
        F.first("file_name").alias("file_name"),
        F.sort_array(F.collect_list(F.when(F.col("side") == "gold", F.struct("vec_id", "tag")))).alias("g"),
        F.sort_array(F.collect_list(F.when(F.col("side") == "pred", F.struct("vec_id", "tag")))).alias("p"))
    return g.select("rec_id", "file_name",
                    F.transform("g", lambda x: x["tag"]).alias("gold"),
                    F.transform("p", lambda x: x["tag"]).alias("pred"))
