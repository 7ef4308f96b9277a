"""File-to-file jobs: the entry points a user runs.

``evaluate_files``   directory of JSON / JSONL evaluation files -> prompts ->
                     model outputs (written once) -> tags -> per-file and
                     overall metrics, failed cases, summary files.
``curate_preferences`` generation records (JSON Lines) -> cleaned responses ->
                     rare-tag filter -> pairwise judge -> annotated rows ->
                     training export.

Model outputs are written to the output folder before anything reads them
twice, because model calls are not deterministic.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tagweave.functions import metrics as M
from tagweave.functions.extract import extract_tags_sft, tag_names
from tagweave.functions.jsonparse import has_key, is_object
from tagweave.functions.text import fill_template
from tagweave.operators import export, freq, judge, modelcall, parse, prompts, score, split
from tagweave.session import checkpoint_dir, fixed_splits, remove_path
from tagweave.sources import readers, sinks
from tagweave.streaming import resume as streams
from tagweave.streaming.ledger import append_new, results


def variant_tag_names(v) -> F.Column:
    """Tag names of a stored tag list (O-P11, evaluation form): objects with a
    ``tag`` key give its value, strings give themselves, others are dropped."""
    arr = F.try_variant_get(v, "$", "array<variant>")
    names = F.transform(arr, lambda x: F.when(is_object(x) & has_key(x, "tag"),
                                              F.try_variant_get(x, "$.tag", "string"))
                        .when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))
    return F.coalesce(F.filter(names, lambda n: n.isNotNull()), F.array().cast("array<string>"))


# n_gold: elements of the stored gold list, also those without a name.
RESULTS_DDL = ("file_name string, run string, index bigint, pos struct<block:bigint,row:bigint>, truncated_input string, "
               "gold_names array<string>, n_gold int, raw_response string, generation_error string, error string")


def evaluate_files(spark: SparkSession, data_dir: str, output_dir: str,
                   model_factory: Callable[[], Callable] = lambda: modelcall.word_count_tagger,
                   run_name: str = "model", embed: Callable[[DataFrame], DataFrame] | None = None,
                   num_samples: int | None = None, max_tokens: int = 300, batch_size: int = 8,
                   threshold: float = 0.8, max_in_flight: int = 1, vector_cache: str | None = None,
                   encoder: str = "encoder") -> dict[str, DataFrame]:
    """O-S6 -> O-S2/S3 -> O-P1 -> O-P3/P2/P17 -> O-M1 (written) -> O-P8/P9 ->
    O-P11 -> O-A6..A12 -> O-A13 -> O-A14 -> O-K3/K4, over all files at once
    (one DataFrame with a ``file_name`` column instead of a loop). "First" cases
    and samples are the first in the source file. With ``vector_cache`` the
    vectors of ``embed`` are kept there by ``encoder`` and tag (O-J3)."""
    rows = readers.source_fields(readers.evaluation_rows(spark, data_dir))
    if num_samples is not None:
        rows = split.per_group_limit(rows, "file_name", [F.col("pos")], num_samples).drop("rn")
    src = prompts.build_prompts(prompts.inference_text(rows), max_tokens=max_tokens)
    src = src.withColumn("gold_names", variant_tag_names(F.col("parsed_tags"))).withColumn(
        "n_gold", F.size(F.try_variant_get("parsed_tags", "$", "array<variant>")))
    gen = modelcall.generate(src.drop("v", "parsed_tags", "generated_tags"), "prompt_text",
                             model_factory, batch_size=batch_size, max_in_flight=max_in_flight)
    results_path = f"{output_dir}/results"
    sinks.write_results(gen.select("file_name", "index", "pos", "truncated_input", "gold_names", "n_gold", "raw_response",
                                   "generation_error", "error"), results_path, run_name)
    res = spark.read.schema(RESULTS_DDL).json(results_path)
    res = res.where(F.col("run") == sinks_run(run_name)).drop("run")
    # Every result row gets a key of its own; the copy in the checkpoint folder
    # fixes it, so the explode and the regroup below see the same keys.
    checkpoint_dir(spark)
    res = res.withColumn("_rid", F.monotonically_increasing_id()).checkpoint(eager=True)
    res = score.parse_generated(res, "raw_response")
    # Rows whose input item carried an ``error`` stay out of the counts (O-P21);
    # a failed model call is scored like any output ("Generation failed").
    res = res.withColumn("pred_names", tag_names(F.col("generated_tags")))
    scored = score.with_exact(res, "pred_names", "gold_names", normalise=True)
    semantic = embed is not None
    if semantic:
        if vector_cache:
            embed = modelcall.cached_vectors(embed, vector_cache, encoder)
        grids = score.attach_grid(scored.select("_rid", "gold_names", "pred_names"), embed, "_rid", "gold_names", "pred_names")
        scored = scored.drop("gold_names", "pred_names").join(grids, "_rid")
        scored = score.with_semantic_grid(scored, "gold_names", "pred_names", threshold)
        scored = scored.withColumn("best_matches", M.best_from_grid(F.col("gold_names"), F.col("pred_names"), F.col("grid")))
    metrics = score.file_metrics(scored, semantic=semantic)
    failed = score.failed_cases(scored, order_key="pos", semantic=semantic, k=5,
                                text=F.col("truncated_input"))
    # The summary is written from one pass over the results, and read back.
    sinks.write_jsonl(metrics, f"{output_dir}/summary/per_file", mode="overwrite")
    metrics = spark.read.schema(metrics.schema).json(f"{output_dir}/summary/per_file")
    overall = score.overall(metrics, semantic=semantic)
    sinks.write_jsonl(overall, f"{output_dir}/summary/overall", mode="overwrite")
    # Failed cases keep the best match of every gold tag where there are similarities.
    sinks.write_failed_cases(failed.select(
        "file_name", "index", "case_rank", "input_preview", "gold_names", "pred_names", *score.EXACT,
        *([*score.SEMANTIC, "best_matches"] if semantic else [])), f"{output_dir}/failed_cases")
    return {"results": scored, "metrics": metrics, "overall": overall, "failed_cases": failed}


def sinks_run(run_name: str) -> str:
    """The run folder name written by ``sinks.write_results``."""
    import re

    return re.sub(r"[/\\]", "_", run_name)


GENERATION_DDL = ("index bigint, prompt string, responses array<struct<response_id:int,"
                  "temperature:double,text:string,error:string,generated_at:string>>")


def curate_preferences(spark: SparkSession, generation_path: str, output_dir: str,
                       judge_factory: Callable[[], Callable] | None = None, min_freq: int = 2,
                       min_gap: float = 2.0, min_privacy: float = 7.0,
                       format_type: str = "dpo_weighted", resume: bool = True, max_in_flight: int = 1) -> dict[str, DataFrame]:
    """O-S8 -> O-P7 -> O-A1/F1 -> O-F4 -> O-M4 or O-M5 (written) -> O-P18 ->
    O-F3 -> O-A15/A16 -> O-X1..X4 -> O-K1. Without ``judge_factory`` the rule
    judge scores the pairs. With ``resume``, pairs that have a usable reply
    are not judged again (O-J1), failed ones are, and pairs without an id are
    told apart by their content; without, all are judged anew. The outcomes
    hold all usable replies and the failed ones of this run."""
    recs = spark.read.schema(GENERATION_DDL).json(generation_path)
    cleaned = parse.clean_responses(recs)
    filt = freq.rare_filter(cleaned, min_freq=min_freq)
    kept = filt["kept"]
    # Pair texts: the parsed list as canonical JSON when it parsed, else the raw text.
    canon = F.transform(F.col("responses"), lambda r: F.coalesce(
        F.when(r["items"].isNotNull(), F.to_json(F.transform(r["items"], lambda x: F.struct(
            F.coalesce(x["tag"], F.lit("")).alias("tag"),
            F.coalesce(x["explanation"], F.lit("")).alias("explanation"))))), r["raw_text"]))
    pairs = kept.select(F.col("index").alias("id"), "prompt", F.get(canon, 0).alias("response1"),
                        F.get(canon, 1).alias("response2"))
    pairs = judge.eligible(pairs)
    annotated_path = f"{output_dir}/annotated"
    if not resume:
        remove_path(spark.sparkContext, annotated_path)

    def reply(rows: DataFrame) -> DataFrame:
        if judge_factory is not None:
            return modelcall.judge_pairs(rows, judge_factory, max_in_flight=max_in_flight)
        return judge.rule_judge(rows).withColumns({c: F.lit(None).cast("string") for c in ("reasoning", "annotation")})

    # Model replies are written once. Pairs without a usable reply do not count as annotated: the next run asks again.
    usable = F.col("chosen").isin(1, 2) if judge_factory is not None else None
    batch = f"run-{uuid.uuid4().hex}"
    append_new(spark, pairs, annotated_path, batch, "id", reply, usable, keep_failed=False)
    judged = judge.judge(results(spark, annotated_path, reply(pairs).schema, batch), min_gap, min_privacy)
    pref = judge.preference_rows(judged)
    # Outcomes and averages are counted while the preferences are written: one pass over the annotated rows.
    seen = Observation()
    kept_rows = F.col("outcome") == "kept"
    counted = judged.observe(seen, *[F.count_if(F.col("outcome") == o).alias(o) for o in judge.OUTCOMES], *[
        F.avg(F.when(kept_rows, F.col(c))).alias(f"avg_{c}") for c in ("diversity_gap", "privacy_chosen", "privacy_rejected")])
    sinks.write_jsonl(judge.preference_rows(counted).select("index", "prompt", "chosen", "rejected", "reasoning", F.col("annotation").alias("full_annotation"), F.struct(
        "quality_chosen", "quality_rejected", "diversity_chosen", "diversity_rejected", "diversity_gap",
        "privacy_chosen", "privacy_rejected").alias("scores")), f"{output_dir}/preferences", mode="overwrite")
    told = seen.get
    out = export.export(pref, format_type)
    sinks.write_jsonl(out, f"{output_dir}/{format_type}", mode="overwrite")
    out = spark.read.schema(out.schema).json(f"{output_dir}/{format_type}")
    sinks.write_jsonl(filt["stats"], f"{output_dir}/filter_stats", mode="overwrite")
    averages = ("avg_diversity_gap", "avg_privacy_chosen", "avg_privacy_rejected")
    return {"cleaned": cleaned, "filter_stats": filt["stats"],
            "outcomes": spark.createDataFrame([(o, told[o]) for o in judge.OUTCOMES if told[o]], "outcome string, n long"),
            "averages": spark.createDataFrame([(told["kept"], *[told[a] for a in averages])],
                                              "kept long, " + ", ".join(f"{a} double" for a in averages)), "export": out}


GENERATION_INPUT_DDL = "index bigint, prompt string, original_data string"


def generate_records(spark: SparkSession, in_path: str, output_dir: str, model_factory: Callable[[], Callable],
                     model_name: str = "model", temperatures=modelcall.DEFAULT_TEMPERATURES, start: int = 0, end: int | None = None,
                     limit: int | None = None, batch_size: int = 8, rows_per_file: int = 1000, files_per_batch: int = 64,
                     max_in_flight: int = 1, glob: str = "*.{jsonl,json}") -> DataFrame:
    """The generation job (O-S9 -> O-P2 -> O-M2 -> O-M3 -> O-R2): records of
    JSON Lines, in source order, from ``start`` to ``end`` or ``limit`` -> the
    tagging prompt -> one response for each temperature -> generation records
    under ``output_dir/records``.

    The range is written as files of ``rows_per_file`` rows, which a streaming
    run takes up in micro-batches; each batch is committed, so a run that dies
    goes on where it stopped. Rows are numbered where they stand, without a
    sort or a copy of them, and what is written is compressed (``sinks.GZIP``;
    Spark reads it like plain JSON Lines). Records are keyed by ``index`` (a row without one
    gets its place in the source). A row all of whose calls failed is written
    as an error record, and asked again by the next run. Returns the usable
    records of all runs."""
    lines = readers.tolerant_jsonl(spark, in_path, glob, position=True)
    rows = lines.select(F.try_variant_get("v", "$.index", "bigint").alias("index"), F.try_variant_get("v", "$.prompt", "string").alias("prompt"),
                        F.to_json("v").alias("original_data"), "file_name", "pos")
    stop = min([x for x in (end, None if limit is None else start + limit) if x is not None], default=None)
    with fixed_splits(spark):
        ranked = split.source_ordinal(rows, out="place")
        ranked = ranked.where(F.col("place") >= start) if stop is None else ranked.where(F.col("place").between(start, stop - 1))
        (ranked.select(F.coalesce("index", "place").alias("index"), "prompt", "original_data")
         .write.mode("append").options(**sinks.GZIP).option("maxRecordsPerFile", rows_per_file).json(f"{output_dir}/input"))

    def answer(todo: DataFrame) -> DataFrame:
        prompted = todo.withColumn("tagging_prompt", fill_template(prompts.GENERATION_TEMPLATE, query=F.col("prompt")))
        sampled = modelcall.sample_responses(prompted, "tagging_prompt", model_factory, temperatures, batch_size, max_in_flight=max_in_flight)
        return modelcall.generation_records(sampled, "original_data", "tagging_prompt", model_name, keep=("row_id", "prompt"))

    out = f"{output_dir}/records"
    streams.resumable_append(spark, f"{output_dir}/input", out, f"{output_dir}/progress", GENERATION_INPUT_DDL, "index", answer,
                             "*.{json,json.gz}", F.col("error").isNull(), files_per_batch, sinks.GZIP)
    schema = answer(spark.createDataFrame([], GENERATION_INPUT_DDL + ", row_id string")).drop("row_id").schema
    return results(spark, out, schema)


def sft_run(spark: SparkSession, path: str, output_dir: str, before: Callable[[], Callable], after: Callable[[], Callable],
            run_name: str = "sft", eval_fraction: float = 0.2, batch_size: int = 8, key: str | None = None) -> DataFrame:
    """The SFT data job: tagging records (JSON Lines of prompt and
    parsed_tags) -> train / eval by hash of ``key`` (of the content without one) -> training targets and budgets,
    written -> the eval part answered by a model before and after tuning,
    written -> SFT extraction and mean exact F1 of both -> one run record
    appended to ``runs`` and returned. JSON Lines and JSON documents are read; a
    run without any row is an error. The training part is counted as it is
    written (``DataFrame.observe``), not by reading it back."""
    rows = readers.source_fields(readers.evaluation_rows(spark, path))
    rows = split.hash_split(rows.withColumn("key", F.col(key).cast("string") if key else F.md5(F.to_json("v"))), "key", eval_fraction)
    stored = F.to_json("parsed_tags")
    train = rows.where("split = 'train'").select("index", "prompt", prompts.sft_target(stored).alias("target"))
    budget = prompts.token_budget(train, "prompt", "target", eos="")
    seen = Observation()
    sinks.write_jsonl(budget.observe(seen, F.count(F.lit(1)).alias("n_train"), F.coalesce(
        F.sum(F.col("truncated").cast("int")), F.lit(0)).alias("n_truncated")), f"{output_dir}/train", mode="overwrite")
    counted = seen.get
    held = rows.where("split = 'eval'").select("index", F.coalesce("prompt", F.lit("")).alias("prompt"),
                                                variant_tag_names(F.col("parsed_tags")).alias("gold_names"))
    answers = modelcall.generate(modelcall.generate(held, "prompt", before, batch_size, "before").drop("generation_error"),
                                 "prompt", after, batch_size, "after")
    asked = Observation()
    sinks.write_jsonl(answers.observe(asked, F.count(F.lit(1)).alias("n_eval")), f"{output_dir}/eval", mode="overwrite")  # model outputs: written once
    if not counted["n_train"] + asked.get["n_eval"]:
        raise ValueError(f"no records under {path}")
    told = spark.read.schema(answers.schema).json(f"{output_dir}/eval")
    scores = [M.exact_prf(tag_names(extract_tags_sft(F.col(c))), F.col("gold_names"), normalise=False)["f1"].alias(f"{c}_f1")
              for c in ("before", "after")]
    mean = told.select(*scores).agg(*[F.coalesce(F.avg(f"{c}_f1"), F.lit(0.0)).alias(f"{c}_f1") for c in ("before", "after")]).first()
    record = spark.createDataFrame([(run_name, eval_fraction, counted["n_train"], counted["n_truncated"], asked.get["n_eval"], *mean)],
                                   "run string, eval_fraction double, n_train long, n_truncated long, n_eval long, before_f1 double, after_f1 double")
    sinks.append_run(record, f"{output_dir}/runs")
    return record.select("run", "n_train", "n_truncated", "n_eval", "before_f1", "after_f1")


def report_results(spark: SparkSession, results_dir: str, output_dir: str) -> dict[str, DataFrame]:
    """Reports over evaluation results: tag distributions per
    file and position for generated and gold tags, pooled topics top 30,
    generation quality and the position-wise comparison; the long-form
    report is written as CSV, the others as JSON Lines."""
    from tagweave.operators import report

    res = spark.read.schema(RESULTS_DDL).json(results_dir)
    res = score.parse_generated(res, "raw_response")
    res = res.withColumn("gold", F.transform("gold_names", lambda n: F.struct(
        n.alias("tag"), F.lit("").alias("explanation"))))
    res = res.withColumn("pred_names", tag_names(F.col("generated_tags")))
    pos = report.positional_tags(res, {"generated": "generated_tags", "ground_truth": "gold"})
    dist = report.tag_distribution(pos, require_side="generated")
    topics = report.topic_top(pos, k=30, side="generated")
    quality = report.generation_quality(res, "generated_tags")
    # Emptiness is that of the stored lists: results of former versions have names only.
    res = res.withColumn("gold_list", F.array_repeat(F.lit(0), F.coalesce(F.greatest("n_gold", F.lit(0)), F.size("gold_names"))))
    compare = report.position_compare(res, "pred_names", "gold_names", gen_list="generated_tags", gold_list="gold_list")
    long_form = dist.select("file_name", F.col("side").alias("section"), "pos", "tag", "n", "pct").unionByName(
        topics.select("file_name", F.lit("topics").alias("section"), F.lit(4).alias("pos"), "tag", "n",
                      (F.col("n") * 100.0 / F.col("total")).alias("pct")))
    sinks.write_report(long_form, f"{output_dir}/report")
    sinks.write_jsonl(quality, f"{output_dir}/generation_quality", mode="overwrite")
    sinks.write_jsonl(compare, f"{output_dir}/position_compare", mode="overwrite")
    return {"distribution": dist, "topics": topics, "quality": quality, "compare": compare,
            "report": long_form}


def filter_generation(spark: SparkSession, generation_path: str, output_dir: str, min_freq: int = 2,
                      positions=None) -> dict[str, DataFrame]:
    """Clean generation records and drop samples with rare tags (SURVEY 3.2
    steps 2-3): kept records, removal reasons and stats as JSON Lines."""
    recs = spark.read.schema(GENERATION_DDL).json(generation_path)
    cleaned = parse.clean_responses(recs)
    filt = freq.rare_filter(cleaned, min_freq=min_freq, positions=positions or freq.DEFAULT_POSITIONS)
    sinks.write_jsonl(filt["kept"], f"{output_dir}/kept", mode="overwrite")
    sinks.write_jsonl(filt["removed"], f"{output_dir}/removed", mode="overwrite")
    sinks.write_jsonl(filt["stats"], f"{output_dir}/stats", mode="overwrite")
    for name in ("settings", "first_removed", "first_reasons"):
        sinks.write_jsonl(filt[name], f"{output_dir}/{name}", mode="overwrite")
    return {"kept": filt["kept"], "removed": filt["removed"], "stats": filt["stats"], "freq": filt["freq"]}


PREFERENCE_FILE_DDL = (
    "index bigint, prompt string, chosen string, rejected string, scores struct<quality_chosen:double,"
    "quality_rejected:double,diversity_chosen:double,diversity_rejected:double,diversity_gap:double,"
    "privacy_chosen:double,privacy_rejected:double>")


def export_annotated(spark: SparkSession, annotated_path: str, output_path: str,
                     format_type: str = "dpo") -> DataFrame:
    """Annotated preference rows (JSON Lines) -> a training format (O-X4)."""
    pref = spark.read.schema(PREFERENCE_FILE_DDL).json(annotated_path).select(
        "index", "prompt", "chosen", "rejected", "scores.*")
    out = export.export(pref, format_type)
    sinks.write_jsonl(out, output_path, mode="overwrite")
    return out


__all__ = ["evaluate_files", "curate_preferences", "report_results", "filter_generation", "export_annotated",
           "generate_records", "sft_run", "variant_tag_names"]
