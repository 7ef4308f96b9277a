"""Plans that write files derived from the tables and read them back through
the readers, jobs and streams (O-S1, O-S3, O-S9, O-K3, O-K7, O-M1, O-M3, O-R1
.. O-R4, O-U1). Each returns what came back, so a lost or doubled row shows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave.operators import modelcall, score, split
from tagweave.plans import jobs
from tagweave.session import scratch_folder
from tagweave.sources import derived, readers, sinks
from tagweave.streaming import ledger, resume


def r6(c):
    return F.round(F.col(c), 6).alias(c)


def json_document_rows(spark, sf_dir):
    """JSON documents that hold lists of a hundred records (O-S3), read element by element."""
    d = derived.table(spark, sf_dir, "documents").select("doc_id", "n_chars", "text")
    lists = d.groupBy(F.floor(F.col("doc_id") / 100).alias("g")).agg(F.to_json(F.collect_list(F.struct("doc_id", "n_chars", "text"))).alias("value"))
    path = scratch_folder(spark, "json-documents")
    lists.select("value").write.text(path)
    v = F.col("v")
    return readers.json_documents(spark, path, glob="*.txt").select(
        F.try_variant_get(v, "$.doc_id", "bigint").alias("doc_id"), F.try_variant_get(v, "$.n_chars", "bigint").alias("n_chars"),
        F.length(F.try_variant_get(v, "$.text", "string")).alias("text_length"))


def _mixed_lines(spark, sf_dir):
    """JSON Lines with every kind of bad line, by doc_id % 8."""
    d = derived.table(spark, sf_dir, "documents").select("doc_id")
    i, k = F.col("doc_id").cast("string"), F.col("doc_id") % 8
    line = (F.when(k == 0, " ").when(k == 1, "not json").when(k == 2, "{}").when(k == 3, F.concat(F.lit("["), i, F.lit("]")))
            .when(k == 4, F.concat(F.lit('{"index": -1, "index": '), i, F.lit("}")))
            .when(k == 5, F.concat(F.lit('{"index": '), i, F.lit(', "score": NaN}')))
            .when(k == 6, F.concat(F.lit('{"index": '), i, F.lit("} trailing")))
            .otherwise(F.concat(F.lit('{"index": '), i, F.lit("}"))))
    path = scratch_folder(spark, "mixed-lines")
    d.select(line.alias("value")).write.text(path)
    return path


def tolerant_reader_rows(spark, sf_dir):
    """Lines the tolerant reader keeps (O-S1): repeated keys and NaN survive."""
    rows = readers.tolerant_jsonl(spark, _mixed_lines(spark, sf_dir), glob="*.txt")
    return rows.select(F.try_variant_get("v", "$.index", "bigint").alias("index"))


def tolerant_reader_rejects(spark, sf_dir):
    """Lines it skips, counted by reason."""
    rejects = readers.jsonl_rejects(spark, _mixed_lines(spark, sf_dir), glob="*.txt")
    return rejects.groupBy("reason").agg(F.sum("n").alias("n"))


def judge_input_rows(spark, sf_dir):
    """Judge input from JSON Lines (O-S4, strict), rows that own an ``items`` list left whole."""
    d = derived.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("index"), F.array(F.col("n_chars"), F.col("n_chars")).alias("items"))
    path = scratch_folder(spark, "judge-input")
    sinks.write_jsonl(d, path)
    return readers.judge_input(spark, path).select(
        F.try_variant_get("v", "$.index", "bigint").alias("index"), F.try_variant_get("v", "$.items[1]", "bigint").alias("second_item"))


def preference_dir_rows(spark, sf_dir):
    """Preference rows read from a folder (O-S5) whose files hold bad, blank and weightless lines, by doc_id % 4."""
    d = derived.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    k = F.col("doc_id") % 4
    row = F.to_json(F.struct(F.col("doc_id").cast("string").alias("prompt"), F.col("lang").alias("chosen"), F.col("source").alias("rejected"),
                             F.when(k == 3, F.col("n_chars")).alias("weight")))
    line = F.when(k == 0, "").when(k == 1, F.concat(F.lit("not json "), row)).otherwise(row)
    path = scratch_folder(spark, "preference-dir")
    d.select(line.alias("value")).write.text(path)
    rows = readers.preference_dir(spark, path, glob="*.txt")
    text = {c: F.try_variant_get(c, "$", "string").alias(c) for c in ("prompt", "chosen", "rejected")}
    return rows.select(*text.values(), F.try_variant_get("weight", "$", "bigint").alias("weight"), "has_weight")


def positional_record_rows(spark, sf_dir):
    """Records stored as lists, as objects and as neither (O-S7), by doc_id % 3."""
    d = derived.table(spark, sf_dir, "documents").select("doc_id", "text", F.array("lang", "source").alias("parsed_tags"))
    i, k = F.col("doc_id").cast("string"), F.col("doc_id") % 3
    quoted = F.to_json(F.array("text"))
    listed = F.concat(F.lit("["), i, F.lit(","), F.substring(quoted, F.lit(2), F.length(quoted) - 2), F.lit(","), F.to_json("parsed_tags"), F.lit("]"))
    line = (F.when(k == 0, listed).when(k == 1, F.to_json(F.struct(F.col("doc_id").alias("index"), F.col("text").alias("prompt"), "parsed_tags")))
            .otherwise(F.concat(F.lit("["), i, F.lit("]"))))
    path = scratch_folder(spark, "positional")
    d.select(line.alias("value")).write.text(path)
    v = readers.jsonl_variant(spark, path, glob="*.txt").select(readers.positional_record(F.col("v")).alias("r"))
    return v.where("r IS NOT NULL").select(
        "r.index", F.length("r.prompt").alias("prompt_chars"), F.try_variant_get("r.parsed_tags", "$[0]", "string").alias("first_tag"),
        F.try_variant_get("r.parsed_tags", "$[1]", "string").alias("second_tag"))


def row_range_rows(spark, sf_dir):
    """Rows 100 to 150 in key order (O-S9)."""
    d = derived.table(spark, sf_dir, "documents").select("doc_id")
    return split.row_range(d, "doc_id", start=100, limit=50).select("doc_id", "ordinal")


def concat_counts(spark, sf_dir):
    """Documents and conversation turns appended by column name (O-S8, O-U1)."""
    d = derived.table(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), "text", "lang")
    c = derived.table(spark, sf_dir, "conversations").select("text", F.lit("conversations").alias("origin"), "role")
    return split.concat(d, c).groupBy("origin").agg(
        F.count(F.lit(1)).alias("n"), F.count("lang").alias("with_lang"), F.count("role").alias("with_role"), F.sum(F.length("text")).alias("chars"))


def _yes(prompts):
    return ['[{"tag": "Yes", "explanation": "always"}]' for _ in prompts]


def _no(prompts):
    return ['[{"tag": "No", "explanation": "always"}]' for _ in prompts]


def evaluate_files_metrics(spark, sf_dir):
    """The evaluation job run twice into one folder (O-K3): the second run replaces the first."""
    d = derived.table(spark, sf_dir, "documents").select(
        F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")).alias("index"), F.col("text").alias("input"),
        F.when(F.col("doc_id") % 7 == 0, F.lit("upstream")).alias("error"),
        F.array(F.struct(F.when(F.col("n_chars") % 2 == 0, "yes").otherwise("no").alias("tag"))).alias("parsed_tags"))
    path = scratch_folder(spark, "evaluation-rows")
    sinks.write_jsonl(d, f"{path}/data", keep_nulls=False)
    for _ in range(2):
        out = jobs.evaluate_files(spark, f"{path}/data", f"{path}/out", lambda: _yes, run_name="m", batch_size=512)
    o = score.overall(out["metrics"], semantic=False, micro=True)
    return o.select("total_samples", "valid_samples", r6("exact_match_f1"), "failed_cases_count")


def resume_twice(spark, sf_dir):
    """Resumable append (O-R1 .. O-R3) over half of the rows, then over all of them."""
    d = derived.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    path = scratch_folder(spark, "resume")
    for rows in (d.where("doc_id % 2 = 0"), d):
        sinks.write_jsonl(rows, f"{path}/in")
        resume.resumable_append(spark, f"{path}/in", f"{path}/out", f"{path}/progress", d.schema, "doc_id", glob="*.json")
    return ledger.results(spark, f"{path}/out", d.schema)


def resume_failed_rounds(spark, sf_dir):
    """Three rounds of a resumable run (O-R1 .. O-R3): half of the rows, all of them, no new ones. Every seventh row
    has no key, and in each round a third of the rows fail; failed rows are asked again by the next round."""
    d = derived.table(spark, sf_dir, "documents").select(
        F.when(F.col("doc_id") % 7 > 0, F.col("doc_id")).alias("key"), F.col("doc_id").cast("string").alias("body"), "n_chars")
    path = scratch_folder(spark, "resume-rounds")
    for n, rows in enumerate((d.where("body % 2 = 0"), d, d.limit(0)), 1):
        sinks.write_jsonl(rows, f"{path}/in")
        resume.resumable_append(spark, f"{path}/in", f"{path}/out", f"{path}/progress", d.schema, "key",
                                lambda t: t.withColumn("round", F.lit(n)), "*.json", (F.col("n_chars") + F.lit(n)) % 3 != 0)
    return ledger.results(spark, f"{path}/out", "key bigint, body string, n_chars bigint, round int")


def generation_job(spark, sf_dir):
    """The generation job (O-S9, O-P2, O-M2, O-M3, O-R2) run twice over all documents: prompts of odd length fail the first time."""
    d = derived.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("index"), F.col("text").alias("prompt"), "n_chars")
    path = scratch_folder(spark, "generation-job")
    sinks.write_jsonl(d, f"{path}/in", options=sinks.GZIP)

    def model(n):
        def answer(prompts_, temperature):
            if n == 1 and any(len(p) % 2 for p in prompts_):
                raise RuntimeError("service down")
            return [f"round {n}" for _ in prompts_]
        return lambda: answer

    for n in (1, 2):
        records = jobs.generate_records(spark, f"{path}/in", f"{path}/out", model(n), "stand-in", end=None if n == 1 else 0, batch_size=1,
                                        glob="*.json.gz")
    return records.select("index", F.length("prompt").alias("prompt_chars"), F.length("tagging_prompt").alias("tagging_chars"), "metadata.model",
                          "metadata.n_responses", F.get("responses", 1)["text"].alias("second_text"),
                          F.col("metadata.processed_at").isNotNull().alias("timed"), "error")


def first_failed_cases(spark, sf_dir):
    """First failed cases in source order (O-F5): files by source, rows by id, none with an index."""
    d = derived.table(spark, sf_dir, "documents").select(
        F.concat_ws(" ", F.col("doc_id").cast("string"), F.col("lang")).alias("input"), "source", "doc_id",
        F.array(F.struct(F.when(F.col("n_chars") % 3 == 0, "yes").otherwise("no").alias("tag"))).alias("parsed_tags"))
    path = scratch_folder(spark, "source-order")
    (d.repartition("source").sortWithinPartitions("source", "doc_id").drop("doc_id").write.partitionBy("source").json(f"{path}/data"))
    out = jobs.evaluate_files(spark, f"{path}/data", f"{path}/out", lambda: _yes, run_name="m", batch_size=512)
    return out["failed_cases"].select(F.regexp_extract("file_name", "source=([^/]*)", 1).alias("source"), "case_rank", "truncated_input")


def running_tag_counts(spark, sf_dir):
    """Running (pos, tag) counts over files that arrive in two rounds (O-R4)."""
    d = derived.table(spark, sf_dir, "documents").select("doc_id", F.array("lang", "source").alias("tags"))
    path = scratch_folder(spark, "running")
    for rows in (d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1")):
        sinks.write_jsonl(rows, f"{path}/in")
        out = resume.running_tag_counts(spark, f"{path}/in", f"{path}/progress", d.schema, lambda s: s.select(F.posexplode("tags").alias("pos", "tag")), f"{path}/out")
    return out


def generation_record_rows(spark, sf_dir):
    """Generation records (O-M2, O-M3) of every document: the prompt's words as stand-in answers."""
    d = derived.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("index"), "lang", "text")
    s = modelcall.sample_responses(d, "text")
    g = modelcall.generation_records(s, ["index", "lang"], "text", "stand-in")
    return g.select("index", "original_data", F.length("tagging_prompt").alias("prompt_chars"), "metadata.n_responses",
                    F.get("responses", 1)["text"].alias("second_text"), "error")


def sft_run_record(spark, sf_dir):
    """The SFT data job over all documents: a model that always says yes before tuning, and no after it."""
    d = derived.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("index"), F.col("text").alias("prompt"),
        F.array(F.struct(F.when(F.col("n_chars") % 2 == 0, "Yes").otherwise("No").alias("tag"), F.lit("x").alias("explanation"))).alias("parsed_tags"))
    path = scratch_folder(spark, "sft-run")
    sinks.write_jsonl(d, f"{path}/in")
    r = jobs.sft_run(spark, f"{path}/in", f"{path}/out", lambda: _yes, lambda: _no, key="index", batch_size=512)
    return r.select("run", "n_train", "n_eval", r6("before_f1"), r6("after_f1"))
