"""Readers, sinks, model-call steps and resumable streaming runs."""

import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagweave.operators import export, modelcall
from tagweave.sources import readers, sinks
from tagweave.streaming import ledger, resume


def write(path, name, text):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w", encoding="utf-8") as f:
        f.write(text)


def test_tolerant_jsonl(spark, tmp_dir):
    write(tmp_dir, "a.jsonl", '{"index": 1, "prompt": "é"}\n\nnot json\n{}\n[1]\n{"index": 2}\n')
    write(tmp_dir, "skip.txt", '{"index": 3}\n')
    rows = readers.tolerant_jsonl(spark, tmp_dir)
    got = sorted(r[0] for r in rows.select(F.try_variant_get("v", "$.index", "int")).collect())
    assert got == [1, 2]


def test_json_documents_and_containers(spark, tmp_dir):
    write(tmp_dir, "list.json", json.dumps([{"a": 1}, {"a": 2}]))
    write(tmp_dir, "one.json", json.dumps({"data": [{"a": 3}], "meta": 1}))
    write(tmp_dir, "bad.json", "{oops")
    docs = readers.json_documents(spark, tmp_dir)
    assert docs.count() == 3
    rejects = readers.document_rejects(spark, tmp_dir).collect()
    assert len(rejects) == 1 and rejects[0].file_name.endswith("bad.json")
    with pytest.raises(Exception, match="no rows in .*bad.json"):
        readers.container_rows(readers.document_rows(spark, tmp_dir)).collect()
    rows = readers.container_rows(readers.document_rows(spark, tmp_dir, "[lo]*.json"))
    vals = sorted(r[0] for r in rows.select(F.try_variant_get("v", "$.a", "int")).collect())
    assert vals == [1, 2, 3]


def test_strict_jsonl_fails_on_bad_line(spark, tmp_dir):
    write(tmp_dir, "ok.jsonl", '{"index": 1}\n\n{"index": 2}\n')
    assert readers.strict_jsonl(spark, tmp_dir).count() == 2
    write(tmp_dir, "bad.jsonl", '{"index": 3}\nbroken\n')
    with pytest.raises(Exception, match="invalid JSON line"):
        readers.strict_jsonl(spark, tmp_dir).collect()


def test_positional_record(spark):
    df = spark.createDataFrame([('[7, "q", [{"tag":"a"}]]',), ('{"prompt":"q","parsed_tags":[]}',), ('[1,2]',)],
                               "j string")
    out = df.select(readers.positional_record(F.parse_json("j")).alias("r")).collect()
    assert out[0].r["index"] == 7 and out[0].r.prompt == "q"
    assert out[1].r.prompt == "q" and out[2].r is None


def test_preference_dir_and_training_rows(spark, tmp_dir):
    lines = [
        {"prompt": "q1", "chosen": [{"tag": "a", "explanation": "x"}], "rejected": "plain", "weight": 0.5},
        {"prompt": "q2", "chosen": ["a"], "rejected": []},              # no weight -> 1.0
        {"prompt": "", "chosen": "a", "rejected": "b"},                  # empty prompt
        {"prompt": "q4", "chosen": "a", "rejected": "b", "weight": None},  # explicit null: dropped
        {"prompt": "q5", "chosen": "", "rejected": "b"},                 # empty chosen
    ]
    write(tmp_dir, "p.jsonl", "\n".join(json.dumps(x) for x in lines) + "\n")
    t = export.training_rows(readers.preference_dir(spark, tmp_dir))
    got = {r.prompt: (r.chosen, r.rejected, r.weight) for r in t.collect()}
    assert set(got) == {"q1", "q2"}
    assert got["q1"][2] == 0.5 and got["q2"][2] == 1.0 and got["q2"][1] == "[]"
    bad = os.path.join(tmp_dir, "bad")
    write(bad, "x.jsonl", "not json\n{}\n")
    with pytest.raises(ValueError):
        readers.preference_dir(spark, bad)


def test_sinks_roundtrip(spark, tmp_dir):
    df = spark.createDataFrame([("f1", 1, "é"), ("f2", 2, None)], "file_name string, n int, s string")
    out = os.path.join(tmp_dir, "res")
    sinks.write_results(df, out, "org/model")
    back = spark.read.json(out)
    assert back.count() == 2 and set(back.select("run").distinct().first()) == {"org_model"}


def test_generate_batch_failure_isolated(spark):
    def factory():
        def model(prompts):
            if any("boom" in p for p in prompts):
                raise RuntimeError("down")
            return [p.upper() for p in prompts]
        return model

    df = spark.createDataFrame([(i, "boom" if i == 3 else f"t{i}") for i in range(6)], "id int, t string").coalesce(1)
    out = {r.id: (r.raw_response, r.generation_error)
           for r in modelcall.generate(df, "t", factory, batch_size=2).collect()}
    assert out[0] == ("T0", None) and out[2][0] == modelcall.GENERATION_FAILED and out[3][1].startswith("RuntimeError")
    assert out[4] == ("T4", None)


def test_sample_responses(spark):
    df = spark.createDataFrame([(1, "a b c")], "id int, t string")
    r = modelcall.sample_responses(df, "t").first().responses
    assert [(x.response_id, x.temperature) for x in r] == [(1, 0.5), (2, 0.9)]
    assert json.loads(r[0].text)[0]["tag"] == "words3"


def test_judge_call_retries(spark):
    calls = {"n": 0}

    def factory():
        state = {"n": 0}

        def judge(p, a, b):
            state["n"] += 1
            if state["n"] == 1:
                raise TimeoutError("first try fails")
            return {"chosen": 2, "reasoning": "r", "scores": {
                "response1": {"quality": 1, "diversity": 2, "privacy": 3},
                "response2": {"quality": 4, "diversity": 5, "privacy": 6}}}
        return judge

    df = spark.createDataFrame([(1, "p", "a", "b")], "id int, prompt string, response1 string, response2 string")
    r = modelcall.judge_pairs(df, factory, backoff_s=0.0).first()
    assert (r.chosen, r.q2, r.p1) == (2, 4.0, 3.0)
    del calls


def test_embed_tags_unit(spark):
    tags = spark.createDataFrame([("alpha",), ("beta",)], "tag string")
    out = modelcall.embed_tags(tags, lambda: modelcall.hashing_embedder(16)).collect()
    for r in out:
        assert sum(x * x for x in r.vec) == pytest.approx(1.0)


def test_resumable_append_each_key_once(spark, tmp_dir):
    schema = "index bigint, text string"
    src, out, ck = (os.path.join(tmp_dir, x) for x in ("in", "out", "ck"))
    write(src, "a.jsonl", "\n".join(json.dumps({"index": i, "text": f"t{i}"}) for i in [1, 2, 2, 3]) + "\n")
    resume.resumable_append(spark, src, out, ck, schema, "index")
    write(src, "b.jsonl", "\n".join(json.dumps({"index": i, "text": f"t{i}"}) for i in [3, 4, 5]) + "\n")
    resume.resumable_append(spark, src, out, ck, schema, "index")
    got = sorted(r["index"] for r in ledger.results(spark, out, schema).collect())
    assert got == [1, 2, 3, 4, 5]


def test_running_tag_counts(spark, tmp_dir):
    schema = "index bigint, tags array<string>"
    src, ck = os.path.join(tmp_dir, "in"), os.path.join(tmp_dir, "ck")
    write(src, "a.jsonl", json.dumps({"index": 1, "tags": ["x", "y"]}) + "\n" + json.dumps({"index": 2, "tags": ["x"]}) + "\n")

    def rows(df):
        return df.select(F.posexplode("tags").alias("pos", "tag"))

    t = resume.running_tag_counts(spark, src, ck, schema, rows, os.path.join(tmp_dir, "out"))
    assert sorted((r.pos, r.tag, r.n) for r in t.collect()) == [(0, "x", 2), (1, "y", 1)]


def test_judge_input_containers(spark, tmp_dir):
    write(tmp_dir, "a.jsonl", '{"index": 1}\n')
    write(tmp_dir, "b.json", json.dumps({"meta": 1, "results": [{"index": 2}, {"index": 3}]}))
    got = sorted(r[0] for r in readers.judge_input(spark, tmp_dir)
                 .select(F.try_variant_get("v", "$.index", "int")).collect())
    assert got == [1, 2, 3]


def test_report_and_run_record_sinks(spark, tmp_dir):
    rep = spark.createDataFrame([("f", "generated", 0, "a", 2, 100.0)],
                                "file_name string, section string, pos int, tag string, n long, pct double")
    sinks.write_report(rep, os.path.join(tmp_dir, "report"))
    assert spark.read.option("header", "true").csv(os.path.join(tmp_dir, "report")).count() == 1
    run = spark.createDataFrame([("m", 0.4, 0.6)], "model string, before_f1 double, after_f1 double")
    sinks.append_run(run, os.path.join(tmp_dir, "runs"))
    sinks.append_run(run, os.path.join(tmp_dir, "runs"))
    back = spark.read.json(os.path.join(tmp_dir, "runs"))
    assert back.count() == 2 and "recorded_at" in back.columns


def test_responses_from_table(spark):
    recs = spark.createDataFrame([(1, "p1"), (2, "p2")], "index long, prompt string")
    outs = spark.createDataFrame([(1, "[]")], "index long, raw_response string")
    got = {r["index"]: (r.raw_response, r.generation_error)
           for r in modelcall.responses_from_table(recs, outs, "index").collect()}
    assert got == {1: ("[]", None), 2: (modelcall.GENERATION_FAILED, "missing output")}


def test_model_call_query_from_another_directory(tmp_dir):
    """Executors must not need the package on their import path."""
    import subprocess
    import sys as _sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        "import importlib.util\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        f"spec = importlib.util.spec_from_file_location('e', '{root}/__spark_entry__.py')\n"
        "m = importlib.util.module_from_spec(spec); spec.loader.exec_module(m)\n"
        "print(m.queries()['two_temperature_responses'](s, '/root/testdata/sf0.001').count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([_sys.executable, "-c", code], cwd=tmp_dir, env=env, capture_output=True,
                         text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    assert out.stdout.strip().splitlines()[-1] == "400"


def test_resumable_generation_with_model_call(spark, tmp_dir):
    schema = "index bigint, prompt string"
    src, out, ck = (os.path.join(tmp_dir, x) for x in ("in", "out", "ck"))
    write(src, "a.jsonl", "\n".join(json.dumps({"index": i, "prompt": "w " * i}) for i in [1, 2]) + "\n")

    def gen(df):
        return modelcall.sample_responses(df, "prompt")

    resume.resumable_append(spark, src, out, ck, schema, "index", transform=gen)
    write(src, "b.jsonl", "\n".join(json.dumps({"index": i, "prompt": "w " * i}) for i in [2, 3]) + "\n")
    resume.resumable_append(spark, src, out, ck, schema, "index", transform=gen)
    rows = spark.read.json(out).collect()
    assert sorted(r["index"] for r in rows) == [1, 2, 3] and {str(r.ok).lower() for r in rows} == {"true"}
    assert all(len(r.responses) == 2 for r in rows)


def test_rejection_counts_by_reason(spark, tmp_dir):
    lines = [
        {"prompt": "q1", "chosen": "a", "rejected": "b"},
        {"prompt": "", "chosen": "a", "rejected": "b"},
        {"prompt": 5, "chosen": "a", "rejected": "b"},
        {"prompt": "q", "chosen": "", "rejected": "b"},
        {"prompt": "q", "chosen": "a", "rejected": ""},
        {"prompt": "q", "chosen": "a", "rejected": "b", "weight": None},
        {"prompt": "q", "chosen": "a", "rejected": "b", "weight": "heavy"},
        {"prompt": "q", "chosen": "a", "rejected": "b", "weight": "0.5"},
    ]
    write(tmp_dir, "p.jsonl", "\n".join(json.dumps(x) for x in lines) + "\n")
    got = {r.reason: r.n for r in export.rejection_counts(readers.preference_dir(spark, tmp_dir)).collect()}
    assert got == {"ok": 2, "prompt": 2, "chosen": 1, "rejected": 1, "weight": 2}


def test_model_call_survives_failed_task_attempts(tmp_dir):
    """A task that dies on its first attempt is retried; the written output
    holds every row once (task commit keeps only the successful attempt)."""
    import subprocess
    import sys as _sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = os.path.join(tmp_dir, "out")
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark import TaskContext
from pyspark.sql import SparkSession
from tagweave.operators import modelcall
s = SparkSession.builder.master('local[2,4]').config('spark.ui.enabled', 'false').getOrCreate()

def factory():
    if TaskContext.get().attemptNumber() == 0:
        raise RuntimeError('executor lost on first attempt')
    return modelcall.word_count_tagger

df = s.range(0, 200).selectExpr('id', "repeat('w ', cast(id % 7 as int)) as t").repartition(4)
modelcall.generate(df, 't', factory).write.mode('overwrite').json({out!r})
back = s.read.json({out!r})
print(back.count(), back.select('id').distinct().count())
"""
    res = subprocess.run([_sys.executable, "-c", code], cwd=tmp_dir, capture_output=True, text=True, timeout=300)
    assert res.returncode == 0, res.stderr[-2000:]
    assert res.stdout.strip().splitlines()[-1] == "200 200"


def test_running_file_metrics_match_batch(spark, tmp_dir):
    from tagweave.operators import score
    from tagweave.functions.extract import tag_names

    src, ck, out = (os.path.join(tmp_dir, n) for n in ("res", "ck", "out"))
    first = [{"file_name": "f1", "index": 1, "raw_response": '[{"tag":"a","explanation":"x"}]', "gold_names": ["a"]},
             {"file_name": "f1", "index": 2, "raw_response": "Tag: b\nExplanation: y", "gold_names": ["a", "b"]}]
    second = [{"file_name": "f2", "index": 1, "raw_response": "nothing", "gold_names": ["c"]},
              {"file_name": "f1", "index": 3, "raw_response": "[]", "gold_names": []},
              {"file_name": "f2", "index": 2, "raw_response": "x", "gold_names": ["c"], "error": "bad"}]
    write(src, "part-1.json", "\n".join(json.dumps(r) for r in first) + "\n")
    resume.running_file_metrics(spark, src, ck, out)
    write(src, "part-2.json", "\n".join(json.dumps(r) for r in second) + "\n")
    run = {r.file_name: r for r in resume.running_file_metrics(spark, src, ck, out).collect()}
    batch_in = spark.read.schema(resume.RESULT_DDL).json(src)
    b = score.parse_generated(batch_in, "raw_response")
    b = score.with_exact(b.withColumn("pred_names", tag_names(F.col("generated_tags"))), "pred_names", "gold_names")
    batch = {r.file_name: r for r in score.file_metrics(b, semantic=False).collect()}
    assert set(run) == set(batch) == {"f1", "f2"}
    for f in run:
        assert run[f].total_samples == batch[f].total_samples
        assert run[f].exact_match_f1 == pytest.approx(batch[f].exact_match_f1)
        assert run[f].failed_cases_count == batch[f].failed_cases_count


def test_model_steps_hold_one_slice_of_texts_and_keep_other_columns(spark):
    n, big = 2_600, 2**53 + 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    df = spark.range(0, n, 1, 1).select(F.when(F.col("id") % 5 > 0, F.col("id") + big).alias("key"), F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("t"))
    want = [(None if i % 5 == 0 else i + big, None if i % 7 == 0 else str(i)) for i in range(n)]

    def model():
        asked = []

        def answer(prompts, temperature=0.0):
            asked.append(len(prompts))
            return [f"{p or 'none'} {len(prompts)} {len(asked)}" for p in prompts]

        return answer

    for width in (1, 3):
        made = modelcall.generate(df, "t", model, 100, "a", max_in_flight=width)
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1024
        rows = made.collect()
        assert [(r.key, r.t) for r in rows] == want  # a key beside nulls stays exact
        assert [r.a.split()[0] for r in rows] == [t or "none" for _, t in want] and all(r.generation_error is None for r in rows)
        sampled = modelcall.sample_responses(df, "t", model, (0.1, 0.2), 100, max_in_flight=width).collect()
        assert [(r.key, r.t) for r in sampled] == want
        assert all([x.text.split()[0] for x in r.responses] == [r.t or "none"] * 2 and [x.response_id for x in r.responses] == [1, 2] for r in sampled)
    assert [r.responses for r in modelcall.sample_responses(df.limit(2), "t", model, ()).collect()] == [[], []]
    batch = pa.RecordBatch.from_pydict({"t": ["x"] * 1000 + [None]})
    sizes = lambda size: [len(texts) for _, texts in modelcall._texts(iter([batch]), 0, size)]
    assert sizes(8) == [256, 256, 256, 233] and sizes(300) == [300, 300, 300, 101] and sum(sizes(7)) == 1001
    with pytest.raises(ValueError, match="already there"):
        modelcall.generate(df, "t", model, out="key")


def test_evaluation_rows_parse_every_record_once(spark, tmp_dir):
    from tagweave.operators import prompts

    os.makedirs(f"{tmp_dir}/in")
    with open(f"{tmp_dir}/in/a.json", "w") as f:
        f.write("\n".join(json.dumps({"input": f"t, {i}", "parsed_tags": []}) for i in range(5)))
    with open(f"{tmp_dir}/in/b.jsonl", "w") as f:
        f.write(json.dumps({"input": "x"}))
    rows = prompts.inference_text(readers.source_fields(readers.evaluation_rows(spark, f"{tmp_dir}/in")))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 2  # one for each reader, whatever is filtered later
    assert sorted(r.input for r in rows.collect()) == [*(f"t, {i}" for i in range(5)), "x"]


def test_document_buffers_hold_whole_stretches_of_a_range(monkeypatch):
    from tagweave.sources import documents

    monkeypatch.setattr(documents, "BUFFER_BYTES", 10)
    keys = [("f", 0)] * 4 + [("f", 8)] * 2 + [("g", 8)]
    texts = ["aaaa", "", "ééé", "x" * 30, "b", "c", ""]
    batch = lambda i, j: pa.RecordBatch.from_pydict({
        "file_name": [k[0] for k in keys[i:j]], "block": [k[1] for k in keys[i:j]], "value": texts[i:j]})
    for cuts in ([0, 7], [0, 1, 5, 7], [0, 3, 3, 6, 7]):
        found = [(k, list(b)) for k, b in documents._ranges(iter([batch(i, j) for i, j in zip(cuts, cuts[1:])]))]
        assert [(k, b"".join(b)) for k, b in found] == [(("f", 0), "aaaa,,ééé,{},".format("x" * 30).encode()), (("f", 8), b"b,c,"), (("g", 8), b",")]
        assert all(len(x) <= 11 or x.count(b",") == 1 for _, b in found for x in b)
