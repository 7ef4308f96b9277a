"""Edges that no table reaches: odd files, missing vectors, odd model replies."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tagweave import cli
from tagweave.functions.extract import balanced_prefix, tag_object_spans
from tagweave.operators import freq, modelcall, prompts, report, score, split
from tagweave.plans import jobs
from tagweave.sources import readers, sinks
from tagweave.streaming import ledger


def write(path, name, text):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w", encoding="utf-8") as f:
        f.write(text)


def ints(rows, field="index"):
    return sorted(r[0] for r in rows.select(F.try_variant_get("v", f"$.{field}", "int")).collect())


def test_repeated_keys_nan_and_rejects(spark, tmp_dir):
    write(tmp_dir, "a.jsonl", '{"index": 1, "index": 2}\n{"index": 3, "x": NaN}\n{"index": 4, "y": -Infinity}\nbad\n\n{}\n[1]\n')
    assert ints(readers.tolerant_jsonl(spark, tmp_dir)) == [2, 3, 4]
    got = {r.reason: r.n for r in readers.jsonl_rejects(spark, tmp_dir).collect()}
    assert got == {"invalid": 1, "blank": 1, "empty_object": 1, "not_object": 1}


def test_own_output_is_read_back(spark, tmp_dir):
    sinks.write_jsonl(spark.createDataFrame([(i, "p") for i in range(3)], "index int, prompt string"), tmp_dir)
    assert ints(readers.evaluation_rows(spark, tmp_dir)) == [0, 1, 2]
    pref = os.path.join(tmp_dir, "pref")
    sinks.write_jsonl(spark.createDataFrame([("p", "c", "r")], "prompt string, chosen string, rejected string"), pref)
    assert readers.preference_dir(spark, pref).count() == 1


def odd_value(rng, depth=0):
    kind = rng.random()
    if depth > 2 or kind < 0.3:
        return rng.choice(["a,b", 'x"y', "\\", '\\"', ",", "[", "]", "{}", "\U0001f600", "", 5, -1.5, None, True])
    if kind < 0.65:
        return {rng.choice(["k", '"q', "[z", ",c"]): odd_value(rng, depth + 1) for _ in range(rng.randint(0, 4))}
    return [odd_value(rng, depth + 1) for _ in range(rng.randint(0, 4))]


def test_documents_are_cut_at_any_byte(spark, tmp_dir):
    """Lists, objects and lines, read in ranges of 64 bytes as in one range; (block, row) is the file's order."""
    import random

    rng = random.Random(3)
    wanted = {}
    for i in range(6):
        wanted[f"l{i}.json"] = [("item", odd_value(rng)) for _ in range(rng.randint(0, 40))]
        text = json.dumps([v for _, v in wanted[f"l{i}.json"]], ensure_ascii=bool(i % 2), indent=[None, 1][i % 2])
        write(tmp_dir, f"l{i}.json", ("\ufeff" if i == 0 else "") + text)
    one = {f"k{j}": odd_value(rng) for j in range(15)}
    write(tmp_dir, "o.json", json.dumps(one, indent=2))
    wanted["o.json"] = [("value", one)]
    lines = [{"k": odd_value(rng)} for _ in range(8)]
    for name, between in (("n.json", "\n"), ("m.json", " ")):
        write(tmp_dir, name, between.join(map(json.dumps, lines)))
        wanted[name] = [("line", x) for x in lines]
    bad = {"b1.json": "[1, 2", "b2.json": "[1,]", "b3.json": "[1 2]", "b4.json": "{oops", "b5.json": "[1] x", "b6.json": '{"a":1},{"b":2}'}
    for name, text in {**bad, "e1.json": "[]", "e2.json": "  ", "e3.json": "", "s.json": '["\\ud800", 2, 3]'}.items():
        write(tmp_dir, name, text)
    setting = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(setting), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("64", "100000000"):
            spark.conf.set(setting, size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            found = {}
            rows = readers.document_rows(spark, tmp_dir).select("file_name", "kind", F.to_json("v").alias("v"), "pos")
            for r in sorted(rows.collect(), key=lambda r: (r.file_name, r.pos.block, r.pos.row if r.pos.row is not None else 1 << 60)):
                found.setdefault(r.file_name.rpartition("/")[2], []).append((r.kind, None if r.v is None else json.loads(r.v)))
            assert {n: found.get(n, []) for n in wanted} == wanted
            assert all(found[n][-1][0] == "error" for n in bad) and not {"e1.json", "e2.json", "e3.json"} & set(found)
            assert [k for k, _ in found["s.json"]] == ["item"] * 3 and found["s.json"][1:] == [("item", 2), ("item", 3)]
    finally:
        spark.conf.set(setting, before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_one_list_is_read_by_many_tasks(spark, tmp_dir):
    row = {"index": 1, "text": "x, y" * 25_000}
    write(tmp_dir, "big.json", "[" + ",\n".join(json.dumps(row | {"index": i}) for i in range(60)) + "]")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        rows = readers.json_documents(spark, tmp_dir, position=True)
        found = rows.select(F.try_variant_get("v", "$.index", "int").alias("i"), "pos").collect()
        assert [r.i for r in sorted(found, key=lambda r: (r.pos.block, r.pos.row))] == list(range(60))
        assert len({r.pos.block for r in found}) >= 5  # one file, several ranges
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_container_rows_unwrap_documents_only(spark, tmp_dir):
    write(tmp_dir, "a.json", json.dumps([{"index": 1, "items": [1, 2]}, {"index": 2, "items": [3, 4]}]))
    write(tmp_dir, "b.json", json.dumps({"items": [{"index": 3}]}))
    assert ints(readers.judge_input(spark, tmp_dir)) == [1, 2, 3]
    write(tmp_dir, "c.json", json.dumps({"meta": 1}))
    with pytest.raises(Exception, match="no list in the document"):
        readers.judge_input(spark, tmp_dir).collect()


def test_present_error_key_counts(spark, tmp_dir):
    write(tmp_dir, "a.jsonl", '{"index": 1, "error": null}\n{"index": 2}\n')
    got = {r["index"]: r.error for r in readers.source_fields(readers.tolerant_jsonl(spark, tmp_dir)).collect()}
    assert got == {1: "null", 2: None}


def test_names_without_vectors_count(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c", "d"], ["a"]), (2, ["x"], ["x"]), (3, ["x"], ["y"])],
                               "k int, gold array<string>, pred array<string>")
    known = spark.createDataFrame([("a", [1.0, 0.0])], "tag string, vec array<double>")
    for rows in (10, 0):  # broadcast and shuffle joins
        v = score.attach_grid(df, lambda t: t.join(known, "tag"), "k", "gold", "pred", max_broadcast_rows=rows)
        s = {r.k: r for r in score.with_semantic_grid(v, "gold", "pred").collect()}
        assert s[1].semantic_accuracy == 0.25 and s[1].semantic_precision == 1.0 and s[1].grid == [[1.0], [0.0], [0.0], [0.0]]
        assert s[2].semantic_accuracy == 0.0 and s[2].sft_semantic_f1 == 1.0 and s[3].sft_semantic_f1 == 0.0
    empty = spark.createDataFrame([(1, [], []), (2, ["a"], []), (3, None, ["a"])], "k int, gold array<string>, pred array<string>")
    v = score.attach_grid(empty, lambda t: t.join(known, "tag"), "k", "gold", "pred")
    assert {r.k: r.semantic_accuracy for r in score.with_semantic_grid(v.where("k < 3"), "gold", "pred").collect()} == {1: 1.0, 2: 0.0}
    assert v.count() == 3


def yes(prompts):
    return ['[{"tag": "a", "explanation": "e"}]' for _ in prompts]


def test_evaluation_run_twice_and_missing_index(spark, tmp_dir):
    data, out = os.path.join(tmp_dir, "data"), os.path.join(tmp_dir, "out")
    write(data, "a.jsonl", "\n".join(json.dumps({"input": t, "parsed_tags": [{"tag": g}]}) for t, g in (("one", "a"), ("two", "b"))) + "\n")

    def model():
        return lambda prompts: ['[{"tag": "a", "explanation": "e"}]' for _ in prompts]

    embed = lambda t: modelcall.embed_tags(t, lambda: modelcall.hashing_embedder(32))
    for _ in range(2):
        r = jobs.evaluate_files(spark, data, out, model, embed=embed)
    m = r["metrics"].collect()
    assert len(m) == 1 and m[0].total_samples == 2
    assert sorted(x.semantic_accuracy for x in r["results"].collect()) == [0.0, 1.0]
    cases = spark.read.json(os.path.join(out, "failed_cases")).collect()
    assert len(cases) == 1 and cases[0].best_matches[0].gold_tag == "b" and cases[0].best_matches[0].pred_tag == "a"


def test_short_and_odd_replies(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(3)], "k int, p string").coalesce(1)
    got = [r.raw_response for r in modelcall.generate(df, "p", lambda: lambda ps: ["ok"]).collect()]
    assert got == ["ok", "Generation failed", "Generation failed"]
    s = modelcall.sample_responses(df, "p", lambda: lambda ps, t: ["ok"], temperatures=(0.1,)).collect()
    assert [r.responses[0].error for r in s] == [None, "no output for this prompt", "no output for this prompt"]
    pairs = spark.createDataFrame([("p", "a", "b")] * 4, "prompt string, response1 string, response2 string").coalesce(1)

    def judge():
        replies = iter([{"chosen": "A"}, {"chosen": "2", "scores": {"response1": {"quality": "7.5"}}},
                        {"chosen": 1, "scores": "none", "reasoning": 5}, {"chosen": 3}])
        return lambda p, a, b: next(replies)

    rows = modelcall.judge_pairs(pairs, judge).collect()
    assert [r.chosen for r in rows] == [None, 2, 1, None] and rows[1].q1 == 7.5 and rows[2].q1 is None and rows[2].reasoning == "5"


def test_generation_records(spark):
    df = spark.createDataFrame([(1, "good"), (2, "bad")], "index int, p string").coalesce(1)

    def factory():
        def model(ps, t):
            if "bad" in ps:
                raise RuntimeError("down")
            return ["[]" for _ in ps]
        return model

    s = modelcall.sample_responses(df, "p", factory, batch_size=1)
    got = {r["index"]: r for r in modelcall.generation_records(s, ["index", "p"], "p", "m").collect()}
    assert got[1].error is None and got[1].metadata.model == "m" and json.loads(got[1].original_data) == {"index": 1, "p": "good"}
    assert got[2].error == "RuntimeError: down" and got[2].responses is None and got[2].tagging_prompt is None


def test_curation_resumes(spark, tmp_dir):
    src, out = os.path.join(tmp_dir, "gen"), os.path.join(tmp_dir, "out")
    tags = json.dumps([{"tag": "T", "explanation": "x"}])

    def rec(i):
        return json.dumps({"index": i, "prompt": f"p{i}", "responses": [{"response_id": k, "temperature": 0.5, "text": tags} for k in (1, 2)]})

    def judge(reason):
        def factory():
            return lambda p, a, b: {"chosen": 1, "reasoning": reason, "scores": {
                "response1": {"quality": 8, "diversity": 9, "privacy": 9}, "response2": {"quality": 5, "diversity": 4, "privacy": 8}}}
        return factory

    write(src, "a.jsonl", "\n".join(map(rec, range(3))) + "\n")
    jobs.curate_preferences(spark, src, out, judge("first"))
    write(src, "b.jsonl", "\n".join(map(rec, range(3, 5))) + "\n")
    jobs.curate_preferences(spark, src, out, judge("second"))
    rows = spark.read.json(os.path.join(out, "preferences")).collect()
    assert {r["index"]: r.reasoning for r in rows} == {0: "first", 1: "first", 2: "first", 3: "second", 4: "second"}


def test_a_ledger_out_of_reach_is_an_error(spark, tmp_dir):
    ids = spark.createDataFrame([("a",)], "id string")
    assert ledger.KeyLedger(spark, os.path.join(tmp_dir, "none")).known(ids, "b").count() == 0
    with pytest.raises(Exception):
        ledger.KeyLedger(spark, "nosuchscheme://host/path")


def test_sft_target_keeps_lists_and_keys(spark):
    rows = ['["a","b"]', "[{'tag': 'x', 'note': 'n', 'explanation': 'e'}]", '{"tag": "x", "extra": 1}', "plain", "[1, 2"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "s string").coalesce(1).select(prompts.sft_target(F.col("s"), "")).collect()]
    assert [json.loads(g) for g in got] == [["a", "b"], [{"tag": "x", "note": "n", "explanation": "e"}], [{"tag": "x", "extra": 1}], ["plain"], ["[1, 2"]]
    assert list(json.loads(got[1])[0]) == ["tag", "note", "explanation"]


def test_hash_split_of_any_keys(spark):
    wide = spark.range(2000).select((F.col("id") * 1000).alias("k"))
    huge = spark.createDataFrame([(9 * 10**15 + i,) for i in range(200)], "k long")
    words = spark.createDataFrame([(f"key{i}",) for i in range(200)], "k string")
    for df in (wide, huge, words):
        n = df.count()
        assert 0.7 * n < split.hash_split(df, "k", 0.2).where("split = 'train'").count() < 0.9 * n
    one, two = ({r.k for r in split.seeded_sample(wide, "k", 50, seed).collect()} for seed in (0, 1))
    assert len(one & two) < 25


def test_reports_of_stored_elements(spark):
    df = spark.sql("""SELECT 'f' AS file_name, try_variant_get(parse_json('[{"tag":"a"},"b",3,{"x":1}]'), '$', 'array<variant>') AS tags""")
    got = sorted((r.pos, r.tag) for r in report.positional_tags(df, {"gen": "tags"}).where("pos >= 0").collect())
    assert got == [(0, "a"), (1, "b"), (2, "3"), (3, '{"x":1}')]
    c = spark.createDataFrame([("f", ["a"], [], 1, 2), ("f", ["a"], ["a"], 1, 1)], "file_name string, g array<string>, t array<string>, n int, m int")
    c = c.withColumn("gl", F.array_repeat("n", F.col("n"))).withColumn("tl", F.array_repeat("m", F.col("m")))
    r = report.position_compare(c, "g", "t", gen_list="gl", gold_list="tl").first()
    assert r.exact_matches == 2 and r.rate_pos0 == 50.0


def test_sft_scans_are_right_on_long_texts(spark):
    text = 'x { {"tag": {"a": 1}} } [' * 4000 + '{"tag":"open'
    df = spark.createDataFrame([(text,), ("{}",), (None,)], "t string")
    spans = df.select(tag_object_spans(F.col("t")).alias("s")).collect()
    assert spans[0].s == ['{"tag": {"a": 1}}'] * 4000 and spans[1].s == []
    assert spark.createDataFrame([("[a [b] c] rest",), ("[[x]",)], "t string").coalesce(1).select(balanced_prefix(F.col("t")).alias("b")).collect() == [("[a [b] c]",), (None,)]


def test_filter_stats_parts(spark):
    from tagweave.operators.parse import clean_responses

    recs = spark.createDataFrame([(i, [(1, 0.5, json.dumps([{"tag": f"T{i}", "explanation": "x"}]))]) for i in range(60)],
                                 "index long, responses array<struct<response_id:int,temperature:double,text:string>>")
    f = freq.rare_filter(clean_responses(recs))
    assert f["first_removed"].count() == 50 and f["first_reasons"].count() == 20 and f["settings"].first().min_freq == 2
    # beyond the broadcast bound the anti join is a shuffle join with the same rows
    assert freq.rare_filter(clean_responses(recs), max_broadcast_rows=0)["kept"].count() == f["kept"].count()


def test_submitted_master_is_kept(monkeypatch):
    from tagweave import session

    seen = {}

    class Builder:
        def appName(self, _):
            return self

        def config(self, k, v):
            seen[k] = v
            return self

        def master(self, m):
            seen["master"] = m
            return self

        def getOrCreate(self):
            raise InterruptedError

    monkeypatch.setattr(session.SparkSession, "builder", Builder())
    with pytest.raises(InterruptedError):
        cli.main(["--checkpoint-dir", "hdfs://shared/ck", "report", "in", "out"])
    assert "master" not in seen and seen["spark.checkpoint.dir"] == "hdfs://shared/ck"
