"""File-to-file jobs end to end with stub models."""

import json
import os

import pytest

from tagweave.operators import modelcall
from tagweave.plans import jobs


def write(path, name, text):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w", encoding="utf-8") as f:
        f.write(text)


@pytest.mark.parametrize("semantic", [False, True])
def test_evaluate_files(spark, tmp_dir, semantic):
    def fixed_model():  # defined here so Spark ships it by value to the workers
        return lambda prompts: ['Sure: [{"tag": "words2", "explanation": "e"}]' for _ in prompts]

    data = os.path.join(tmp_dir, "data")
    write(data, "a.jsonl", "\n".join([
        json.dumps({"index": 1, "input": "alpha beta", "parsed_tags": [{"tag": "words2", "explanation": ""}]}),
        json.dumps({"index": 2, "prompt": "one two three", "parsed_tags": [{"tag": "x"}]}),
        json.dumps({"index": 3, "prompt": "p", "parsed_tags": []}),
        "not json",
        json.dumps({"index": 4, "context": "no text"}),
    ]) + "\n")
    write(os.path.join(data, "sub"), "b.json",
          json.dumps([{"index": 1, "input": "a b c d", "context": "ctx", "parsed_tags": ["Words2 "]}]))
    write(os.path.join(data, "sub"), "b.json.bak", json.dumps([{"index": 9, "input": "ignored"}]))
    embed = (lambda t: modelcall.embed_tags(t, lambda: modelcall.hashing_embedder(32))) if semantic else None
    out = jobs.evaluate_files(spark, data, os.path.join(tmp_dir, "out"), fixed_model, run_name="org/m",
                              embed=embed)
    m = {os.path.basename(r.file_name): r for r in out["metrics"].collect()}
    assert (m["a.jsonl"].total_samples, m["a.jsonl"].valid_samples) == (3, 2)
    assert m["a.jsonl"].exact_match_f1 == pytest.approx(0.5)
    assert m["b.json"].exact_match_f1 == pytest.approx(1.0)
    o = out["overall"].first()
    assert o.exact_match_f1 == pytest.approx(0.75) and o.total_samples == 4
    if semantic:
        assert m["a.jsonl"].semantic_accuracy == pytest.approx(0.5)
    assert os.path.isdir(os.path.join(tmp_dir, "out", "results", "run=org_m"))
    assert os.path.isdir(os.path.join(tmp_dir, "out", "summary", "per_file"))


def test_curate_preferences(spark, tmp_dir):
    recs = []
    for i in range(12):
        r1 = json.dumps([{"tag": "Health_Care", "explanation": "x"}, {"tag": f"T{i % 3}", "explanation": "y"}])
        r2 = "```json\n" + json.dumps([{"tag": "Health Care", "explanation": "a b c d e f"}]) + "\n```"
        responses = [{"response_id": 1, "temperature": 0.5, "text": r1}]
        if i % 4:
            responses.append({"response_id": 2, "temperature": 0.9, "text": r2})
        recs.append({"index": i, "prompt": f"prompt {i}", "responses": responses})
    src = os.path.join(tmp_dir, "gen")
    write(src, "g.jsonl", "\n".join(json.dumps(r) for r in recs) + "\n")
    out = jobs.curate_preferences(spark, src, os.path.join(tmp_dir, "pref"), min_privacy=0.0, min_gap=0.0)
    outcomes = {r.outcome: r.n for r in out["outcomes"].collect()}
    assert sum(outcomes.values()) == 9          # 3 records have a single response
    assert out["export"].count() == outcomes.get("kept", 0)
    assert out["filter_stats"].first().original_count == 12


def test_failed_generation_is_still_scored(spark, tmp_dir):
    def flaky():
        def model(prompts):
            if any("boom" in p for p in prompts):
                raise RuntimeError("engine down")
            return ['[{"tag": "ok", "explanation": "e"}]' for _ in prompts]
        return model

    data = os.path.join(tmp_dir, "data")
    write(data, "a.jsonl", "\n".join(json.dumps(x) for x in [
        {"index": 1, "input": "boom", "parsed_tags": [{"tag": "ok"}]},
        {"index": 2, "input": "fine", "parsed_tags": [{"tag": "ok"}], "error": "bad source row"},
    ]) + "\n")
    out = jobs.evaluate_files(spark, data, os.path.join(tmp_dir, "out"), flaky, batch_size=1)
    r = out["results"].where("index = 1").first()
    assert r.raw_response == modelcall.GENERATION_FAILED and r.pred_names == ["General"]
    m = out["metrics"].first()
    assert (m.total_samples, m.valid_samples, m.exact_match_f1) == (1, 1, 0.0)  # the error row is out


def test_cli_evaluate(tmp_dir):
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    data = os.path.join(tmp_dir, "data")
    write(data, "a.jsonl", json.dumps({"index": 1, "input": "alpha beta", "parsed_tags": ["x"]}) + "\n")
    res = subprocess.run([sys.executable, "-m", "tagweave.cli", "evaluate", data, os.path.join(tmp_dir, "out")],
                         cwd=root, capture_output=True, text=True, timeout=300)
    assert res.returncode == 0, res.stderr[-2000:]
    first = json.loads(res.stdout.strip().splitlines()[0])
    assert first["n_files"] == 1 and first["total_samples"] == 1


def test_report_filter_export_jobs(spark, tmp_dir):
    def model():
        return lambda prompts: ['[{"tag":"Legal","explanation":"x"},{"tag":"Question","explanation":"y"}]'
                                for _ in prompts]

    data = os.path.join(tmp_dir, "data")
    write(data, "a.jsonl", "\n".join(json.dumps({"index": i, "input": f"text {i}",
                                                 "parsed_tags": ["legal", "Summary"]}) for i in range(4)) + "\n")
    jobs.evaluate_files(spark, data, os.path.join(tmp_dir, "ev"), model)
    rep = jobs.report_results(spark, os.path.join(tmp_dir, "ev", "results"), os.path.join(tmp_dir, "rep"))
    c = rep["compare"].first()
    assert (c.total_samples, c.partial_matches, c.match_pos0) == (4, 4, 4)
    assert rep["quality"].first().incomplete == 4

    recs = [{"index": i, "prompt": "p", "responses": [
        {"response_id": 1, "text": json.dumps([{"tag": "A" if i else "Z"}])}]} for i in range(5)]
    write(os.path.join(tmp_dir, "gen"), "g.jsonl", "\n".join(json.dumps(r) for r in recs) + "\n")
    f = jobs.filter_generation(spark, os.path.join(tmp_dir, "gen"), os.path.join(tmp_dir, "flt"))
    assert f["stats"].first().kept_count == 4

    cur = jobs.curate_preferences(spark, os.path.join(tmp_dir, "gen"), os.path.join(tmp_dir, "cur"))
    ex = jobs.export_annotated(spark, os.path.join(tmp_dir, "cur", "preferences"),
                               os.path.join(tmp_dir, "ppo"), "ppo")
    assert ex.count() == cur["export"].count()
