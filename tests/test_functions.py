"""Unit goldens for the column functions (edge cases of FIXTURES B4)."""

import json

import pytest
from pyspark.sql import functions as F

from tagweave.functions import metrics as M
from tagweave.functions.extract import extract_tags_eval, extract_tags_sft, line_fallback
from tagweave.functions.jsonparse import lenient_value, strict_list, strict_valid
from tagweave.functions.text import normalize_tag, strip_ws, truncate_head_tail


def one(spark, expr, rows, schema="t string"):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(expr).collect()]


def test_normalize_tag(spark):
    got = one(spark, normalize_tag(F.col("t")), [("MachineLearning",), ("AI_Ethics",), ("NLP",),
                                                  ("code - review / QA",), (None,), ("  x  ",)])
    assert got == ["Machine Learning", "A I Ethics", "N L P", "code-review/Q A", None, "x"]


def test_normalize_idempotent(spark):
    import random

    rnd = random.Random(7)
    alphabet = "aB_ -/\tCxY z"
    rows = [("".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 12))),) for _ in range(400)]
    df = spark.createDataFrame(rows, "t string").select(normalize_tag(F.col("t")).alias("a"))
    bad = df.where(normalize_tag(F.col("a")) != F.col("a")).count()
    assert bad == 0


def test_strip_unicode_whitespace(spark):
    assert one(spark, strip_ws(F.col("t")), [("  a \t\n",)]) == ["a"]


def test_lenient_json(spark):
    rows = [('```json\n[{"tag":"A"}]\n```',), ("[1] junk",), ('[{"tag":"A"},"p"]',), ("{'a':1}",)]
    df = spark.createDataFrame(rows, "t string").select(
        F.try_variant_get(lenient_value(F.col("t")), "$", "array<variant>").alias("l"))
    got = [None if r.l is None else len(r.l) for r in df.collect()]
    assert got == [1, None, 2, None]


def test_strict_rejects_trailing_junk(spark):
    rows = [("[1,2]",), ("[1,2] x",), ("1],[2",), ("[1,]",), (None,)]
    assert one(spark, strict_valid(F.col("t")), rows) == [True, False, False, False, False]
    assert one(spark, strict_list(F.col("t")).isNotNull(), [('{"a":1}',)]) == [False]


def test_extract_eval_stages(spark):
    rows = [
        ('text [{"tag":"A","explanation":"x"}] more',),          # list
        ('[bad] {"tag": "B", "explanation": "y"}',),             # last list fails, then objects
        ("Tag: C\nExplanation: z\nTag: D\nfree text",),          # line scan
        ("nothing here",),                                       # default
        ('[{"tag":"A"}]',),                                      # list without explanation: final, empty
        (None,),
    ]
    df = spark.createDataFrame(rows, "t string").select(extract_tags_eval(F.col("t")).alias("r"))
    out = [(r.r.stage, [(x.tag, x.explanation) for x in r.r.tags]) for r in df.collect()]
    assert out == [
        ("list", [("A", "x")]),
        ("object", [("B", "y")]),
        ("lines", [("C", "z"), ("D", "free text")]),
        ("default", [("General", "Unable to parse")]),
        ("list", []),
        ("error", []),
    ]


def test_bracket_inside_string_truncates(spark):
    # A ']' inside a string ends the non-greedy match; that match is not JSON.
    df = spark.createDataFrame([('[{"tag":"a]b","explanation":"e"}]',)], "t string")
    r = df.select(extract_tags_eval(F.col("t")).alias("r")).first().r
    assert r.stage == "object" and [(x.tag, x.explanation) for x in r.tags] == [("a]b", "e")]


def test_line_fallback_quotes(spark):
    df = spark.createDataFrame([('Tag: "Q"\nExplanation: it\'s',)], "t string")
    got = df.select(line_fallback(F.col("t")).alias("l")).first().l
    assert [(x.tag, x.explanation) for x in got] == [("Q", "its")]


def test_extract_sft(spark):
    rows = [('[{"tag":"A","explanation":"x"}]',),
            ('[{"tag":"A","explanation":"x"}] tail',),      # balanced prefix parses
            ('[{"tag":"A" oops] tail',),                   # balanced prefix fails -> empty
            ('say {"tag": "B", "explanation": "y"} ok',),
            ("no tags",)]
    df = spark.createDataFrame(rows, "t string").select(extract_tags_sft(F.col("t")).alias("r"))
    out = [[(x.tag, x.explanation) for x in r.r] for r in df.collect()]
    assert out == [[("A", "x")], [("A", "x")], [], [("B", "y")], []]


@pytest.mark.parametrize("pred,gold,normalise,f1", [
    ([], [], True, 1.0), (["a"], [], True, 0.0), (["a", "a", "b"], ["a"], True, 2 / 3),
    ([" A "], ["a"], True, 1.0), ([" A "], ["a"], False, 0.0),
])
def test_exact_f1(spark, pred, gold, normalise, f1):
    df = spark.createDataFrame([(pred, gold)], "p array<string>, g array<string>")
    got = df.select(M.exact_prf(F.col("p"), F.col("g"), normalise).alias("s")).first().s
    assert got.f1 == pytest.approx(f1)


def test_exact_f1_symmetric(spark):
    import random

    rnd = random.Random(3)
    rows = [([rnd.choice("abcd") for _ in range(rnd.randint(0, 4))],
             [rnd.choice("abcd") for _ in range(rnd.randint(0, 4))]) for _ in range(200)]
    df = spark.createDataFrame(rows, "p array<string>, g array<string>")
    d = df.select(M.exact_prf(F.col("p"), F.col("g"))["f1"].alias("x"),
                  M.exact_prf(F.col("g"), F.col("p"))["f1"].alias("y"))
    assert d.where(F.abs(F.col("x") - F.col("y")) > 1e-12).count() == 0


def test_semantic_both_empty(spark):
    df = spark.createDataFrame([([], [])], "g array<struct<tag:string,vec:array<double>>>, "
                                           "p array<struct<tag:string,vec:array<double>>>")
    s = df.select(M.semantic_scores(F.col("g"), F.col("p"), 0.8).alias("s")).first().s
    assert (s.accuracy, s.f1, s.sft_f1) == (1.0, 0.0, 1.0)


def test_semantic_grid_and_best_match(spark):
    e1, e2 = [1.0, 0.0], [0.0, 1.0]
    g = [("g1", e1), ("g2", e2)]
    p = [("p1", [0.6, 0.8]), ("p2", e1)]
    schema = "g array<struct<tag:string,vec:array<double>>>, p array<struct<tag:string,vec:array<double>>>"
    df = spark.createDataFrame([(g, p)], schema)
    s = df.select(M.semantic_scores(F.col("g"), F.col("p"), 0.8).alias("s")).first().s
    # g1 matches p2 (1.0 > 0.8); g2 vs p1 is exactly 0.8: not > 0.8, but >= 0.8.
    assert s.accuracy == 0.5 and s.recall == 0.5 and s.precision == 0.5
    assert s.sft_f1 == 1.0
    bm = df.select(M.best_matches(F.col("g"), F.col("p")).alias("b")).first().b
    assert [(x.gold_tag, x.pred_tag) for x in bm] == [("g1", "p2"), ("g2", "p1")]


def test_truncate_head_tail(spark):
    text = " ".join(f"w{i}" for i in range(10))
    got = one(spark, truncate_head_tail(F.col("t"), 4), [(text,), ("a b",)])
    assert got[0] == "w0 w1\n\n[Content truncated]\n\nw8 w9"
    assert got[1] == "a b"


def test_weight_and_reward(spark):
    from tagweave.operators import export

    df = spark.createDataFrame([("p", "c", "r", 5.0, 9.0, 7.0, 8.0, 5.0, 10.0)],
                               "prompt string, chosen string, rejected string, diversity_gap double, "
                               "privacy_chosen double, privacy_rejected double, quality_chosen double, "
                               "diversity_chosen double, privacy_chosen2 double")
    w = export.dpo_weighted(df).first()
    assert w.weight == pytest.approx(0.38)
    r = export.ppo(df.drop("privacy_chosen").withColumnRenamed("privacy_chosen2", "privacy_chosen")).first()
    assert r.reward == pytest.approx(0.4)
    with pytest.raises(ValueError):
        export.export(df, "nope")


def test_tags_to_json(spark):
    from tagweave.operators.export import tags_to_json

    rows = [('"already text"',), ('[{"tag":"a"},"b",3]',), ('null',), ('{"x":1}',)]
    df = spark.createDataFrame(rows, "j string").select(tags_to_json(F.parse_json(F.col("j"))).alias("o"))
    got = [r.o for r in df.collect()]
    assert got[0] == "already text"
    assert json.loads(got[1]) == [{"tag": "a", "explanation": ""}, {"tag": "b", "explanation": ""}]
    assert got[2] == "None"
    assert got[3] == '{"x":1}'
    missing = spark.createDataFrame([(1,)], "a int").select(tags_to_json(F.lit(None).cast("variant")).alias("o"))
    assert missing.first().o == "[]"


def test_scale_conf():
    from tagweave.session import scale_conf

    c = scale_conf(100 * (1 << 40), 8000)
    assert int(c["spark.sql.shuffle.partitions"]) == 100_000          # capped
    assert scale_conf(1 << 40, 8000)["spark.sql.shuffle.partitions"] == "16000"   # two waves
    assert scale_conf(1 << 20, 8)["spark.sql.shuffle.partitions"] == "16"


def test_sft_target(spark):
    from tagweave.operators.prompts import sft_target

    rows = [("[{'tag': 'a', 'explanation': 'x'}]",), ('{"tag": "b", "explanation": "y"}',), ("plain words",)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(sft_target(F.col("s"))).collect()]
    assert got == ['[{"tag":"a","explanation":"x"}] <eos>', '[{"tag":"b","explanation":"y"}] <eos>',
                   '["plain words"] <eos>']


def test_truncation_keeps_line_breaks(spark):
    text = "a b\nc d e\n\nf g h\ni j"
    got = one(spark, truncate_head_tail(F.col("t"), 4), [(text,)])[0]
    assert got == "a b\n\n[Content truncated]\n\ni j"
    got6 = one(spark, truncate_head_tail(F.col("t"), 6), [(text,)])[0]
    assert got6 == "a b\nc\n\n[Content truncated]\n\nh\ni j"


def test_cap_tokens(spark):
    from tagweave.functions.text import cap_tokens

    got = one(spark, cap_tokens(F.col("t"), 3), [("a\nb  c d e",), ("x y",)])
    assert got == ["a\nb  c", "x y"]


def test_extract_sft_nested_objects(spark):
    rows = [('note {"tag": "a", "explanation": "x", "meta": {"k": 1}} and {"tag": "b", "explanation": "y", '
             '"more": {"z": {"w": 2}}} end',),
            ('{"tag": "open", "explanation": {"never": "closed"',)]
    df = spark.createDataFrame(rows, "t string").select(extract_tags_sft(F.col("t")).alias("r"))
    out = [[(x.tag, x.explanation) for x in r.r] for r in df.collect()]
    assert out == [[("a", "x"), ("b", "y")], []]


def test_cuts_of_long_and_odd_texts(spark):
    """No regular expression that recurses or scans a run again: long texts, long runs of white space."""
    from tagweave.functions.text import cap_tokens, truncate_head_tail

    texts = ["  a b\n\nc  d ", "", "   ", "w " * 50_000, "a" + " " * 300_000 + "b c d", "\n a" + "\t" * 200_000, "\u00e9 b c d e f"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    rows = df.select("i", cap_tokens(F.col("t"), 2).alias("cap"), truncate_head_tail(F.col("t"), 2).alias("cut")).collect()
    marker = "\n\n[Content truncated]\n\n"
    for r in rows:
        t, words = texts[r.i], texts[r.i].split()
        if len(words) <= 2:
            assert r.cap == r.cut == t
            continue
        second = t.index(words[1], t.index(words[0]) + len(words[0])) + len(words[1])
        assert r.cap == t[:second]
        assert r.cut == t[:t.index(words[0]) + len(words[0])] + marker + t[t.rindex(words[-1]):]
    long = spark.createDataFrame([("word " * 100_000,)], "t string").select(F.length(cap_tokens(F.col("t"), 50_000)).alias("n"))
    assert long.first().n == 5 * 50_000 - 1
