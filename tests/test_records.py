"""Predicates, summaries, records and LaTeX answers."""

import pytest
from pyspark.sql import functions as F

from seamline.functions import answers as M
from seamline.functions import records as R
from seamline.operators import predicates as P
from seamline.operators import summaries as S


def one(spark, column):
    return spark.range(1).select(column.alias("r")).first().r


def test_classifiers(spark):
    assert one(spark, P.failure_type(F.lit("x AssertionError TypeError"), F.lit(""))) == "AssertionError"
    assert one(spark, P.failure_type(F.lit("KeyError"), F.lit(""))) == "RuntimeError"
    assert one(spark, P.failure_type(F.lit(None).cast("string"), F.lit("To solve this problem"))) == "PromptLeakage"
    assert one(spark, P.hard_cluster(F.lit("def a(): def b():"), F.lit(""), F.lit(""))) == "helper_definition"
    assert one(spark, P.hard_cluster(F.lit("return str(x)"), F.lit(""), F.lit(""))) == "return_shaping"
    assert one(spark, P.hard_cluster(F.lit("x"), F.lit("swap them"), F.lit("f(a, b)"))) == "signature_order"
    assert one(spark, P.task_categories(F.lit("Sort the WORDS of a list"))) == ["string", "list_tuple_set", "sort"]
    reasons = [(["p"], ["a", "b", "c"], [], "statement_reasoning"), ([" "], ["a"], [], "missing_proof"), (["p"], ["a"], ["e"], "explanatory_proof"), (["p"], ["a"], [], "statement_too_shallow"), (["p"], ["42"], None, "statement_reasoning")]
    df = spark.createDataFrame(reasons, "p array<string>, s array<string>, e array<string>, want string")
    assert all(r.want == r.got for r in df.select("want", P.math_keep_reason(F.col("p"), F.col("s"), F.col("e")).alias("got")).collect())
    assert one(spark, P.docstring_like(F.lit('\n  """doc"""'))) == "docstring_like" and one(spark, P.docstring_like(F.lit("x = 1"))) is None


def test_published_summaries(spark):
    docs = spark.createDataFrame([([5, 3], True), ([4], False)], "s array<int>, a boolean")
    got = S.document_summary(docs, "s", F.col("a")).first()
    assert (got.avg_block_length, got.avg_block_count, got.coverage_rate, got.anchor_rate) == (4.0, 1.5, 0.5, 0.5)
    assert {r.blocks: r.n for r in S.block_histogram(docs, "s").collect()} == {1: 1, 2: 1}
    runs = spark.createDataFrame([(True, [2, 1], [5, 3]), (False, [4], [4])], "ok boolean, nfe array<int>, b array<int>")
    got = S.generation_summary(runs, "ok", "nfe", "b").first()
    assert (got.exact_match, got.avg_nfe, got.avg_blocks, got.avg_block_length) == (0.5, 3.5, 1.5, 4.0)
    labels = spark.createDataFrame([([1, 0, 1], [1, 1, 0]), ([0], None)], "l array<int>, m array<int>")
    assert S.labelled_summary(labels, "l", "m").first().masked_positive_rate == pytest.approx(1 / 3)
    assert S.labelled_summary(labels, "l").first().positive_rate == 0.5
    changes = S.pass_changes(spark.createDataFrame([(True, False), (False, True), (None, True)], "o boolean, n boolean"), "o", "n").first()
    assert (changes.rescued, changes.regressed) == (2, 1)
    totals = {r.s: r.accuracy for r in S.subset_scores(spark.createDataFrame([("a", True), ("a", False), ("b", True)], "s string, ok boolean"), "s", "ok").collect()}
    assert totals["a"] == 0.5 and totals[None] == pytest.approx(2 / 3)
    assert S.subset_range(spark.createDataFrame([], "i int"), "i").first().least == -1


def test_records(spark):
    payload = spark.createDataFrame([({"HumanEval ": {"Pass@1": 0.4, "other": 1.0}},), ({"x": {"a": 1.0}},), ({"humaneval": {"my_pass_at_1_x": 0.2}},)], "p map<string,map<string,double>>")
    assert [r.m for r in payload.select(R.metric_or_missing(F.lit(None).cast("double"), [F.col("p")], ["humaneval"]).alias("m")).collect()] == [0.4, -1.0, 0.2]
    chat = spark.createDataFrame([([("User", None, "a", None), (None, "human", None, " b "), ("assistant", None, "c", None), ("user", None, " ", None)],)], "m array<struct<role:string,`from`:string,content:string,value:string>>")
    assert chat.select(R.last_text(F.col("m"), ["user", "human"]).alias("t")).first().t == "b"
    assert one(spark, R.delta_scores(F.create_map(F.lit("-1"), F.lit(0.5)))) == {-1: 0.5}
    with pytest.raises(Exception, match="finite"):
        one(spark, R.delta_scores(F.create_map(F.lit("x"), F.lit(0.5))))
    assert one(spark, R.delta_class(F.lit(-2))) == 0 and one(spark, R.confidence_weight(F.lit("gold"))) == 1.0
    s = one(spark, R.sections([("Task", F.lit("do it")), ("None", F.lit(" ")), ("Code", F.lit("x = 1"))]))
    assert s.text[s.starts[0] : s.ends[0]] == "do it" and s.text[s.starts[2] : s.ends[2]] == "x = 1" and s.starts[1] == -1
    span = one(spark, R.token_span(F.array(*map(F.lit, (3, 6, 10))), F.lit(4), F.lit(7)))
    assert (span["first"], span["last"]) == (1, 3)
    assert one(spark, R.confident_transfer(F.array(F.lit(0.1), F.lit(0.3)), F.lit(0.9))) == [0, 1]
    assert one(spark, R.ranked_transfer(F.array(F.lit(0.99), F.lit(0.2), F.lit(0.9)), 1.0)) == [1, 0, 1]
    assert one(spark, R.progress_stage(F.lit(0.2))) == "stage_b" and one(spark, R.teacher_forcing(F.lit(0.55))) == pytest.approx(0.5)
    assert one(spark, R.degraded_length(F.lit(9), "oversegment", 4, F.lit(0), F.lit(20), F.lit(16), F.lit(0.0))) == 2
    assert one(spark, P.cache_mode(F.lit(True), F.lit(False), F.lit(3))) == "prefix_cache_min_blocks_3"


def test_latex(spark):
    cases = {"\\frac12": "\\frac{1}{2}", "\\tfrac1{20}": "\\frac{1}{20}", "1/2": "\\frac{1}{2}", "01/2": "01/2", "\\sqrt3": "\\sqrt{3}", "x = 5": "5", ".5": "\\frac{1}{2}", "5\\text{ cm}": "5", "50\\%": "50", "\\left( 1 \\right)": "(1)"}
    df = spark.createDataFrame(list(cases.items()), "a string, b string").select("a", "b", M.canonical_latex(F.col("a")).alias("c"))
    assert {r.a: r.c for r in df.collect()} == cases
    assert one(spark, M.same_latex(F.lit(None).cast("string"), F.lit(None).cast("string"))) is True
