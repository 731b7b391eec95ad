"""Labelled rows of code, and rows of gates and corrections."""

from pyspark.sql import functions as F

from seamline.functions import prompts as P
from seamline.functions.kernels import labels as K
from seamline.operators import oracle_rows as O
from seamline.operators import training_rows as T


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_token_labels_by_hand():
    body, whole = "    b = a\n    return b", "def f(a):\n    b = a\n    return b"
    text = whole
    starts = [0, 3, 9, 15, 17, 19, 30]  # "def", " f(a):", "\n    b", " =", " a", "\n    return", " b"
    phase, edge, typed, kind, phased, _, counted, condition = K.token_labels(starts, body, 10, whole, 10)
    assert condition == 3 and len(text) == 32
    assert list(phase) == [0, 0, 0, 0, 2, 0, 7] and list(phased) == [0, 0, 0, 0, 1, 0, 1]
    assert list(edge) == list(typed) == list(kind) == [0, 0, 1, 0, 1, 0, 0] and list(counted) == [0, 0, 1, 1, 1, 1, 1]


def test_token_labels_cut_and_empty():
    starts = [0, 3, 9, 15, 17, 19, 30]
    cut = K.token_labels(starts, "    b = a\n    return b", 10, "def f(a):\n    b = a\n    return b", 10, most=5)
    assert [len(a) for a in cut[:7]] == [5] * 7 and list(cut[1]) == [0, 0, 1, 0, 0] and list(cut[4]) == [0, 0, 0, 0, 1] and cut[7] == 3
    assert [len(a) for a in K.token_labels([], "", 0)[:7]] == [0] * 7
    broken = K.token_labels([0, 4], "def (", 0)
    assert not broken[4].any() and not broken[1].any() and broken[6].all()


def test_parts_and_solutions():
    assert K.function_parts('def f(a):\n    "doc"\n    return a\n') == ("def f(a):", "    return a", 'def f(a):\n    "doc"\n    return a', 20)
    assert K.function_parts("def f(a):\n    return 1\ndef g(a):\n    return 1")[0] == "def g(a):"
    assert K.function_parts("x = 1") is None and K.function_parts('def f():\n    "doc"') is None and K.function_parts("") is None
    assert list(K.solutions({"code": "a", "py": ["b", {"solutions": "c"}], "accepted": "d", "java": "e"})) == ["a", "b", "c", "d"]
    deep = "z"
    for _ in range(5000):
        deep = [deep]
    assert list(K.solutions(deep)) == ["z"]


def test_prompts(spark):
    one = lambda c: spark.range(1).select(c.alias("r")).first().r
    nothing = F.lit(None).cast("string")
    assert tuple(one(P.documented_prompt(nothing, F.lit(' a"""b '), F.lit("x\n\n")))) == ('def solve(...):\n    """a\\"\\"\\"b"""\nx', 35)
    lead = "[TASK]\nImplement the requested function.\n[TESTS]\n# Synthetic tests unavailable\n[BEGIN]\n"
    assert tuple(one(P.tested_prompt(nothing, nothing, F.lit("x")))) == (lead + "x", len(lead))
    sectioned = one(P.sectioned_prompt(F.lit("\n"), F.lit("def f():"), F.lit("t\n"), F.lit("c\n")))
    assert tuple(sectioned) == ("[TASK]\n\n[SIGNATURE]\ndef f():\n[PUBLIC_TESTS]\nt\n[CODE]\nc", 8 + 21 + 17 + 7)
    parts = F.array(*map(F.lit, ("if x:\n", " ", "y = 1", "    z = 2\n\n", "w")))
    assert one(P.joined_code(parts)) == "if x:y = 1    z = 2\nw\n" and one(P.joined_code(F.lit(None).cast("array<string>"))) == ""
    assert one(P.bare_checks(F.lit("a\n  check(f)\n  check(1)\n"))) == "a\ncheck(f)\n  check(1)" and one(P.bare_checks(nothing)) == ""
    assert one(P.signature_or_name(F.lit(" "), F.lit("go"))) == "def go(...):" and one(P.signature_or_name(nothing, nothing)) is None
    assert one(P.callable_tests(F.lit("def go(a):"), nothing)).startswith("assert callable(go)\n# Task intent: implement the function\n")
    tests = F.expr("array(named_struct('input', 'a\nb', 'output', '1'), named_struct('input', 'c', 'output', null))")
    assert one(P.numbered_tests(tests)) == "case_1: a\\nb -> 1\ncase_2: c -> "
    assert one(P.token_starts(F.lit("ab  c\nd "))) == [0, 2, 5, 7] and one(P.token_starts(nothing)) == [] and one(P.token_count(F.lit(""))) == 0


SAMPLES = "task_id string, language string, code string, code_text string, segments array<string>, docstring string, signature string, func_name string"


def test_bridge_rows(spark):
    df = spark.createDataFrame([
        ("a", "Python", "def f(x):\n    y = x\n    return y\n", None, None, "do", None, "f"), ("b", "java", "int x;", None, None, None, None, None),
        ("c", None, " ", None, ["x = 1", "y = 2"], None, "def h(a):", None), ("d", None, None, None, None, None, None, None), ("a", "python", "", "z = 1", [], "", "", ""),
    ], SAMPLES)
    made = rows(T.bridge_rows(df))
    assert sorted((r["task_id"], r["source_view"]) for r in made) == sorted((t, v) for t in "aac" for v in (T.DOC_VIEW, T.TEST_VIEW))
    f = next(r for r in made if r["full_function_text"])
    assert f["synthetic_signature"] == "def f(x):" and f["code_text"] == "    y = x\n    return y" and f["serialized_text"].endswith('"""do"""\n    y = x\n    return y')
    assert all(len(r[k]) == len(r["boundary_labels"]) for r in made for k in K.LABELS)
    assert rows(T.bridge_rows(df.limit(0))) == []


def test_other_rows(spark):
    contests = spark.createDataFrame([("t", "add", [("1", "2")], [" ", "print(1)"]), ("u", None, None, None), ("v", None, None, [])], "task_id string, description string, public_tests array<struct<input:string,output:string>>, solutions array<string>")
    (c,) = rows(T.contest_rows(contests))
    assert c["code_text"] == "print(1)" and c["public_test_summary"] == "case_1: 1 -> 2" and c["serialized_text"] == "[TASK]\nadd\n[CODE]\nprint(1)"
    both = spark.createDataFrame([("t", None, "x = 1", None, None, None, None, None, None, None, None, ["y"]), ("u", None, "x = 1", None, None, None, None, None, "", None, None, None)], SAMPLES + ", dataset string, description string, public_tests array<struct<input:string,output:string>>, solutions array<string>")
    assert sorted((r["task_id"], r["code_text"]) for r in rows(T.sample_rows(both))) == [("t", "y"), ("u", "x = 1"), ("u", "x = 1")]
    made = spark.createDataFrame([("p", "twice", "def f(a):", "def f(a):\n    return 2 * a\n")], "task_id string, description string, signature string, code string")
    assert sorted(r["task_id"] for r in rows(T.made_rows(made, 2))) == ["p_0000", "p_0001"] and rows(T.made_rows(made, 0)) == []
    puzzles = spark.createDataFrame([
        ("q", "Python3", "sum", '{"python": [{"code": "def f(a):\\n    return a"}]}', "Easy", ["b", "a"]), ("r", "java", None, "def f(): pass", None, None), ("s", None, None, None, None, None),
    ], "task_id string, language string, description string, solutions string, difficulty string, tags array<string>")
    (q,) = rows(T.puzzle_rows(puzzles))
    assert (q["task_id"], q["code_text"], q["tags"], q["solution_line_count"], q["body_line_count"]) == ("q", "    return a", ["a", "b"], 2, 1)


def test_oracle_documents(spark):
    df = spark.createDataFrame([("a", "gsm8k", "p", "Find the sum:\n2 + 3 = 5\nSo the total is 5."), ("b", None, None, None)], "sample_id string, source_dataset string, prompt_text string, solution_text string")
    a, b = rows(O.oracle_documents(df).orderBy("sample_id"))
    assert len(a["segments"]) == len(a["oracle_block_sizes"]) == len(a["segment_boundary_types"]) == 2 and b["segments"] == [] and b["oracle_block_sizes"] == []
    assert a["oracle_prior_boundary_points"][1] == {"prior_index": 1, "candidate_indices": [0, 1], "candidate_deltas": [-1, 0]}
    (short,) = rows(O.oracle_documents(df.limit(1), most=3))
    assert short["oracle_block_sizes"] == [3] and len(short["segments"]) == 1
    assert [r["sample_id"] for r in rows(O.several_blocks(O.oracle_documents(df)))] == ["a"]


def test_gates_and_corrections(spark):
    df = spark.createDataFrame([("a", None, None, [3, 4], [[0.12345678], [1.0]])], "sample_id string, source_dataset string, has_final_answer_anchor boolean, oracle_block_sizes array<int>, features array<array<double>>")
    gates = rows(O.gate_rows(df.withColumn("scores", F.expr("map(1, named_struct('carry_on', 0.5D, 'carry_off', 0.25D))"))).orderBy("transition_index"))
    assert [(r["gate_target"], r["features"], r["has_final_answer_anchor"]) for r in gates] == [(0, [0.123457], False), (1, [1.0], False)]
    fixes = rows(O.correction_rows(df.withColumn("scores", F.expr("map(0, map(-2, 0.5D, 2, 0.5D, 0, 0.1D))"))).orderBy("boundary_index"))
    assert [(r["best_delta"], r["delta_target"], r["gate_target"], r["source_dataset"]) for r in fixes] == [(-2, 0, 1, "gsm8k"), (0, 2, 0, "gsm8k")]
    scores = spark.createDataFrame([([[0.1, 0.9], [0.5, 0.5], [0.0, 1.0]], [[0.0, 0.0, 0.0, 0.0, 1.0], [1.0, 0.0, 0.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0, 0.0]])], "g array<array<double>>, d array<array<double>>")
    r = scores.select(O.predicted_deltas(F.col("g"), F.col("d")).alias("m"), O.carry_mask(F.col("g")).alias("c")).first()
    assert r.m == {0: 2} and r.c == [1, 0, 1]
