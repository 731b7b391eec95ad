"""Native expressions against plain Python, and the kernels."""

import random
import re

import pytest
from pyspark.sql import functions as F

from seamline.functions import answers as M
from seamline.functions import arrays as A
from seamline.functions import text as X
from seamline.functions import maths as native_maths
from seamline.functions.kernels import code, maths, phases
from tests import plain_maths

ALPHABET = list("ab  AZ19.,:;!?\n\t$\\(){}=+-") + ["\u00a0", "é", "😀", "\r\n", "\n\n", "Then ", "so ", "= 3", "answer: "]


def texts(n=150, seed=5):
    r = random.Random(seed)
    return ["", " ", "\n"] + ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 25))) for _ in range(n)]


def apply(spark, expression, values, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    got = spark.createDataFrame(rows, f"i int, v {kind}").select("i", expression(F.col("v")).alias("r")).collect()
    return [r.r for r in sorted(got, key=lambda r: r.i)]


@pytest.mark.parametrize(("native", "plain"), [
    (X.normalize_newlines, plain_maths.unix), (X.strip, str.strip),
    (X.normalize_whitespace, lambda t: re.sub(r"[ \t]+", " ", plain_maths.unix(t)).strip()),
    (X.normalize_math_paragraph, plain_maths.squeezed), (X.is_final_answer, plain_maths.final_answer), (X.is_math_structure, plain_maths.structure),
    (X.is_reasoning_step, plain_maths.step), (X.reasoning_clauses, lambda t: [p for p in plain_maths.clauses(t)]),
    (X.sentences_of_paragraph, lambda t: plain_maths.parts_of(plain_maths.SENTENCE, t)), (X.nonblank_lines, lambda t: sum(bool(x.strip()) for x in t.split("\n"))),
    (X.csv_set, lambda t: list(dict.fromkeys(x.strip().lower() for x in t.split(",") if x.strip()))),
])
def test_native_equals_plain(spark, native, plain):
    values = texts()
    assert apply(spark, lambda c: native(c), values) == [plain(v) for v in values]


def test_running_sums(spark):
    r = random.Random(2)
    values = [[], [5], [r.randint(-3, 9) for _ in range(64)], [r.randint(0, 9) for _ in range(1000)], None]
    got = apply(spark, A.running_sums, values, "array<int>")
    for v, g in zip(values, got, strict=True):
        assert g == (None if v is None else [sum(v[: i + 1]) for i in range(len(v))]) or (v is None and g in (None, []))


def test_labels_and_transitions(spark):
    assert apply(spark, lambda c: A.segment_labels(c, F.lit(1)), [[2, 3, 1], [], [1]], "array<int>") == [[0, 1, 0, 0, 0, 1, 0, 1], [], [1]]
    assert apply(spark, lambda c: A.segment_labels(c, F.lit(0), False), [[2, 1]], "array<int>") == [[0, 1, 0]]
    assert apply(spark, lambda c: A.positions_to_labels(F.lit(4), c), [[1, 9], None], "array<int>") == [[0, 1, 0, 0], [0, 0, 0, 0]]
    got = apply(spark, lambda c: A.transitions(c, F.array(F.lit(1), F.lit(0), F.lit(1))), [[1, 1, 2]], "array<int>")[0]
    assert [(x.target, x.mask) for x in got] == [(0, 0), (1, 0), (0, 0)]


def test_choices(spark):
    scores = [[0.2, 0.9, 0.9, 0.1], [0.1], []]
    got = apply(spark, lambda c: A.scheduled_length(c, F.lit(3), F.lit(0.5)), scores, "array<double>")
    assert [(g.length, g["index"]) for g in got] == [(2, 1), (3, None), (3, None)]
    assert apply(spark, lambda c: A.window_length(c, F.lit(2), F.lit(0.5)), [[0.1, 0.2, 0.9], [0.1]], "array<double>") == [2, 2]
    assert apply(spark, lambda c: A.candidate_length(c, F.array(*map(F.lit, (4, 8, 16))), F.lit(5), F.lit(0.5)), [[0.6, 0.7, 0.7], [0.1, 0.1, 0.1]], "array<double>") == [8, 5]
    assert apply(spark, A.best_delta, [{-2: 0.5, 1: 0.5, -1: 0.5, 2: 0.1}, {0: 1.0}], "map<int,double>") == [-1, 0]
    assert apply(spark, lambda c: A.delta_candidates(F.lit(8), c, F.lit(10)), [[-9, 0, 4, 2]], "array<int>") == [[1, 8, 10]]
    assert apply(spark, lambda c: A.budget_lengths(c, F.lit(10)), [[4, 5, 3, 2], [20]], "array<int>") == [[4, 5, 1], [10]]
    assert apply(spark, lambda c: A.generation_budget(c, F.lit(7)), [[2, -1, 3], [9], []], "array<int>") == [5, 7, 7]
    assert apply(spark, lambda c: A.even_parts(c, F.lit(3)), [7, 2], "int") == [[3, 2, 2], [1, 1, 0]]
    assert apply(spark, lambda c: A.window_mean(c, F.lit(1), F.lit(3)), [[1.0, 2.0, 4.0, 8.0], [5.0]], "array<double>") == [3.0, 5.0]


def test_answers(spark):
    values = ["so #### 7", "it is $1,234.", "a 5 then 6!", "no", "", "#### -3.50 and 9", None]
    assert apply(spark, M.gsm8k_answer, values) == ["7", "1234", "6", None, None, "-3.50", None]
    tails = ["We get 5.\nTherefore x is 12\nok", "First 3. Then 4 apples.", "text\n$42", "nothing", "Answer: 7 and 8"]
    assert apply(spark, M.tail_candidate, tails) == ["12", "4", "42", None, "8"]
    assert apply(spark, lambda c: M.with_landing(c, F.lit("x #### 1")), ["it is so.\nAnswer: 9 ", "#### 3", "none"]) == ["it is so.\nAnswer: 9\n#### 9", "#### 3", "none"]
    boxed = ["\\boxed{1} and \\boxed{\\frac{2}{3}} x", "\\boxed 5$ y", "open \\boxed{1", "none"]
    assert apply(spark, M.last_boxed, boxed) == ["\\frac{2}{3}", "5", None, None]
    pairs = [("\\boxed{1/2}", "\\boxed{\\frac{1}{2}}", True), ("0.5", "\\boxed{1/2}", True), ("3", "4", False), ("1/0", "1/0", True), (None, "1", False)]
    df = spark.createDataFrame(pairs, "g string, p string, want boolean").select("want", M.math_correct(F.col("g"), F.col("p")).alias("got"))
    assert all(r.want == r.got for r in df.collect())
    margins = spark.createDataFrame([(7.0, 7.0), (7.0, 8.0), (7.0, 70.0), (7.0, None)], "g double, p double").select(M.margin_score(F.col("g"), F.col("p")).alias("s"))
    s = [r.s for r in margins.collect()]
    assert s[0] == 1.0 > s[1] > s[2] > s[3] == 0.0


def test_small_text_functions(spark):
    assert apply(spark, X.human_size, [0, 1023, 1024, 5 * 1024**4, 5000 * 1024**4], "long") == ["0.00 B", "1023.00 B", "1.00 KB", "5.00 TB", "5000.00 TB"]
    assert apply(spark, X.step_of_path, ["x/boundary_head_step_000120.pt", "y.pt"]) == [120, None]
    assert apply(spark, X.step_list, ["[3, 1|3]", ""]) == [[1, 3], []]
    assert apply(spark, X.longest_fenced_block, ["```python\na\n``` x ```\nlonger\n```", " plain "]) == ["longer", "plain"]
    assert apply(spark, X.strip_html, ["<p>a &lt; b</p><br/>c<pre>d</pre>", None]) == ["a < b\nc\nd", None]
    assert apply(spark, lambda c: X.cut_at_stops(c, ["\nclass", "\ndef"]), ["x\ndef y\nclass z", "a  "]) == ["x", "a"]
    assert apply(spark, X.normalize_state_label, ["how many the apples are in box.", " "]) == ["apples in box", None]


def test_boundary_types(spark):
    rows = [("codesearchnet", ["Adds numbers.", "def f(): pass"], True), ("proofnet", ["Let x be.", "so x = 3"], False), ("juice", ["42", "import os"], False), ("gum", ["Answer: 4"], None)]
    df = spark.createDataFrame(rows, "source string, segments array<string>, doc boolean")
    got = [r.t for r in df.select(X.boundary_types(F.col("segments"), F.col("source"), F.lit(None).cast("array<string>"), F.col("doc")).alias("t")).collect()]
    assert got == [
        [["internal_step_boundary"], ["safe_commit_boundary"]], [["internal_step_boundary"], ["final_answer_anchor"]],
        [["final_answer_anchor"], ["safe_commit_boundary"]], [["internal_step_boundary", "final_answer_anchor"]],
    ]


PYTHON = 'def total(xs):\n    """Sum."""\n    values = list(xs)\n    out = 0\n    for v in values:\n        out += v\n    if out < 0:\n        out = 0\n    return out\n'


def test_code_segments():
    method, quality, parts = code.segment_code("python", PYTHON)
    assert (method, quality) == ("ast", "high") and parts[0] == "def total(xs):" and not any('"""' in p for p in parts)
    assert code.segment_code("python", "x = 1") is None and code.segment_code("python", "") is None
    assert code.without_docstrings('"""a\nb"""\nx = """in"""\n') == 'x = """in"""'
    method, _, parts = code.segment_code("javascript", "function add(a, b) {\n  const t = a + b;\n  if (t > 10) {\n    return 10;\n  }\n  return t;\n}\n")
    assert method == "heuristic" and len(parts) >= 2
    assert code.fewer([f"line {i}" for i in range(60)], 48)[0] == "line 0"
    assert len(code.fewer([f"line {i}" for i in range(60)], 48)) == 48
    assert code.longest_valid("garbage (\nx = 1\ny = 2\n)") == "x = 1\ny = 2"
    assert code.needed_definitions("import os\ndef a():\n    return b()\ndef b():\n    return 1\ndef c():\n    return 2\n", "a").count("def ") == 2
    assert code.function_body("def f():\n    return 1\n", "f") == "    return 1" and code.function_body("x", "f") is None


def test_phases():
    spans, edges = phases.label(PYTHON)
    assert [s[0] for s in spans] == ["signature_or_doc", "normalize", "init_state", "enumerate_or_iterate", "update_state", "check_or_verify", "init_state", "return_emit"]
    assert [e[1] for e in edges] == ["phase_change", "phase_change", "phase_change", "phase_change", "block_exit_to_return"]
    assert phases.label("def broken(:\n return") == ([("return_emit", 0, 20, "ignore")], [])
    assert phases.label(" \n") == ([], [])
    assert [s[1:3] for s in phases.label("s = 'é😀'; t = int(s)")[0]][-1] == (10, 20)


BITS = [
    "$$", "$", "\\[", "\\]", "\\begin{align}", "\\end{align}", "\\begin{a} x", "Then", "thus,", "So that:", "x = 3", "We have 2+2=4. Then it is 5", "No step here, so maybe not",
    "a, which is 3 = 3", "Next b", "$$ Next we see. $$ A b", "$$(x) y", "end. $$ Then $$Q", "\n", "\n \n", " ", "#### 5", "Answer: 4", "\\boxed{3}", "i.e. A", "Hence 3 > 2 Therefore 4",
    "\x0b", "\u2028", "  tail  ", "Finally", "\r\n", "{1}", "\\end{b}", "\u00e9: Ok", "12",
]


def test_math_segments(spark):
    r = random.Random(8)
    values = ["".join(r.choice(BITS) + r.choice(["", " ", "\n", "\n", "\n\n"]) for _ in range(r.randrange(1, 14))) for _ in range(2_000)]
    values += ["", None, " \n ", "$$\na\n$$", "$$", "First a. Then b = 2.\n\nTherefore\n\nx = 3", "x = 1\n" * 20_000]
    got = apply(spark, native_maths.math_segments, values)
    assert got == [[] if v is None else plain_maths.segment_math(v) for v in values]
    assert got[-2] == ["First a.", "Then b = 2.", "Therefore\nx = 3"] and got[-4] == ["$$\na\n$$"]


def test_step_predicates_of_kernels():
    for v in texts(600):
        assert maths.final_answer(v) == plain_maths.final_answer(v) and maths.step(v) == plain_maths.step(v), v


def test_detokenize():
    assert maths.detokenize(["Hello", ",", "world", "(", "it", "'s", "fine", ")", "."]) == "Hello, world (it's fine)."


def test_documents_as_mathematical_prose(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", native_maths.math_segments(F.col("text")).alias("s")).collect()
    assert all(r.s == plain_maths.segment_math(r.text or "") for r in docs)
