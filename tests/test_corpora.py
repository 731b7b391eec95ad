"""Corpus preparation and completions."""

import pytest
from pyspark.sql import functions as F

from seamline.functions.kernels import completions as K
from seamline.operators import corpora

PYTHON = "def f(xs):\n    total = 0\n    for x in xs:\n        total += x\n    if total < 0:\n        total = 0\n    return total\n"


def test_code_corpus(spark):
    rows = [("python", "r", "p", "f", PYTHON, "doc", "train"), ("python", "r", "p", "g", " ", None, "train"), ("python", "r", "p", "h", PYTHON, "", None), ("python", "r", "p", "i", "x = 1", None, "valid")]
    df = spark.createDataFrame(rows, "language string, repo string, path string, func_name string, code string, docstring string, split string")
    kept, counts = corpora.code_corpus(df)
    assert [(r.func_name, r.segmentation_method, r.has_docstring) for r in kept.collect()] == [("f", "ast", True)]
    assert {r.reason: r.n for r in counts.collect()} == {"kept": 1, "missing_code": 1, "missing_split": 1, "not_segmented": 1}


def test_other_corpora(spark):
    docs = spark.createDataFrame([("gum", "dev", "d", [["Hi", "!"], ["It", "'s"]])], "source string, split string, doc_id string, tokens array<array<string>>")
    assert corpora.token_corpus(docs).first().segments == ["Hi!", "It's"]
    books = spark.createDataFrame([("n", True, ["markdown", "code", "code"], ["# t\n", " ", "x = 1"]), ("m", True, ["code"], ["y"]), ("b", False, [], [])], "notebook_path string, valid boolean, cell_types array<string>, cell_texts array<string>")
    got = corpora.notebook_corpus(books, True).collect()
    assert [r.segments for r in got] == [["[markdown]\n# t", "[code]\nx = 1"]]
    rows = [("a", ["t"], "First x = 1. Then y = 2. So z = 3.", "f", ["simp"]), ("b", [], "Short one", "f", ["simp"]), ("c", [], "None", "f", [])]
    st = spark.createDataFrame(rows, "split string, tags array<string>, natural_language_statement string, formal_statement string, proof array<string>")
    kept, reasons = corpora.filtered_statements(st)
    assert [r.split for r in kept.collect()] == ["a"]
    assert {r.selection_reason: r.n for r in reasons.collect()} == {"statement_reasoning": 1, "statement_too_shallow": 1, "missing_proof": 1}
    assert corpora.statement_corpus(st, formal=True).where("lean_split = 'b'").first().segments == ["Short one", "f", "simp"]


def test_unions(spark):
    pools = {n: spark.range(k).withColumn("v", F.lit(n)) for n, k in (("gum", 4), ("juice", 3))}
    got = corpora.balanced_union(pools, {"train": 1, "valid": 1, "test": 1})
    assert sorted((r.source_dataset, r.split) for r in got.collect()) == sorted((n, s) for n in pools for s in ("train", "valid", "test"))
    with pytest.raises(ValueError):
        corpora.balanced_union(pools, {"train": 1}, 4)
    s = spark.createDataFrame([("t",)], "task_id string")
    assert sorted(r.task_id for r in corpora.repeated_samples(s, s, 2).collect()) == ["t", "t_0000", "t_0001"]
    r = spark.createDataFrame([("a", [3, 3, 3])], "k string, nfe array<int>")
    assert [(x.generated_length, x.selected_block_length) for x in corpora.fixed_blocks(r, "k", 16, 40, "nfe").collect()] == [(0, 16), (16, 16), (32, 8)]


def test_completions(spark):
    assert K.completion("class Solution:\n    def add(self, a: int, b=1) -> int:\n        return a + b\n") == ("def add(a: int, b=1) -> int:", "    return a + b")
    assert K.completion("def f():\n    print(1)") is None and K.completion("def f(:") is None and K.completion("") is None
    assert K.largest_completion('def a():\n    return 1\n\ndef b(x):\n    """d"""\n    y = x\n    return y\n') == ("def b(x):", "    y = x\n    return y")
    assert "solve_io" in K.wrapped("x = input()\nif __name__ == '__main__':\n    print(x)") and "__main__" not in K.wrapped("if __name__ == '__main__':\n    pass")
    assert K.without_echo("def f():\n    return 1", "def f():\n") == "    return 1"
    assert K.normalized_completion("```python\nreturn 1\n```", "def f():\n") == "    return 1"
    assert K.indented_body("x = 1\n    return x") == "    x = 1\n    return x"
    assert K.with_imports("x = math.pi\ny = Counter()") == "import math\nfrom collections import Counter\nx = math.pi\ny = Counter()"
    assert K.closed("return (1)") and not K.closed("return (1")
    df = spark.createDataFrame([(PYTHON,), (None,)], "c string").select(K.completions(F.col("c")).alias("r")).collect()
    assert df[0].r.signature == "def f(xs):" and df[1].r.signature is None
