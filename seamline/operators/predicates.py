"""Row classifiers: kinds of documents, failure types, clusters, categories, routes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seamline.functions.text import is_final_answer, lines, strip, truth

#: Words and patterns of the classifiers, in the order in which they are tried.
FAILURES = (
    ("AssertionError", ("AssertionError",)), ("TypeError", ("TypeError",)), ("NameError", ("NameError",)), ("SyntaxError", ("SyntaxError",)),
    ("IndentationError", ("IndentationError",)), ("RuntimeError", ("ValueError", "IndexError", "KeyError")),
)
LEAKS = ("to solve this problem", "to implement the function", "fix =", "add more test cases")
CLUSTERS = (
    ("normalization_sorting", ("sorted(", ".sort(", "strip()", "lower()", "upper()")),
    ("state_update", ("+=", "-=", "append(", "update(", "extend(", "best =", "ans =")),
)
SHAPING = ("join(", "format(", "tuple(", "list(", "str(")
ORDER_WORDS = ("order", "position", "first", "second", "swap")
CATEGORIES = {
    "regex": r"regex|regular expression",
    "string": r"string|substring|character|word|sentence|vowel|consonant",
    "list_tuple_set": r"list|array|tuple|set|similar|common elements",
    "sort": r"sort|ascending|descending",
    "math": r"prime|factorial|divisor|number|integer|sum|product|power|square|cube|multiple|decimal|binary",
    "counter_heap": r"frequency|common|counter|heap|largest items",
}
HARD = ("helper_definition", "normalization_sorting", "state_update", "return_shaping", "signature_order")


def holds_any(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def failure_type(stderr: Column, code: Column) -> Column:
    e, c = F.coalesce(stderr, F.lit("")), F.lower(F.coalesce(code, F.lit("")))
    chain = None
    for name, words in FAILURES:
        chain = F.when(holds_any(e, words), name) if chain is None else chain.when(holds_any(e, words), name)
    return chain.when(holds_any(c, LEAKS), "PromptLeakage").otherwise("UnknownError")


def hard_cluster(code: Column, task: Column, signature: Column) -> Column:
    c, t, s = F.coalesce(code, F.lit("")), F.lower(F.coalesce(task, F.lit(""))), F.lower(F.coalesce(signature, F.lit("")))
    chain = F.when(F.regexp_count(c, F.lit("def ")) > 1, "helper_definition")
    for name, words in CLUSTERS:
        chain = chain.when(holds_any(c, words), name)
    shaped = F.contains(c, F.lit("return ")) & holds_any(c, SHAPING)
    ordered = F.contains(s, F.lit(",")) & holds_any(t, ORDER_WORDS)
    return chain.when(shaped, "return_shaping").when(ordered, "signature_order").otherwise("general")


def is_hard(cluster: Column) -> Column:
    return cluster.isin(*HARD)


def task_categories(text: Column) -> Column:
    """All categories whose pattern is found, in order."""
    t = F.coalesce(text, F.lit(""))
    return F.filter(F.array(*[F.when(t.rlike(f"(?i){p}"), n) for n, p in CATEGORIES.items()]), lambda x: x.isNotNull())


def is_code_completion(task_id: Column, has_entry: Column, has_tests: Column) -> Column:
    """By id prefix, or by which fields a document has."""
    return F.startswith(F.lower(F.coalesce(task_id, F.lit(""))), F.lit("humaneval")) | has_entry | has_tests


def is_test_list_task(task_id: Column, has_tests: Column) -> Column:
    return ~F.startswith(F.lower(F.coalesce(task_id, F.lit(""))), F.lit("humaneval")) & has_tests


def is_marked_answer(question: Column, answer: Column) -> Column:
    return question.isNotNull() & F.coalesce(F.contains(answer, F.lit("####")), F.lit(False))


def uses_chat_template(instruct: Column, completion: Column) -> Column:
    return instruct & ~completion


def wanted_language(domain: Column, language: Column) -> Column:
    """Code corpora must say the language; contest rows may leave it out."""
    said = F.lower(strip(F.coalesce(language, F.lit(""))))
    return F.when(F.lower(domain) == "codecontests", said.isin("", "python", "python3", "py")).when(F.lower(domain) == "codesearchnet", said == "python").otherwise(F.lit(True))


def math_keep_reason(proof: Column, statement_segments: Column, explanatory: Column, least: int = 3) -> Column:
    """Why a statement is kept (statement_reasoning, explanatory_proof) or dropped (missing_proof, statement_too_shallow)."""
    steps = F.filter(proof, lambda p: strip(p) != "")
    stated = (F.size(statement_segments) >= least) | F.exists(statement_segments, lambda s: is_final_answer(s))
    return (
        F.when(F.coalesce(F.size(steps), F.lit(0)) <= 0, "missing_proof").when(stated, "statement_reasoning")
        .when(F.coalesce(F.size(explanatory), F.lit(0)) > 0, "explanatory_proof").otherwise("statement_too_shallow")
    )


def is_kept(reason: Column) -> Column:
    return reason.isin("statement_reasoning", "explanatory_proof")


def docstring_like(segment: Column) -> Column:
    """"docstring_like" for segments that begin with a triple quote, else null."""
    first = F.get(F.filter(F.transform(lines(segment), strip), lambda x: x != ""), 0)
    return F.when(first.rlike(r"""(?i)\A[rubf]{0,2}("{3}|'{3})"""), "docstring_like")


def saves_step(step: Column, every: int | None, steps: list[int]) -> Column:
    """Whether a checkpoint is saved at a step: one of the list, or a multiple of the interval."""
    listed = step.isin(*steps) if steps else F.lit(False)
    return (step > 0) & (listed | (step % every == 0 if every else F.lit(False)))


def cache_mode(use: Column, dual: Column, least: Column) -> Column:
    """Name of a cache mode, with the least number of blocks where one is asked for."""
    base = F.when(dual, "dual_cache").when(use, "prefix_cache").otherwise("no_cache")
    return F.when(use & (least > 0), F.concat(base, F.lit("_min_blocks_"), least.cast("string"))).otherwise(base)


def uses_cache(use: Column, blocks: Column, least: int) -> Column:
    return use & (F.lit(least <= 0) | (F.coalesce(F.size(blocks), F.lit(0)) >= least))


def as_bool(c: Column) -> Column:
    return truth(c)


def cuts_accepted(index: Column) -> Column:
    """An event cut a block itself if it names a boundary index."""
    return index.isNotNull()
