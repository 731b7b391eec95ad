"""Labelled training rows of code: prompts by source, labels of tokens, and what is told about each row.

A tokenizer is a function of a text column that gives the places where tokens begin. Every builder works
row by row; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.functions import prompts as P
from seamline.functions.arrays import empty
from seamline.functions.kernels import labels as K
from seamline.functions.text import is_blank
from seamline.operators.predicates import hard_cluster

Tokens = Callable[[Column], Column]
#: Names of sources and views.
CONTEST, SEARCH, MADE, PUZZLE = "codecontests", "codesearchnet", "synthetic_nonhe", "leetcode"
CONTEST_VIEW, DOC_VIEW, TEST_VIEW, PUZZLE_VIEW = "contest_description_only", "codesearchnet_humaneval_bridge", "codesearchnet_mbpp_bridge", "leetcode_code_bridge"
NO_PUZZLE = "Implement the requested LeetCode function."


def labelled(df: DataFrame, tokens: Tokens = P.token_starts, most: int = 4096) -> DataFrame:
    """Rows with ``serialized_text``, ``code_text``, ``code_start``, ``annotated``, ``annotated_start``, with the labels of their tokens.

    ``annotated`` is the text that phases are told by, the code where it is null. Without text there are no
    tokens, and all labels are empty.
    """
    placed = df.withColumn("token_starts", tokens(F.col("serialized_text")).cast("array<int>"))
    return K.with_labels(placed, "token_starts", "code_text", "code_start", "annotated", "annotated_start", most)


def described(df: DataFrame, prompt: Column, source: str, view: str, task: Column, given: Column) -> DataFrame:
    """``df`` (with ``code_text`` and ``task_id``) with its prompt and what holds for all of its rows."""
    return df.withColumn("prompt", prompt).withColumns({
        "serialized_text": F.col("prompt.text"), "code_start": F.col("prompt.code_start"), "source_domain": F.lit(source),
        "source_view": F.lit(view), "label_confidence": F.lit("silver"), "condition_mask": F.lit(0), "task_description": task,
        "synthetic_signature": given.cast("string"), "hard_mining_cluster": hard_cluster(F.col("code_text"), task, given),
    }).drop("prompt")


def with_code(df: DataFrame) -> DataFrame:
    """Rows in Python, or of no stated language, that have code: the field code, else code_text, else joined segments."""
    code = F.coalesce(*[F.when(~is_blank(c), c) for c in (F.col("code"), F.col("code_text"))], P.joined_code(F.col("segments")))
    spoken = F.lower(F.coalesce("language", F.lit("")))
    return df.withColumn("source_code", code).where(spoken.isin("", "python")).where(~is_blank(F.col("source_code")))


def own_columns(df: DataFrame, task: Column, given: Column, code: Column, annotated: Column, annotated_start: Column) -> DataFrame:
    return df.select(
        F.col("task_id"), task.alias("task"), given.alias("given"), code.alias("code_text"), annotated.cast("string").alias("annotated"),
        annotated_start.cast("int").alias("annotated_start"),
    )


def documented_rows(df: DataFrame, tokens: Tokens = P.token_starts, most: int = 4096) -> DataFrame:
    """The body of the longest function after its signature and doc; code without a function is taken whole.

    ``df``: task_id, language, code, code_text, segments, docstring, signature, func_name. A given signature
    holds unless it has an ellipsis.
    """
    told = P.signature_or_name(F.col("signature"), F.col("func_name"))
    df = with_code(df).withColumn("parts", K.parts(F.col("source_code"))).withColumn("told", told)
    found = F.col("parts.body").isNotNull()
    given = F.when(found & (F.col("told").isNull() | F.contains("told", F.lit("..."))), F.col("parts.signature")).otherwise(F.col("told"))
    rows = own_columns(df, F.coalesce("docstring", F.lit("")), given, F.coalesce("parts.body", "source_code"), F.col("parts.function"), F.coalesce("parts.body_start", F.lit(0)))
    prompt = P.documented_prompt(F.col("given"), F.col("task"), F.col("code_text"))
    whole = rows.withColumn("full_function_text", F.col("annotated"))
    return labelled(described(whole, prompt, SEARCH, DOC_VIEW, F.col("task"), F.col("given")).drop("task", "given"), tokens, most)


def tested_rows(df: DataFrame, tokens: Tokens = P.token_starts, most: int = 4096) -> DataFrame:
    """Whole code after the task and stand-in tests; columns as for ``documented_rows``."""
    rows = own_columns(with_code(df), F.coalesce("docstring", F.lit("")), P.signature_or_name(F.col("signature"), F.col("func_name")), F.col("source_code"), F.lit(None), F.lit(0))
    prompt = P.tested_prompt(F.col("task"), P.callable_tests(F.col("given"), F.col("task")), F.col("code_text"))
    none = rows.withColumn("full_function_text", F.lit(None).cast("string"))
    return labelled(described(none, prompt, SEARCH, TEST_VIEW, F.col("task"), F.col("given")).drop("task", "given"), tokens, most)


def bridge_rows(df: DataFrame, tokens: Tokens = P.token_starts, most: int = 4096) -> DataFrame:
    """Both views of every sample."""
    return documented_rows(df, tokens, most).unionByName(tested_rows(df, tokens, most))


def contest_rows(df: DataFrame, tokens: Tokens = P.token_starts, most: int = 4096) -> DataFrame:
    """One row a task: its first solution that is not blank, after the description; tasks without one give none.

    Tests are summed up in a column and are no part of the prompt.

    ``df``: task_id, description, public_tests (structs input, output), solutions.
    """
    first = F.get(F.filter("solutions", lambda s: F.trim(s) != ""), 0)
    rows = df.select(
        "task_id", F.coalesce("description", F.lit("")).alias("task"), first.alias("code_text"), P.numbered_tests(F.col("public_tests")).alias("public_test_summary"),
        F.lit(None).cast("string").alias("annotated"), F.lit(0).alias("annotated_start"),
    ).where(F.col("code_text").isNotNull())
    none = F.lit(None).cast("string")
    prompt = P.sectioned_prompt(F.col("task"), none, none, F.col("code_text"))
    return labelled(described(rows, prompt, CONTEST, CONTEST_VIEW, F.col("task"), F.lit(None).cast("string")).drop("task"), tokens, most)


def sample_rows(df: DataFrame, tokens: Tokens = P.token_starts, most: int = 4096) -> DataFrame:
    """Rows of samples of both kinds: contests by name (``dataset``) or by having tests or solutions, else both views of the code.

    ``df`` has the columns of ``documented_rows`` and ``contest_rows``.
    """
    contest = F.contains(F.lower(F.coalesce("dataset", F.lit(""))), F.lit("contest")) | F.col("public_tests").isNotNull() | F.col("solutions").isNotNull()
    return contest_rows(df.where(contest), tokens, most).unionByName(bridge_rows(df.where(~contest), tokens, most), allowMissingColumns=True)


def made_rows(df: DataFrame, repeats: int, tokens: Tokens = P.token_starts, most: int = 4096) -> DataFrame:
    """Samples (task_id, description, signature, code) repeated, with numbered ids."""
    numbered = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))) if repeats > 0 else df.withColumn("repeat", F.lit(0)).limit(0)
    df = numbered.withColumn("parts", K.parts(F.rtrim("code")))
    rows = df.select(
        F.format_string("%s_%04d", "task_id", "repeat").alias("task_id"), F.col("task_id").alias("targeted_pattern"), F.col("description").alias("task"),
        F.col("signature").alias("given"), F.coalesce("parts.body", F.rtrim("code")).alias("code_text"), F.col("parts.function").alias("annotated"),
        F.coalesce("parts.body_start", F.lit(0)).alias("annotated_start"),
    )
    prompt = P.documented_prompt(F.col("given"), F.col("task"), F.col("code_text"))
    return labelled(described(rows, prompt, MADE, PUZZLE_VIEW, F.col("task"), F.col("given")).drop("task", "given"), tokens, most)


def puzzle_rows(df: DataFrame, tokens: Tokens = P.token_starts, most: int = 4096) -> DataFrame:
    """The first nested solution that has a function, as body after signature and doc; tasks without one give none.

    ``df``: task_id, language, description, solutions (JSON of any depth), difficulty, tags.
    """
    spoken = F.lower(F.coalesce("language", F.lit("")))
    held = df.where((spoken == "") | F.contains(spoken, F.lit("python")))
    codes = held.withColumn("codes", K.nested_solutions(F.col("solutions"))).withColumn("code", F.get(F.filter("codes", lambda c: F.contains(c, F.lit("def "))), 0))
    found = codes.withColumn("parts", K.parts(F.col("code"))).where("parts.body is not null")
    lines = lambda c: F.size(F.filter(F.split(c, "\n"), lambda x: F.trim(x) != ""))
    rows = found.select(
        "task_id", P.filled_or(F.col("description"), NO_PUZZLE).alias("task"), F.col("parts.signature").alias("given"), F.col("parts.body").alias("code_text"),
        F.col("parts.function").alias("annotated"), F.col("parts.body_start").alias("annotated_start"), "difficulty", F.sort_array(F.coalesce("tags", empty("string"))).alias("tags"),
        lines(F.col("parts.function")).alias("solution_line_count"), lines(F.col("parts.body")).alias("body_line_count"),
    )
    prompt = P.documented_prompt(F.col("given"), F.col("task"), F.col("code_text"))
    return labelled(described(rows, prompt, PUZZLE, PUZZLE_VIEW, F.col("task"), F.col("given")).drop("task", "given"), tokens, most)
