"""Documents of a mathematics evaluation: sampled tasks, worked examples that no task overlaps, prompts, blocks; and their records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.functions.answers import gsm8k_correct, last_boxed, math_correct
from seamline.functions.arrays import empty, generation_budget, total
from seamline.functions.prompts import token_count
from seamline.functions.records import count_of
from seamline.functions.text import overlap_text, strip
from seamline.operators.oracle_rows import oracle_documents
from seamline.operators.ordering import round_robin, with_ordinal
from seamline.operators.sampling import anti_join_text

LEAD, CUE = "Problem: ", "Answer:"


def with_answers(df: DataFrame, solution: str = "solution") -> DataFrame:
    """``df`` with ``answer``: what the solution puts in its last box, null without one."""
    return df.withColumn("answer", last_boxed(F.col(solution)))


def math_examples(train: DataFrame, tests: DataFrame, count: int) -> DataFrame:
    """problem, solution, place: up to ``count`` worked examples of ``train`` (position, problem, solution, subject).

    The first problem of every subject comes first, in order of position, then the others, equal ones once. Blank
    problems, and those that are a problem of ``tests`` but for case, marks and white space, are left out. ``count`` is
    small: the rows go into every prompt.
    """
    rows = train.select("position", strip(F.coalesce("problem", F.lit(""))).alias("problem"), strip(F.coalesce("solution", F.lit(""))).alias("solution"), F.lower(strip(F.coalesce("subject", F.lit("")))).alias("subject"))
    words = lambda c: F.nullif(overlap_text(F.col(c)), F.lit(""))
    rows = anti_join_text(rows.where("problem <> ''"), tests.select("problem"), words("problem"), words("problem"))
    least = F.min_by(F.struct("problem", "solution"), "position").alias("x")
    first = rows.groupBy("subject").agg(least, F.min("position").alias("position")).select("x.*", "position", F.lit(0).alias("later"))
    other = rows.groupBy("problem", "solution").agg(F.min("position").alias("position")).join(first.select("problem", "solution"), ["problem", "solution"], "left_anti")
    picked = first.unionByName(other.select("problem", "solution", "position", F.lit(1).alias("later"))).orderBy("later", "position").limit(max(0, count))
    return with_ordinal(picked, ["later", "position"], "place").select("problem", "solution", "place")


def math_prompt(problem: Column, examples: Column) -> Column:
    """Worked examples (structs problem, solution), then the problem; parts by blank lines."""
    shown = F.transform(examples, lambda e: F.regexp_replace(F.concat(F.lit(LEAD), strip(e["problem"]), F.lit(f"\n{CUE} "), strip(e["solution"])), r"(?U)\s+\z", ""))
    asked = F.concat(F.lit(LEAD), strip(problem), F.lit(f"\n{CUE}"))
    return F.array_join(F.array_append(shown, asked), "\n\n")


def sampled_tasks(tests: DataFrame, limit: int | None) -> DataFrame:
    """``tests`` with ``index``: all in order of position, or ``limit`` of them in turn from each subject and level."""
    rows = tests.withColumns({c: F.coalesce(c, F.lit("")) for c in ("subject", "level")})
    if limit is None or limit >= tests.count():
        return with_ordinal(rows, ["position"], "index")
    picked = round_robin(rows.withColumnRenamed("position", "task_order"), ["subject", "level"], "task_order", max(0, limit))
    return picked.withColumn("index", F.col("position") - 1).drop("position").withColumnRenamed("task_order", "position")


def math_documents(train: DataFrame, tests: DataFrame, examples: int, limit: int | None = None, tokens: Callable[[Column], Column] = token_count, most: int = 512) -> DataFrame:
    """Tasks as documents with prompt and blocks of the worked solution; ids by ``unique_id`` or place in the sample.

    Examples overlap with no test row, whether it is sampled or not. Subject, level, problem and gold solution are kept.
    """
    few = math_examples(train, tests, examples).orderBy("place").collect()  # no more than asked for
    shown = F.array(*[F.struct(F.lit(r.problem).alias("problem"), F.lit(r.solution).alias("solution")) for r in few]).cast("array<struct<problem:string,solution:string>>")
    asked = sampled_tasks(tests, limit)
    name = F.coalesce(F.nullif("unique_id", F.lit("")), F.concat(F.lit("math/test/"), F.col("index").cast("string")))
    docs = asked.select(
        name.alias("sample_id"), F.lit("math").alias("source_dataset"), math_prompt(F.col("problem"), shown).alias("prompt_text"), F.col("solution").alias("solution_text"),
        "problem", F.col("solution").alias("gold_solution"), name.alias("task_id"), "subject", "level",
    )
    return oracle_documents(docs, tokens, most)


def evaluated(docs: DataFrame, task: str, default_length: int = 512) -> DataFrame:
    """A record for every document (as of ``math_documents``) with what was generated for it.

    Besides the documents' columns: prediction, block_history and nfe_history (arrays), predicted_deltas (map of block
    end to delta) and carry_mask (0/1 of every block end), each of which may be null. Numbers decide "gsm8k", answers
    in boxes all other tasks; a null prediction is wrong. Rates are 0 where there is no block end.
    """
    none, ends = empty("int"), F.greatest(F.size("sizes_") - 1, F.lit(0))
    given = docs.withColumns({"sizes_": F.coalesce("oracle_block_sizes", none), "mask_": F.coalesce("carry_mask", none), "gold_": F.coalesce("gold_solution", F.lit(""))})
    right = gsm8k_correct if task == "gsm8k" else math_correct
    on = total(F.col("mask_"))
    told = ["question"] if task == "gsm8k" else ["problem", "subject", "level"]
    return given.select(
        "sample_id", F.lit(task).alias("task_name"), "source_dataset", right(F.col("gold_"), F.coalesce("prediction", F.lit(""))).alias("is_correct"),
        "prediction", F.col("gold_").alias("gold_solution"), F.col("sizes_").alias("oracle_block_sizes"), F.size("sizes_").alias("oracle_block_count"),
        generation_budget(F.col("sizes_"), F.lit(default_length)).alias("generation_length"), F.coalesce("block_history", none).alias("block_history"),
        F.coalesce("nfe_history", none).alias("nfe_history"), F.coalesce("has_final_answer_anchor", F.lit(False)).alias("has_final_answer_anchor"),
        count_of(F.col("segments")).alias("segment_count"), F.col("predicted_deltas").isNotNull().alias("prior_correction_applied"),
        F.coalesce(F.size("predicted_deltas"), F.lit(0)).alias("predicted_delta_count"), F.col("carry_mask").isNotNull().alias("boundary_gate_applied"),
        F.col("mask_").alias("boundary_carry_mask"), on.alias("carry_on_boundary_count"), F.when(ends > 0, on / ends).otherwise(0.0).alias("carry_rate"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in told],
    )


def evaluation_summary(records: DataFrame) -> DataFrame:
    """One row a task: documents, how many are right, how many had corrections or a gate, and carried block ends of all."""
    ends = F.greatest(F.col("oracle_block_count") - 1, F.lit(0))
    return records.groupBy("task_name").agg(
        F.count("*").alias("n"), F.avg(F.col("is_correct").cast("double")).alias("accuracy"), F.count_if("prior_correction_applied").alias("prior_correction_applied_doc_count"),
        F.count_if("boundary_gate_applied").alias("boundary_gate_applied_doc_count"), F.sum("carry_on_boundary_count").alias("carry_on_boundary_count"),
        F.sum(F.aggregate("nfe_history", F.lit(0), lambda s, x: s + x)).alias("nfe"),
        F.coalesce(F.sum("carry_on_boundary_count") / F.nullif(F.sum(ends), F.lit(0)), F.lit(0.0)).alias("carry_rate"),
    )


def training_metadata(settings: dict[str, Column], state: dict[str, Column]) -> Column:
    """What a checkpoint says of its making: given settings and state, and how its labels and choice are meant."""
    fixed = {"label_semantics": "boundary_after_token", "recommended_checkpoint_selection": "proxy_eval"}
    return F.struct(*[c.alias(n) for n, c in (settings | state).items()], *[F.lit(v).alias(n) for n, v in fixed.items()])
