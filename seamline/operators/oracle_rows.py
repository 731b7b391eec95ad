"""Solutions as documents of token blocks, and rows that teach a gate or a correction of block ends.

Features and scores come from a model outside: an array of feature rows a document, and a map of scores by
index of a block end. Every row is made from its document alone; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.functions import arrays as A
from seamline.functions import records as R
from seamline.functions import text as X
from seamline.functions.kernels.actions import with_actions
from seamline.functions.prompts import token_count

#: Sources with rules of their own, the one that stands in for others, and the deltas in order of class.
KNOWN = ("proofnet", "lean_workbook")
STAND_IN = "proofnet"
DELTAS = (-2, -1, 0, 1, 2)
RADIUS = 2


def oracle_documents(df: DataFrame, tokens: Callable[[Column], Column] = token_count, most: int = 512) -> DataFrame:
    """``df`` (sample_id, source_dataset, prompt_text, solution_text) with its steps as blocks of tokens.

    ``tokens`` counts those of a text. Blocks end at ``most`` tokens in all; steps and their boundary types
    are as many as blocks. A null or blank solution has none.
    """
    steps = with_actions(df.withColumn("solution_text", X.repair_latex(F.col("solution_text"))), "solution_text", "segments")
    source = F.when(F.col("source_dataset").isin(*KNOWN), F.col("source_dataset")).otherwise(STAND_IN)
    typed = steps.withColumns({
        "segment_boundary_types": X.boundary_types(F.col("segments"), source, F.lit(None).cast("array<string>"), F.lit(False)),
        "oracle_block_sizes": A.budget_lengths(F.transform("segments", lambda s: tokens(F.concat(s, F.lit("\n")))), F.lit(most)),
    })
    n = F.size("oracle_block_sizes")
    cut = typed.withColumns({
        "segments": F.slice("segments", F.lit(1), n), "segment_boundary_types": F.slice("segment_boundary_types", F.lit(1), n),
        "has_final_answer_anchor": F.exists("segment_boundary_types", lambda t: F.array_contains(t, "final_answer_anchor")),
    })
    return cut.withColumn("oracle_prior_boundary_points", boundary_points(F.col("oracle_block_sizes")))


def boundary_points(sizes: Column, radius: int = RADIUS) -> Column:
    """prior_index, candidate_indices, candidate_deltas of every block."""

    def around(_: Column, i: Column) -> Column:
        held = A.neighbours(F.size(sizes), i, radius)
        return F.struct(i.alias("prior_index"), held.alias("candidate_indices"), F.transform(held, lambda k: k - i).alias("candidate_deltas"))

    return F.transform(sizes, around)


def question_documents(df: DataFrame, prefix: str, examples: Column, tokens: Callable[[Column], Column] = token_count, most: int = 512, dataset: str = "gsm8k") -> DataFrame:
    """Questions with answers (position, question, answer) as documents: prompts with worked examples, ids by position."""
    asked = df.select(
        F.concat(F.lit(prefix + "/"), F.col("position").cast("string")).alias("sample_id"), F.lit(dataset).alias("source_dataset"),
        R.qa_prompt(F.col("question"), examples).alias("prompt_text"), F.col("answer").alias("solution_text"), "question", F.col("answer").alias("gold_solution"),
    )
    return oracle_documents(asked, tokens, most)


def several_blocks(docs: DataFrame) -> DataFrame:
    """Documents with a block end to learn from."""
    return docs.where(F.size("oracle_block_sizes") > 1)


def _rows(docs: DataFrame, index: str) -> DataFrame:
    return docs.select(
        F.coalesce("sample_id", F.lit("")).alias("sample_id"), "source_dataset", "scores", F.coalesce("oracle_block_sizes", A.empty("int")).alias("oracle_block_sizes"),
        F.coalesce("has_final_answer_anchor", F.lit(False)).alias("has_final_answer_anchor"), F.posexplode("features").alias(index, "raw"),
    ).withColumn("features", F.transform("raw", lambda x: F.round(x.cast("double"), 6))).drop("raw")


def gate_rows(docs: DataFrame) -> DataFrame:
    """A row for every row of ``features``: its gate target by ``scores`` (map of index to struct carry_on, carry_off; 0.0 where missing)."""
    score = lambda name: F.coalesce(F.try_element_at("scores", F.col("transition_index"))[name], F.lit(0.0))
    rows = _rows(docs, "transition_index").withColumn("gate_scores", F.struct(score("carry_on").alias("carry_on"), score("carry_off").alias("carry_off")))
    return rows.withColumn("gate_target", R.gate_target(F.col("gate_scores.carry_on"), F.col("gate_scores.carry_off"))).withColumn("source_dataset", F.coalesce("source_dataset", F.lit(""))).drop("scores")


def correction_rows(docs: DataFrame) -> DataFrame:
    """A row for every row of ``features``: the best delta by ``scores`` (map of index to map of delta to score; 0 where missing)."""
    none = F.create_map(F.lit(0), F.lit(0.0))
    found = F.try_element_at("scores", F.col("boundary_index"))
    rows = _rows(docs, "boundary_index").withColumn("delta_scores", F.when(F.size(found) > 0, found).otherwise(none)).withColumn("best_delta", A.best_delta(F.col("delta_scores")))
    return rows.withColumns({
        "gate_target": (F.col("best_delta") != 0).cast("int"), "delta_target": R.delta_class(F.col("best_delta"), DELTAS),
        "source_dataset": F.coalesce(F.nullif("source_dataset", F.lit("")), F.lit("gsm8k")),
    }).drop("scores")


def first_greatest(scores: Column) -> Column:
    """0-based index of an array's first greatest element."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def predicted_deltas(gates: Column, deltas: Column) -> Column:
    """Map of index to delta, of the block ends whose gate says so and whose delta is not 0. Both are arrays of class scores."""
    values = F.array(*map(F.lit, DELTAS))
    pairs = F.zip_with(gates, deltas, lambda g, d: F.when(first_greatest(g) == 1, F.get(values, first_greatest(d))).otherwise(0))
    placed = F.transform(pairs, lambda d, i: F.struct(i.alias("key"), d.alias("value")))
    return F.map_from_entries(F.filter(placed, lambda p: p["value"] != 0))


def carry_mask(gates: Column) -> Column:
    """0/1 of every block end: whether its gate says so."""
    return F.transform(gates, lambda g: (first_greatest(g) == 1).cast("int"))
