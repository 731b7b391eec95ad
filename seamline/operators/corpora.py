"""Corpus preparation: segmented corpora from raw sources, with their drop reasons, and mixtures of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.functions import text as X
from seamline.functions.kernels.code import segmented_code
from seamline.functions.kernels.maths import detokenized
from seamline.functions.maths import math_segments
from seamline.operators.predicates import is_kept, math_keep_reason
from seamline.operators.sampling import bottom_k, ratio_split, stable_split
from seamline.session import durable


def code_corpus(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (language, repo, path, func_name, code, docstring, split) → segmented rows, and counts by language and reason.

    Reasons: missing_code, missing_split, not_segmented, kept. The segmenter runs once.
    """
    s = df.withColumn("s", segmented_code(F.col("language"), F.col("code")))
    reason = (
        F.when(F.coalesce(X.is_blank(F.col("code")), F.lit(True)), "missing_code").when(F.col("split").isNull(), "missing_split")
        .when(F.col("s.segments").isNull(), "not_segmented").otherwise("kept")
    )
    s = durable(s.withColumn("reason", reason))
    rows = s.where("reason = 'kept'").select(
        F.lit("codesearchnet").alias("source"), "language", "repo", "path", "func_name", "split", F.col("s.method").alias("segmentation_method"),
        F.col("s.quality").alias("boundary_quality"), (~X.is_blank(F.coalesce("docstring", F.lit("")))).alias("has_docstring"),
        F.size("s.segments").alias("code_segment_count"), F.col("s.segments").alias("segments"),
    )
    return rows, s.groupBy("language", "reason").agg(F.count("*").alias("n"))


def token_corpus(documents: DataFrame) -> DataFrame:
    """Token documents → segmented rows; documents left without a segment go."""
    parts = documents.select("source", "split", "doc_id", F.posexplode("tokens").alias("k", "t"))
    texts = parts.select("source", "split", "doc_id", "k", detokenized(F.col("t")).alias("text")).where("text <> ''")
    rows = texts.groupBy("source", "split", "doc_id").agg(F.array_sort(F.collect_list(F.struct("k", "text"))).alias("s"))
    return rows.select("source", "split", "doc_id", F.transform("s", lambda s: s["text"]).alias("segments"))


def notebook_corpus(books: DataFrame, prefix: bool = False) -> DataFrame:
    """Notebooks → one segment a filled cell, marked by cell type with ``prefix``; fewer than two segments, or no cells, go."""
    cells = F.arrays_zip(F.col("cell_types").alias("kind"), F.col("cell_texts").alias("text"))
    filled = F.filter(F.transform(cells, lambda c: F.struct(c["kind"].alias("kind"), X.strip_newlines(c["text"]).alias("text"))), lambda c: ~X.is_blank(c["text"]))
    shown = F.transform(filled, lambda c: F.concat(F.lit("["), c["kind"], F.lit("]\n"), c["text"]) if prefix else c["text"])
    rows = books.where("valid").select(
        F.lit("juice").alias("source"), stable_split(F.col("notebook_path"), 990).alias("split"), "notebook_path",
        F.transform(filled, lambda c: c["kind"]).alias("cell_types"), shown.alias("segments"),
    )
    return rows.where(F.size("segments") >= 2)


def statement_corpus(df: DataFrame, key: str = "natural_language_statement", formal: bool = False) -> DataFrame:
    """Statements and proofs (split, tags, statement, formal_statement, proof) → segmented rows, split by digest of the statement."""
    parts = [math_segments(F.col(key)), F.coalesce(X.filled(F.col("proof")), F.array().cast("array<string>"))]
    if formal:
        parts.insert(1, F.when(X.is_blank(F.coalesce("formal_statement", F.lit(""))), F.array().cast("array<string>")).otherwise(F.array("formal_statement")))
    rows = df.select(F.lit("lean_workbook").alias("source"), stable_split(F.col(key)).alias("split"), F.concat(*parts).alias("segments"), F.col("split").alias("lean_split"), "tags")
    return rows.where(F.size("segments") > 0)


def filtered_statements(df: DataFrame, key: str = "natural_language_statement", least: int = 3) -> tuple[DataFrame, DataFrame]:
    """Statements worth keeping, with the reason, and counts of all reasons."""
    tactic = r"(?i)^(?:simpa?|rwa?|n?linarith|ring(?:_nf)?|norm_num|exact|apply|refine|intros?|have|cases|constructor)\b"
    prose = F.filter("proof", lambda p: ~X.strip(p).rlike(tactic) & (F.size(F.split(X.strip(p), " ", -1)) > 4))
    s = durable(df.withColumn("statement_segments", math_segments(F.col(key))))
    s = s.withColumn("selection_reason", math_keep_reason(F.col("proof"), F.col("statement_segments"), prose, least))
    return s.where(is_kept(F.col("selection_reason"))), s.groupBy("selection_reason").agg(F.count("*").alias("n"))


def balanced_union(pools: dict[str, DataFrame], ratios: dict[str, int], count: int | None = None) -> DataFrame:
    """Equally many rows of every pool (id, …), the least by digest, each pool split by ratio; ``source_dataset`` names the pool."""
    sizes = {n: p.count() for n, p in pools.items()}
    n = min(sizes.values()) if count is None else count
    short = [k for k, v in sizes.items() if v < n]
    if short:
        raise ValueError(f"pools with fewer than {n} rows: {sorted(short)}")
    out = None
    for name, pool in pools.items():
        part = bottom_k(pool, F.md5(F.col("id").cast("string")), "id", n).withColumn("split", ratio_split(F.col("rank"), F.lit(n), ratios))
        part = part.drop("digest", "rank").withColumn("source_dataset", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def repeated_samples(base: DataFrame, samples: DataFrame, repeats: int, key: str = "task_id") -> DataFrame:
    """``base`` and ``repeats`` copies of ``samples``, whose ids get the number of the copy."""
    copies = samples.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    copies = copies.withColumn(key, F.format_string("%s_%04d", F.col(key), F.col("copy"))).drop("copy")
    return base.unionByName(copies, allowMissingColumns=True)


def fixed_blocks(requests: DataFrame, key: str, block: int, total: int, nfe: str) -> DataFrame:
    """Events of fixed blocks, one an evaluation until ``total`` tokens are made: the closed form of a countdown."""
    rows = requests.select(key, F.size(nfe).alias("n"), F.posexplode(nfe).alias("step_index", "evaluations"))
    rows = rows.withColumn("generated_length", F.col("step_index") * block).where(F.col("generated_length") < total)
    return rows.withColumn("selected_block_length", F.least(F.lit(block), F.lit(total) - F.col("generated_length"))).drop("n")
