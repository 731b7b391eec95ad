"""Ordered rule chains, audits and row validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that holds (a reason to reject), null if none does; null conditions do not hold."""
    chain = None
    for name, condition in rules:
        hit = F.coalesce(condition, F.lit(False))
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain if chain is not None else F.lit(None).cast("string")


def reason_counts(df: DataFrame, rules: list[tuple[str, Column]], kept: str = "kept") -> DataFrame:
    """Rows by first reason; ``kept`` for those without."""
    return df.groupBy(F.coalesce(first_reason(rules), F.lit(kept)).alias("reason")).agg(F.count("*").alias("n"))


def keep_value(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows whose trimmed, lower-cased column is ``value``."""
    return df.where(F.lower(F.trim(column)) == value.strip().lower())


def keep_summary(df: DataFrame, column: str, value: str) -> DataFrame:
    """total, written, skipped and missing (no value at all) of ``keep_value``."""
    text = F.trim(F.coalesce(F.col(column), F.lit("")))
    hit = F.lower(text) == value.strip().lower()
    return df.agg(
        F.count("*").alias("total"), F.count_if(hit).alias("written"), F.count_if(~hit & (text != "")).alias("skipped"), F.count_if(text == "").alias("missing")
    )


def vector_report(df: DataFrame, vector: str) -> DataFrame:
    """rows, distinct widths, rows with null, NaN or infinite elements."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.agg(
        F.count("*").alias("n_rows"), F.countDistinct(F.size(v)).alias("n_widths"), F.min(F.size(v)).alias("min_width"),
        F.max(F.size(v)).alias("max_width"), F.count_if(F.coalesce(bad, F.lit(True))).alias("n_bad"),
    )


def require(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """``df``, failing with the condition's name on the first row that breaks one (null counts as broken)."""
    for name, condition in conditions.items():
        broken = ~F.coalesce(condition, F.lit(False))
        first = df.columns[0]
        df = df.withColumn(first, F.when(broken, F.raise_error(F.lit(name))).otherwise(F.col(first)))
    return df


def validate_vectors(df: DataFrame, features: str, targets: dict[str, int]) -> DataFrame:
    """Rows with finite features of one width and targets within their class counts; anything else raises."""
    widths = df.agg(F.countDistinct(F.size(features))).first()[0]
    if widths != 1:
        raise ValueError("no rows" if widths == 0 else "feature vectors differ in width")
    finite = F.forall(features, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    checks = {"features are not finite": finite}
    checks |= {f"{c} is out of range": F.col(c).between(0, n - 1) for c, n in targets.items()}
    return require(df, checks)
