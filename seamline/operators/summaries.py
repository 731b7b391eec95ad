"""Summaries of labelled examples, documents, generations and runs; each is one pass over its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.functions.arrays import total
from seamline.operators.boundaries import ratio
from seamline.operators.metrics import positive_rate


def labelled_summary(df: DataFrame, labels: str, mask: str | None = None, group: list[str] | None = None) -> DataFrame:
    """Rows, array lengths, and the rate of positive labels, masked or not, by group or over all."""
    ones, every = positive_rate(F.col(labels), F.col(mask) if mask else None)
    n = F.size(labels)
    out = [
        F.count("*").alias("n_rows"), F.avg(n).alias("avg_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length"),
        ratio(ones, every).alias("masked_positive_rate" if mask else "positive_rate"),
    ]
    return (df.groupBy(*group) if group else df).agg(*out)


def value_counts(df: DataFrame, column: str, most: int | None = None) -> DataFrame:
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), column).limit(most) if most else counts


def masked_histogram(df: DataFrame, values: str, mask: str) -> DataFrame:
    """Counts of array elements whose mask is set."""
    pairs = df.select(F.explode(F.arrays_zip(F.col(values).alias("value"), F.col(mask).alias("mask"))).alias("p"))
    return pairs.where("p.mask = 1").groupBy(F.col("p.value").alias("value")).agg(F.count("*").alias("n"))


def document_summary(df: DataFrame, sizes: str, anchored: Column) -> DataFrame:
    """Average block length over all blocks, average count, share of documents with several blocks and with an anchor."""
    blocks = F.size(sizes)
    return df.agg(
        F.count("*").alias("n_documents"), ratio(F.sum(total(F.col(sizes))), F.sum(blocks), 0.0).alias("avg_block_length"), F.avg(blocks).alias("avg_block_count"),
        F.avg((blocks > 1).cast("int")).alias("coverage_rate"), F.avg(anchored.cast("int")).alias("anchor_rate"),
    )


def block_histogram(df: DataFrame, sizes: str) -> DataFrame:
    return df.groupBy(F.size(sizes).alias("blocks")).agg(F.count("*").alias("n"))


def generation_summary(df: DataFrame, correct: str, nfe: str, blocks: str) -> DataFrame:
    """Exact match, function evaluations and blocks a sample, and block length over all blocks."""
    return df.agg(
        F.count("*").alias("n_samples"), F.avg(F.col(correct).cast("int")).alias("exact_match"), F.avg(total(F.col(nfe))).alias("avg_nfe"),
        F.avg(F.size(blocks)).alias("avg_blocks"), ratio(F.sum(total(F.col(blocks))), F.sum(F.size(blocks)), 0.0).alias("avg_block_length"),
    )


def runtime_summary(events: DataFrame, key: str, order: str, length: str, nfe: str, parsed: Column, target: float) -> DataFrame:
    """Block length and its error to a target, parse rate, and the mean of each sample's last evaluation count."""
    per = events.groupBy(key).agg(F.sum(length).alias("tokens"), F.count(length).alias("blocks"), F.max_by(nfe, order).alias("last_nfe"), F.max(parsed.cast("int")).alias("parsed"))
    mean = ratio(F.sum("tokens"), F.sum("blocks"))
    return per.agg(mean.alias("avg_block_length"), F.abs(mean - target).alias("length_error"), F.avg("parsed").alias("parse_rate"), F.avg("last_nfe").alias("avg_nfe"))


def pass_changes(df: DataFrame, old: str, new: str) -> DataFrame:
    """How many samples a change rescued and how many it broke."""
    a, b = F.coalesce(F.col(old), F.lit(False)), F.coalesce(F.col(new), F.lit(False))
    return df.agg(
        F.count("*").alias("n"), F.count_if(a).alias("old_pass"), F.count_if(b).alias("new_pass"), F.count_if(b & ~a).alias("rescued"), F.count_if(a & ~b).alias("regressed"),
    )


def failure_histogram(df: DataFrame, passed: str, kind: str) -> DataFrame:
    """Failures by type, and the passes as "passed"."""
    return df.groupBy(F.when(F.col(passed), "passed").otherwise(F.col(kind)).alias("outcome")).agg(F.count("*").alias("n"))


def subset_scores(df: DataFrame, subset: str, correct: str) -> DataFrame:
    """Counts and rates by subset, and in total (subset null, is_total 1)."""
    c = F.count_if(F.col(correct))
    return df.rollup(subset).agg(F.count("*").alias("n"), c.alias("n_correct"), (c / F.count("*")).alias("accuracy"), F.grouping(subset).alias("is_total"))


def carry_rate(df: DataFrame, carried: str, boundaries: str) -> DataFrame:
    """Share of carried boundaries over all rows, 0 without any."""
    return df.agg(F.sum(carried).alias("n_carried"), F.sum(boundaries).alias("n_boundaries"), ratio(F.sum(carried), F.sum(boundaries), 0.0).alias("carry_rate"))


def row_summary(df: DataFrame, document: str, target: str) -> tuple[DataFrame, DataFrame]:
    """Rows and distinct documents; rows by target."""
    return df.agg(F.count("*").alias("n_rows"), F.countDistinct(document).alias("n_documents")), value_counts(df, target)


def subset_range(df: DataFrame, index: str) -> DataFrame:
    """Count, least and greatest index, -1 for none."""
    return df.agg(F.count(index).alias("n"), F.coalesce(F.min(index), F.lit(-1)).alias("least"), F.coalesce(F.max(index), F.lit(-1)).alias("greatest"))


def audit_counts(df: DataFrame, language: str, events: list[Column]) -> DataFrame:
    """Named events by language; ``events`` are columns that are true where the event of their alias happened."""
    return df.groupBy(language).agg(*[F.count_if(e).alias(e._jc.toString().split(" AS ")[-1].strip("`")) for e in events])


def rate_penalty(predicted: Column, mask: Column, target: float) -> Column:
    """Squared difference of the masked mean of predictions to a target rate."""
    weighed = F.aggregate(F.zip_with(predicted, mask, lambda p, m: p.cast("double") * m), F.lit(0.0), lambda s, x: s + x)
    return F.pow(weighed / F.greatest(total(mask), F.lit(1)) - target, 2)
