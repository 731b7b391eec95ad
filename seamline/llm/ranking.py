"""Numbering the rows of a group without gathering the group in one task."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seamline.session import durable


def number_rows(df: DataFrame, group: list[str], bucket: str, order: list, name: str) -> DataFrame:
    """``df`` with ``name``, 1 to the group's size in order of ``bucket``, then ``order``.

    Rows are sorted within a bucket; only the buckets' sizes are summed over a group. Nulls in ``group``
    and ``bucket`` are values like others.
    """
    spot = [*group, bucket]
    sizes = df.groupBy(*spot).agg(F.count("*").alias("rows_of_bucket"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *[F.col(c).alias(f"start_{c}") for c in spot], F.coalesce(F.sum("rows_of_bucket").over(before), F.lit(0)).alias("rows_before")
    )
    ranked = df.withColumn("rank_in_bucket", F.row_number().over(Window.partitionBy(*spot).orderBy(*order)))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"start_{c}")) for c in spot])
    return ranked.join(starts, same).select(*df.columns, (F.col("rows_before") + F.col("rank_in_bucket")).alias(name))


def number_by_ranges(df: DataFrame, group: list[str], order: list, copies: str, name: str, ranges: list | None = None) -> DataFrame:
    """``df`` with ``name``, the 1-based place of a row's first copy in its group, each row standing for ``copies`` rows.

    Rows are dealt by range of group and order, so that a group of any size takes as many tasks as its rows need; of
    a group only one sum a range is added up. Rows must differ in group and order, else equal ones stay together.
    ``ranges``: what they are dealt by instead of ``order``, if that is too long to sample; a prefix of it in meaning.
    """
    parts = durable(df.repartitionByRange(*group, *(ranges or order)).withColumn("part", F.spark_partition_id()))
    spot = [*group, "part"]
    sizes = parts.groupBy(*spot).agg(F.sum(copies).alias("rows_of_part"))
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(c).alias(f"start_{c}") for c in spot], F.coalesce(F.sum("rows_of_part").over(earlier), F.lit(0)).alias("rows_before"))
    above = Window.partitionBy(*spot).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = parts.withColumn("rows_above", F.coalesce(F.sum(copies).over(above), F.lit(0)))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"start_{c}")) for c in spot])
    return ranked.join(starts, same).select(*df.columns, (F.col("rows_before") + F.col("rows_above") + 1).alias(name))
