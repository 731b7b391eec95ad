"""Order without a single task: global ordinals, first-seen groups, caps and round robin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamline.session import durable


def with_ordinal(df: DataFrame, order: list[str], name: str = "ordinal") -> DataFrame:
    """``df`` with 0-based positions in ``order`` over all rows.

    Rows are dealt by range and sorted within each part; only the parts' row counts are summed up. The
    dealt rows are materialised, so that parts stay the same between both readings.
    """
    parts = durable(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return parts.withColumn("within", within).join(starts, "part").withColumn(name, F.col("start") + F.col("within") - 1).drop("part", "within", "start")


def first_keys(df: DataFrame, key: str, order: str, count: int) -> DataFrame:
    """The first ``count`` distinct keys by where they are first seen: key, first_seen."""
    return df.groupBy(key).agg(F.min(order).alias("first_seen")).orderBy("first_seen", key).limit(count)


def rows_of_first_keys(df: DataFrame, key: str, order: str, count: int) -> DataFrame:
    return df.join(first_keys(df, key, order, count).select(key), key, "left_semi")


def cap_per_group(df: DataFrame, group: list[str], order: list, most: int, name: str = "rank") -> DataFrame:
    """At most ``most`` rows a group in ``order``, with their rank. Spark keeps ``most`` a task before shuffling."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")
    return df.withColumn(name, rank).where(F.col(name) <= most)


def round_robin(df: DataFrame, strata: list[str], order: str, count: int) -> DataFrame:
    """``count`` rows in turn from each stratum, strata in order of first sight, with ``position`` from 1.

    No stratum gives more than ``count`` rows, so each task keeps that many of it before shuffling.
    """
    seen = df.groupBy(*strata).agg(F.min(order).alias("stratum_order"))
    turns = cap_per_group(df, strata, [order], count, "turn")
    same = [turns[s].eqNullSafe(seen[s]) for s in strata]
    picked = turns.join(seen, same).select(turns["*"], "stratum_order").orderBy("turn", "stratum_order", order).limit(count)
    placed = with_ordinal(picked, ["turn", "stratum_order", order], "position")
    return placed.withColumn("position", F.col("position") + 1).drop("turn", "stratum_order")


def last_keys_split(df: DataFrame, key: str, order: Column, count: int) -> DataFrame:
    """``df`` with ``split``: "valid" for the last ``count`` distinct keys by first sight, else "train"."""
    last = df.groupBy(key).agg(F.min(order).alias("first_seen")).orderBy(F.desc("first_seen"), F.desc(key)).limit(count)
    marked = df.join(last.select(key, F.lit(True).alias("is_last")), key, "left")
    return marked.withColumn("split", F.when(F.col("is_last"), "valid").otherwise("train")).drop("is_last")


def islands(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Runs of equal adjacent values: key, island, value, n, first and last of the first order column."""
    w = Window.partitionBy(key).orderBy(*order)
    change = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | F.lag(F.lit(1)).over(w).isNull()).cast("int")
    marked = df.withColumn("change", change)
    marked = marked.withColumn("island", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "island").agg(
        F.first(value).alias(value), F.count("*").alias("n"), F.min(order[0]).alias("first_at"), F.max(order[0]).alias("last_at")
    )


def zip_in_order(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Rows of both sides joined by position; sides of different length are an error."""
    n, m = left.count(), right.count()
    if n != m:
        raise ValueError(f"{n} rows do not pair with {m}")
    return with_ordinal(left, left_order).join(with_ordinal(right, right_order), "ordinal")
