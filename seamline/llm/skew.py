"""Joins that no hot key gathers in one task, and the size check that stands before a broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key that a task takes as they come; keys with more are spread.
HOT_ROWS = 1_000
#: No more keys than this are ever spread: a hot key has at least this share of the rows.
HOT_KEYS = 100_000
#: What is sent to every executor at most.
BROADCAST_ROWS = 300_000
BROADCAST_BYTES = 32_000_000


def fits_broadcast(df: DataFrame) -> bool:
    """Whether ``df`` is small in rows and in bytes (counted as JSON)."""
    size = df.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("b")).first()
    return size.n <= BROADCAST_ROWS and (size.b or 0) <= BROADCAST_BYTES


def salted_join(
    left: DataFrame, right: DataFrame, keys: str | list[str], spread: Column, rows: int, how: str = "inner", hot_rows: int | None = None
) -> DataFrame:
    """``left`` joined to ``right`` on ``keys``; rows of hot keys of ``left`` are spread over tasks by ``spread``.

    ``rows``: of ``left``. A key (the first, of several) is hot with more than ``hot_rows`` rows and more than a
    ``HOT_KEYS``-th of all; so few keys can be that their table is broadcast. Rows of ``right`` with a hot
    key are repeated once a salt. Fewer rows than ``hot_rows`` have no hot key and are joined as they are.
    """
    least = max(HOT_ROWS if hot_rows is None else hot_rows, rows // HOT_KEYS)
    keys = [keys] if isinstance(keys, str) else keys
    key = keys[0]
    if rows <= least:
        return left.join(right, keys, how)
    hot = left.groupBy(F.col(key).alias("hot_key")).agg(F.count("*").alias("hot_rows")).where(F.col("hot_rows") > least)
    hot = F.broadcast(hot.select("hot_key", F.ceil(F.col("hot_rows") / least).alias("salts")))
    dealt = left.join(hot, left[key] == hot["hot_key"], "left")
    dealt = dealt.withColumn("salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("salts")), F.lit(0).cast("long"))).drop("hot_key", "salts")
    copies = right.join(hot, right[key] == hot["hot_key"], "left")
    copies = copies.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1).cast("long")) - 1))).drop("hot_key", "salts")
    return dealt.join(copies, [*keys, "salt"], how).drop("salt")
