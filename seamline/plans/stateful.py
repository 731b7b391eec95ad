"""Sessions by count, running state and rankings kept up by streams, over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.operators import metrics, scans
from seamline.plans.metrics import Q31_SQL
from seamline.session import shared_folder, table
from seamline.streaming import versions

BUDGET = 128
SESSIONS = "event_id LONG, user_id LONG, block_length LONG, session LONG, generated LONG, held LONG"
PLACES = "s_suppkey LONG, kept_rate DOUBLE, revenue DOUBLE, `rank` LONG"


def blocks_of_events(events: DataFrame) -> DataFrame:
    return events.select("event_id", "user_id", (F.floor(F.abs("value")) % 32 + 1).alias("block_length"))


def streamed(spark, sf: str, name: str) -> DataFrame:
    """A table as a stream of its files, at most one file a batch."""
    return spark.readStream.schema(table(spark, sf, name).schema).option("maxFilesPerTrigger", 1).parquet(f"{sf}/{name}.parque[t]")


def new_folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def q79_count_sessions(spark, sf: str) -> DataFrame:
    """A user's blocks in sessions of 128 tokens, each beginning where the one before is full."""
    blocks = blocks_of_events(table(spark, sf, "events"))
    return scans.budget_sessions(blocks, "user_id", ["event_id"], "block_length", BUDGET)


def q80_count_sessions_stream(spark, sf: str) -> DataFrame:
    """The same sessions from a stream of ``events``, open ones being carried from batch to batch."""
    folder = new_folder(spark, "sessions")
    sink = versions.sessions_sink(folder, "user_id", "event_id", "block_length", BUDGET)
    versions.run_to_end(blocks_of_events(streamed(spark, sf, "events")), sink, f"{folder}/checkpoint")
    return versions.results_of(spark, f"{folder}/results", SESSIONS)


def supplier_board(spark, sf: str):
    """Suppliers with their totals, and the order of the ranking of q31."""

    def board(totals: DataFrame):
        s = table(spark, sf, "supplier").join(totals, F.col("s_suppkey") == F.col("l_suppkey"), "left").withColumn("revenue", F.round("revenue", 2))
        gated = metrics.gate(s.withColumn("kept_rate", F.round(1 - F.col("returned") / F.col("n"), 6)), F.col("kept_rate"), F.lit(None).cast("double"), 0.6)
        return gated, [F.desc(metrics.or_missing(F.col("kept_rate"))), F.asc(metrics.or_unbounded(F.col("revenue"))), F.asc("s_suppkey")]

    return board


def supplier_sink(spark, sf: str, folder: str):
    totals = {"returned": F.count_if(F.col("l_returnflag") == "R"), "n": F.count("*"), "revenue": F.sum("l_extendedprice")}
    return versions.leaderboard_sink(folder, "l_suppkey", totals, "l_suppkey LONG, returned LONG, n LONG, revenue DOUBLE", supplier_board(spark, sf), PLACES)


def q81_leaderboard_stream(spark, sf: str) -> DataFrame:
    """The ranking of q31, written anew after every batch of a stream of ``lineitem``."""
    folder = new_folder(spark, "ranking")
    last = versions.run_to_end(streamed(spark, sf, "lineitem"), supplier_sink(spark, sf, folder), f"{folder}/checkpoint")
    return versions.Versions(f"{folder}/ranking", PLACES).before(spark, last + 1)


QUERIES = {f.__name__: f for f in (q79_count_sessions, q80_count_sessions_stream, q81_leaderboard_stream)}
Q79_SQL = f"""
WITH RECURSIVE e AS (SELECT event_id, user_id, CAST(floor(abs(value)) AS BIGINT) % 32 + 1 AS b, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
w AS (
  SELECT event_id, user_id, b, i, 0::BIGINT AS session, 0::BIGINT AS generated, least(b, {BUDGET}) AS held FROM e WHERE i = 1
  UNION ALL
  SELECT e.event_id, e.user_id, e.b, e.i, w.session + (w.generated + w.held >= {BUDGET})::BIGINT, CASE WHEN w.generated + w.held >= {BUDGET} THEN 0 ELSE w.generated + w.held END,
    least(e.b, {BUDGET} - CASE WHEN w.generated + w.held >= {BUDGET} THEN 0 ELSE w.generated + w.held END)
  FROM w JOIN e ON e.user_id IS NOT DISTINCT FROM w.user_id AND e.i = w.i + 1)
SELECT event_id, user_id, b AS block_length, session, generated, held FROM w
"""
ORACLE_SQL = {"q79_count_sessions": Q79_SQL, "q80_count_sessions_stream": Q79_SQL, "q81_leaderboard_stream": Q31_SQL}
