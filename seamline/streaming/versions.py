"""Tables that a stream keeps up batch by batch: every batch writes a version of its own from the version before.

A batch that is run again after a failure reads the same version and writes the same one anew, so that a restart in the
middle of a batch changes nothing. The work of a batch is DataFrame work: no key's rows are gathered in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.operators import scans
from seamline.operators.metrics import ranked


class Versions:
    """A table in a folder, one sub-folder a batch; ``schema`` is that of the empty table before the first batch."""

    def __init__(self, folder: str, schema: str):
        self.folder, self.schema = folder, schema

    def at(self, batch: int) -> str:
        return f"{self.folder}/version={batch}"

    def before(self, spark: SparkSession, batch: int) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self.at(batch - 1)) if batch else spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame, batch: int) -> DataFrame:
        """``df`` as the batch's version, read again. Versions that no rerun can ask for go."""
        spark = df.sparkSession
        df.write.mode("overwrite").parquet(self.at(batch))
        if batch > 1:
            old = spark._jvm.org.apache.hadoop.fs.Path(self.at(batch - 2))
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        return spark.read.schema(self.schema).parquet(self.at(batch))


def results_of(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All rows that a sink of this module has put in a folder, without the column of batches."""
    return spark.read.schema(f"{schema}, batch LONG").parquet(folder).drop("batch")


def offsets_sink(folder: str, key: str, order: str, length: str, schema: str) -> Callable[[DataFrame, int], None]:
    """Streaming twin of ``trace_offsets``: numbers each key's rows and sums their lengths, from batch to batch.

    ``schema``: of the results, which go to ``folder``/results. Rows of a batch go by ``order``.
    """
    state = Versions(f"{folder}/state", f"{key} LONG, steps LONG, generated LONG")

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        size = F.greatest(F.col(length), F.lit(0))
        known = state.before(spark, number)
        here = scans.scan(batch, key, [order], {"step_index": F.lit(1).cast("long"), "generated_length": size})
        joined = here.join(known.withColumnRenamed(key, "known"), here[key].eqNullSafe(F.col("known")), "left")
        out = joined.select(
            *batch.columns, (F.col("step_index") + F.coalesce("steps", F.lit(0))).alias("step_index"), (F.col("generated_length") + F.coalesce("generated", F.lit(0))).alias("generated_length")
        ).withColumn("offset", F.col("generated_length") + size)
        out.select(*[f"`{c.split()[0].strip('`')}`" for c in schema.split(",")]).write.mode("overwrite").parquet(f"{folder}/results/batch={number}")
        added = batch.groupBy(key).agg(F.count("*").alias("steps"), F.sum(size).cast("long").alias("generated"))
        state.write(known.unionByName(added).groupBy(key).agg(F.sum("steps").alias("steps"), F.sum("generated").alias("generated")), number)

    return run


def sessions_sink(folder: str, key: str, order: str, length: str, budget: int, kind: str = "LONG") -> Callable[[DataFrame, int], None]:
    """Streaming twin of ``budget_sessions``; ``kind``: type of the key. Results go to ``folder``/results."""
    state = Versions(f"{folder}/state", f"{key} {kind}, session LONG, generated LONG")

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = state.before(spark, number)
        keys = batch.select(F.col(key).alias("key_of_batch")).distinct()
        asked = known[key].eqNullSafe(keys["key_of_batch"])
        out = scans.budget_sessions(batch, key, [order], length, budget, known.join(keys, asked, "left_semi"))
        target = f"{folder}/results/batch={number}"
        out.write.mode("overwrite").parquet(target)
        left = scans.open_sessions(spark.read.schema(out.schema).parquet(target), key, [order], budget)
        state.write(known.join(keys, asked, "left_anti").unionByName(left), number)

    return run


def leaderboard_sink(
    folder: str, key: str, totals: dict[str, Column], schema: str, board: Callable[[DataFrame], tuple[DataFrame, list[Column]]], places: str
) -> Callable[[DataFrame, int], None]:
    """Adds each batch's ``totals`` (sums) by ``key`` to a stored table, and ranks anew what ``board`` makes of it.

    ``schema``: of the totals with their key, ``places``: of the ranking, which is in ``folder``/ranking by version.
    ``board`` gives the records to rank and the order. The last version is the ranking of all rows so far.
    """
    state, ranking = Versions(f"{folder}/state", schema), Versions(f"{folder}/ranking", places)

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = state.before(spark, number)
        added = batch.groupBy(key).agg(*[c.alias(n) for n, c in totals.items()])
        names = [f.name for f in known.schema if f.name != key]
        now = state.write(known.unionByName(added).groupBy(key).agg(*[F.sum(n).cast(known.schema[n].dataType).alias(n) for n in names]), number)
        records, order = board(now)
        placed = ranked(records, order)
        ranking.write(placed.select(*ranking.before(spark, 0).columns), number)

    return run


def run_to_end(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> int:
    """Runs a stream over what there is and gives the number of its last batch."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return max((p["batchId"] for p in query.recentProgress if p["numInputRows"]), default=-1)
