"""State carried along a key's events: as a batch fold by windows, and as a stream with keyed state.

Both give the same rows for the same events. A stream keeps one small state a key; what a key has
already emitted is never read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from seamline.functions.arrays import cosine, let
from seamline.operators.scans import scan

OFFSETS = "event_id BIGINT, user_id BIGINT, step_index BIGINT, block_length BIGINT, generated_length BIGINT, `offset` BIGINT"


class RunningOffsets(StatefulProcessor):
    """Numbers a key's blocks and sums their lengths, across batches. Rows of a batch go by event id.

    A task holds a key's rows of one batch; ``versions.offsets_sink`` does not, and takes hot keys.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", StructType([StructField("steps", LongType()), StructField("generated", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        steps, generated = self.total.get() if self.total.exists() else (0, 0)
        batch = pd.concat(list(rows)).sort_values("event_id")
        ends = generated + batch["block_length"].clip(lower=0).cumsum()
        yield pd.DataFrame({
            "event_id": batch["event_id"], "user_id": key[0], "step_index": range(steps, steps + len(batch)), "block_length": batch["block_length"],
            "generated_length": ends - batch["block_length"].clip(lower=0), "offset": ends,
        })
        self.total.update((steps + len(batch), int(ends.iloc[-1])))

    def close(self) -> None:
        pass


def stream_offsets(events: DataFrame) -> DataFrame:
    """Streaming twin of ``trace_offsets`` over event_id, user_id, block_length. Needs the RocksDB state store."""
    return events.groupBy("user_id").transformWithStateInPandas(RunningOffsets(), OFFSETS, "Append", "None")


def carry_scores(df: DataFrame, key: str, order: str, scores: str, summaries: str, summary: str, gate: str, weight: float) -> DataFrame:
    """Candidate scores plus weight times the gate score before, times likeness to the summary before.

    ``scores``: an array; ``summaries``: one vector a score; ``summary`` and ``gate``: what the row hands
    on. First rows and a weight of 0 leave scores as they are; a negative gate counts 0. Hot keys are spread.
    """
    df = scan(df, key, [order], before={"summary_before": F.col(summary), "carry_strength": F.col(gate)})
    df = df.withColumn("carry_strength", F.greatest("carry_strength", F.lit(0.0)) * weight)

    def lifted(s: Column, v: Column) -> Column:
        return s + F.coalesce(cosine(v, F.col("summary_before")), F.lit(0.0)) * F.col("carry_strength")

    out = F.when(F.col("summary_before").isNull() | F.lit(weight == 0), F.col(scores)).otherwise(F.zip_with(scores, summaries, lifted))
    return df.withColumn("carried_scores", out).drop("summary_before", "carry_strength")


def window_summary(vectors: Column, start: Column, end: Column) -> Column:
    """Mean of vectors[start:end] followed by the last of them; bounds held within the array, one vector at least."""
    n = F.size(vectors)
    a = F.greatest(F.lit(0), F.least(start, n - 1))
    b = F.greatest(a + 1, F.least(end, n))

    def of(part: Column) -> Column:
        zero = F.transform(F.get(part, 0), lambda _: F.lit(0.0))
        sums = F.aggregate(part, zero, lambda s, v: F.zip_with(s, v, lambda p, q: p + q.cast("double")))
        last = F.transform(F.element_at(part, -1), lambda x: x.cast("double"))
        return F.concat(F.transform(sums, lambda x: x / F.size(part)), last)

    return F.when(n > 0, let(F.slice(vectors, a + 1, b - a), of))


def revisit_plan(prompt_end: Column, block_start: Column, block_end: Column, overlap: Column, gate_before: Column, mode: str = "gated") -> Column:
    """Struct (revisit_start, revisit_end, overlap_tokens, carry_gate): how far back a block reopens what was emitted.

    The surer the boundary before (its gate score), the less is reopened; "fixed" reopens all of the
    overlap. Nothing is reopened in the prompt or without an overlap.
    """
    gate = F.lit(1.0) if mode == "fixed" else 1.0 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(gate_before, F.lit(0.0))))
    budget = F.greatest(overlap, F.lit(0))
    wanted = budget if mode == "fixed" else F.when(gate > 0, F.greatest(F.lit(1), F.bround(budget * gate).cast("int"))).otherwise(0)
    reopened = F.least(F.greatest(block_start - prompt_end, F.lit(0)), wanted)
    none = (block_start <= prompt_end) | (budget <= 0)
    return F.struct(
        F.when(none, block_start).otherwise(F.greatest(prompt_end, block_start - reopened)).cast("int").alias("revisit_start"),
        F.when(none, block_start).otherwise(F.least(block_start, block_end)).cast("int").alias("revisit_end"),
        F.when(none, 0).otherwise(reopened).cast("int").alias("overlap_tokens"),
        F.when(none, 0.0).otherwise(gate).cast("double").alias("carry_gate"),
    )


def unfinished(requests: DataFrame, done: DataFrame, key: str = "request_id") -> DataFrame:
    """Requests without a result yet: resuming by key, so that order does not matter."""
    return requests.join(done.select(key).distinct(), key, "left_anti")


def append_once(results: DataFrame, path: str, checkpoint: str, keys: list[str]):
    """A streaming query that appends JSON rows, each key once within the stream's state."""
    return results.dropDuplicates(keys).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
