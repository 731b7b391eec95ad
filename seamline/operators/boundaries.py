"""Boundaries of texts and traces, and how well two systems of them agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamline.functions.arrays import let, offsets_of_lengths, running_sums
from seamline.operators.scans import scan

TOLERANCES = (0, 1, 2, 4, 8)


def cut_offsets(text: Column, separator: str, before: bool = False) -> Column:
    """Offsets at which ``separator`` (one literal character) cuts a text, the end of the text not counted.

    After the separator by default, before it with ``before``. A null text has no cuts. Row-local: nothing is shuffled.
    """
    lengths = F.transform(F.split(text, rf"\Q{separator}\E", -1), lambda p: F.length(p) + 1)
    sums = running_sums(let(lengths, lambda n: F.slice(n, F.lit(1), F.size(n) - 1)))
    return F.transform(sums, lambda s: s - 1) if before else sums


def trace_offsets(events: DataFrame, key: str, order: list[str], length: str) -> DataFrame:
    """``events`` with step_index, generated_length (the sum of earlier lengths) and offset (with its own). Hot keys are spread."""
    size = F.greatest(F.col(length), F.lit(0))
    out = scan(events, key, order, {"step_index": F.lit(1).cast("long"), "generated_length": size})
    return out.withColumn("offset", F.col("generated_length") + size)


def drop_terminal(events: DataFrame, key: str, offset: str = "offset") -> DataFrame:
    """Without all rows whose offset is the greatest of their key."""
    last = events.groupBy(F.col(key).alias("key_of_last")).agg(F.max(offset).alias("last_offset"))
    joined = events.join(last, events[key].eqNullSafe(last["key_of_last"]))
    return joined.where(F.col(offset) < F.col("last_offset")).drop("last_offset", "key_of_last")


def expand_history(records: DataFrame, key: str, history: str, prompt_length: Column | None = None) -> DataFrame:
    """One row a block of an array of block lengths: key, step_index, generated_length, block_length, boundary_position.

    Blocks that are null or not positive give no row but still count as a step.
    """
    starts = offsets_of_lengths(F.transform(history, lambda n: F.coalesce(n, F.lit(0))))
    rows = records.select(
        key, F.posexplode(F.arrays_zip(F.col(history).alias("n"), starts.alias("start"))).alias("step_index", "b"),
        (F.lit(0) if prompt_length is None else prompt_length).alias("prompt_length"),
    ).where(F.col("b.n") > 0)
    return rows.select(
        key, "step_index", F.col("b.start").alias("generated_length"), F.col("b.n").alias("block_length"),
        (F.col("prompt_length") + F.col("b.start") + F.col("b.n") - 1).alias("boundary_position"),
    )


def choose_match_key(left: DataFrame, right: DataFrame, first: str = "sample_id", second: str = "request_index") -> str:
    """``first`` if enough of its values are on both sides, else ``second``. Three counts come to the driver."""
    a, b = left.select(first).where(f"{first} is not null").distinct(), right.select(first).where(f"{first} is not null").distinct()
    n, m, both = a.count(), b.count(), a.join(b, first, "left_semi").count()
    return first if both >= max(1, min(n, m) // 2) else second


def overlap_counts(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """``pairs`` (two offset arrays a row) with n_left, n_right, n_shared, n_union and one count a tolerance and side."""
    a, b = F.col(left), F.col(right)

    def within(query: Column, reference: Column, t: int) -> Column:
        near = F.array_distinct(F.flatten(F.transform(reference, lambda y: F.sequence(y - t, y + t))))
        return F.size(F.array_intersect(query, near))

    out = pairs.withColumns({
        "n_left": F.size(F.array_distinct(a)), "n_right": F.size(F.array_distinct(b)),
        "n_shared": F.size(F.array_intersect(a, b)), "n_union": F.size(F.array_union(a, b)),
    })
    return out.withColumns(
        {f"left_within_{t}": within(a, b, t) for t in TOLERANCES} | {f"right_within_{t}": within(b, a, t) for t in TOLERANCES}
    )


def nearest_distances(left: DataFrame, right: DataFrame, key: str, offset: str = "offset") -> DataFrame:
    """Distance of every distinct left offset to the nearest right one of its key; null if there is none.

    One shuffle: both sides in one order, the last right offset before and the first after each left one.
    """
    both = left.select(key, F.col(offset).alias("o"), F.lit(True).alias("query")).distinct().unionByName(
        right.select(key, F.col(offset).alias("o"), F.lit(False).alias("query"))
    )
    w = Window.partitionBy(key).orderBy("o")
    reference = F.when(~F.col("query"), F.col("o"))
    below = F.max(reference).over(w.rangeBetween(Window.unboundedPreceding, 0))
    above = F.min(reference).over(w.rangeBetween(0, Window.unboundedFollowing))
    near = both.withColumns({"below": below, "above": above}).where("query")
    return near.select(key, F.col("o").alias(offset), F.least(F.col("o") - F.col("below"), F.col("above") - F.col("o")).alias("distance"))


def distance_summary(distances: DataFrame) -> DataFrame:
    """count, mean, median and 90th percentile (linear between ranks)."""
    return distances.where("distance is not null").agg(
        F.count("*").alias("n"), F.avg("distance").alias("mean_distance"),
        F.median("distance").alias("median_distance"), F.percentile("distance", 0.9).alias("p90_distance"),
    )


def ratio(a: Column, b: Column, empty: float | None = None) -> Column:
    """a / b, or ``empty`` where b is 0: both policies of the comparison tools."""
    return F.when(b != 0, a / b).otherwise(F.lit(empty).cast("double"))


def overlap_metrics(shared: Column, predicted: Column, actual: Column, empty: float | None = None) -> dict[str, Column]:
    """precision, recall and F1 of set overlap."""
    p, r = ratio(shared, predicted, empty), ratio(shared, actual, empty)
    return {"precision": p, "recall": r, "f1": ratio(2 * p * r, p + r, empty)}


def aligned_sets(left: DataFrame, right: DataFrame, key: str, position: str) -> DataFrame:
    """Full outer alignment: key, left_positions, right_positions, sorted and distinct, empty where a side is missing."""
    def sets(df: DataFrame, name: str) -> DataFrame:
        return df.where(f"{position} is not null").groupBy(key).agg(F.array_sort(F.collect_set(position)).alias(name))

    both = sets(left, "left_positions").join(sets(right, "right_positions"), key, "full")
    return both.withColumns({c: F.coalesce(c, F.array()) for c in ("left_positions", "right_positions")})


def mean_nearest(source: Column, target: Column) -> Column:
    """Mean distance of the source's positions to the nearest target; 0 where a side is empty."""
    gaps = let(target, lambda t: F.transform(source, lambda x: F.array_min(F.transform(t, lambda y: F.abs(x - y)))))
    some = (F.size(source) > 0) & (F.size(target) > 0)
    return F.when(some, F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) / F.size(source)).otherwise(0.0)
