"""Running state of keyed rows in order, with hot keys spread over tasks: sums, rows before, sessions by count.

A scan goes in two levels. Rows are dealt by range of key and order, so that one key takes as many tasks as its rows
need; a block is a key's rows in one task. What the blocks hold is folded for each key over one row a block, and the
rows are then scanned within their block, from where the block before ended.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from seamline.session import durable

#: Rows of one key that a task may hold as they come; beyond, keys are dealt out in blocks.
HOT_ROWS = 1_000_000


def has_hot_key(df: DataFrame, key: str, most: int | None = None) -> bool:
    """Whether some key has more than ``most`` rows (``HOT_ROWS``)."""
    return not df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > (HOT_ROWS if most is None else most)).isEmpty()


def same_block(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    return reduce(and_, [left[c].eqNullSafe(right[f"{c}_of_block"]) for c in columns])


def scan(
    df: DataFrame, key: str, order: list[str], sums: dict[str, Column] | None = None, before: dict[str, Column] | None = None, hot_rows: int | None = None
) -> DataFrame:
    """``df`` with the sum of each of ``sums`` over the key's earlier rows, and each of ``before`` in the row just before (null in the first).

    Keys of up to ``hot_rows`` rows are windows of one shuffle; if one key has more, all go in two levels. Rows of one
    key and order are taken in any order. A null key is a key.
    """
    sums, before = sums or {}, before or {}
    values = {f"value_{n}": c for n, c in (sums | before).items()}
    given = df.withColumns(values) if values else df
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c, w: F.coalesce(F.sum(c).over(earlier(w)), F.lit(0))
    if not has_hot_key(df, key, hot_rows):
        w = Window.partitionBy(key).orderBy(*order)
        made = {n: total(f"value_{n}", w) for n in sums} | {n: F.lag(f"value_{n}").over(w) for n in before}
        return given.withColumns(made).select(*[c for c in df.columns if c not in made], *made)
    rows = durable(given.repartitionByRange(key, *order).withColumn("block", F.spark_partition_id()))
    last = F.max_by(F.struct(F.lit(1).alias("there"), *[f"value_{n}" for n in before]), F.struct(*order))
    blocks = rows.groupBy(key, "block").agg(last.alias("last"), *[F.sum(f"value_{n}").alias(n) for n in sums])
    w = Window.partitionBy(key).orderBy("block")
    starts = blocks.select(
        *[F.col(c).alias(f"{c}_of_block") for c in (key, "block")], F.lag("last").over(w).alias("last_before"), *[total(n, w).alias(f"start_{n}") for n in sums]
    )
    w = Window.partitionBy(key, "block").orderBy(*order)
    ranked = rows.withColumn("first_of_block", F.row_number().over(w) == 1)
    ranked = ranked.withColumns({f"inner_{n}": total(f"value_{n}", w) for n in sums} | {f"inner_{n}": F.lag(f"value_{n}").over(w) for n in before})
    joined = ranked.join(starts, same_block(ranked, starts, [key, "block"]))
    made = {n: F.col(f"inner_{n}") + F.col(f"start_{n}") for n in sums}
    made |= {n: F.when(F.col("first_of_block"), F.col(f"last_before.value_{n}")).otherwise(F.col(f"inner_{n}")) for n in before}
    return joined.select(*[ranked[c] for c in df.columns if c not in made], *[c.alias(n) for n, c in made.items()])


def closings(sums: np.ndarray, budget: int) -> list[int]:
    """For each row, where the next session begins if one begins with it; beyond the last row if it stays open."""
    return np.searchsorted(sums, sums[:-1] + budget, "left").tolist()


def effect(lengths: np.ndarray, budget: int) -> tuple[list[int], list[int], list[int]]:
    """What a key's block does to the session that is open before it, as a step function of how much that holds.

    at (ascending amounts held), and from each on the amount held and the sessions closed behind the block; below the
    first, nothing is closed. Only rows that may close the open session make a step, as from a close on all is settled
    by the block alone: there are no more steps than a session has rows.
    """
    n, sums = len(lengths), np.r_[0, np.cumsum(lengths)]
    then = closings(sums, budget)
    held, closed = [0] * (n + 1), [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        j = then[i]
        held[i], closed[i] = (held[j], closed[j] + 1) if j <= n else (int(sums[n] - sums[i]), 0)
    ends = np.flatnonzero(lengths > 0) + 1
    ends = ends[: int(np.searchsorted(sums[ends], budget, "left")) + 1][::-1].tolist()
    return [max(0, budget - int(sums[e])) for e in ends], [held[e] for e in ends], [closed[e] + 1 for e in ends]


def budget_sessions(df: DataFrame, key: str, order: list[str], length: str, budget: int, state: DataFrame | None = None) -> DataFrame:
    """``df`` with session (0-based), generated (of the session before the row) and held (its length, at most what is left).

    A key's rows fill sessions of ``budget`` one after the other: a session is full once its lengths reach the budget,
    the row that fills it is cut, and the next row begins a new one, so that each start depends on the one before.
    Null and negative lengths count 0. ``state``: key, session and generated of sessions left open before these rows.
    Rows of one key and order must be equal or are taken in any order; a null key is a key.
    """
    if budget < 1:
        raise ValueError(f"a session cannot hold {budget}")
    rows = df.withColumns({"size_": F.greatest(F.coalesce(F.col(length).cast("long"), F.lit(0)), F.lit(0)).cast("long"), "base_": F.lit(0).cast("long"), "given_": F.lit(True)})
    if state is not None:
        carried = state.select(key, F.col("generated").cast("long").alias("size_"), F.col("session").cast("long").alias("base_"), F.lit(False).alias("given_"))
        rows = rows.unionByName(carried, allowMissingColumns=True)
    first = ["given_", *order]
    parts = durable(rows.repartitionByRange(key, *first).sortWithinPartitions(key, *first).withColumn("block", F.spark_partition_id()))
    edges = parts.select("block", key, "size_", "base_").mapInArrow(lambda b: summaries(b, budget), edge_schema(parts, key))
    spanning = edges.withColumn("n", F.count("*").over(Window.partitionBy(key))).where("n > 1").drop("n")
    entry = spanning.repartition(key).sortWithinPartitions(key, "block").mapInArrow(entries, entry_schema(parts, key))
    entry = entry.select(F.col("block").alias("block_of_block"), F.col(key).alias(f"{key}_of_block"), "held_before", "session_before")
    # At most two rows a task: the table is as small as the number of tasks.
    placed = parts.join(F.broadcast(entry), same_block(parts, entry, ["block", key]), "left").drop("block_of_block", f"{key}_of_block")
    names = [c for c in df.columns if c not in ("session", "generated", "held")]
    given = placed.select(key if key not in names else F.col(key).alias("key_"), "size_", "base_", "held_before", "session_before", "given_", *names)
    schema = StructType([*[given.schema[c] for c in ("given_", *names)], *(StructField(c, LongType()) for c in ("session", "generated", "held"))])
    arrow = to_arrow_schema(schema)
    return given.mapInArrow(lambda b: numbered(b, budget, arrow), schema).where("given_").drop("given_")


def edge_schema(df: DataFrame, key: str) -> StructType:
    return StructType([df.schema["block"], df.schema[key], *StructType.fromDDL("total long, base long, at array<long>, held array<long>, closed array<long>").fields])


def entry_schema(df: DataFrame, key: str) -> StructType:
    return StructType([df.schema["block"], df.schema[key], *StructType.fromDDL("held_before long, session_before long").fields])


def key_starts(column: pa.Array) -> np.ndarray:
    """Where a sorted column's values begin, nulls being one value."""
    codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.r_[0, np.flatnonzero(codes[1:] != codes[:-1]) + 1] if len(codes) else np.zeros(0, int)


def summaries(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """The first and the last key's block of a task; keys in between stand in no other task. Numbers only are held."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held).combine_chunks()
    keys = rows.column(1).combine_chunks()
    starts = [*key_starts(keys).tolist(), len(keys)]
    sizes, bases = rows.column(2).to_numpy(), rows.column(3).to_numpy()
    for k in sorted({0, len(starts) - 2}):
        a, b = starts[k], starts[k + 1]
        at, after, closed = effect(sizes[a:b], budget)
        values = [[int(sizes[a:b].sum())], [int(bases[a:b].sum())], [at], [after], [closed]]
        kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3]
        yield pa.RecordBatch.from_arrays([rows.column(0).combine_chunks().slice(a, 1), keys.slice(a, 1), *(pa.array(v, t) for v, t in zip(values, kinds, strict=True))],
                                         names=[*rows.column_names[:2], "total", "base", "at", "held", "closed"])


def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Session and amount held before each block of a key; blocks come in order, one at a time."""
    key, held, session, fresh = None, 0, 0, True
    for batch in batches:
        for i in range(batch.num_rows):
            one = {n: batch.column(n)[i].as_py() for n in ("total", "base", "at", "held", "closed")}
            own = batch.column(1)[i].as_py()
            if fresh or own != key:
                key, held, session, fresh = own, 0, 0, False
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([held], pa.int64()), pa.array([session], pa.int64())],
                                             names=[*batch.schema.names[:2], "held_before", "session_before"])
            place = int(np.searchsorted(one["at"], held, "right")) - 1
            session += one["base"]
            if place < 0:
                held += one["total"]
            else:
                held, session = one["held"][place], session + one["closed"][place]


def numbered(batches: Iterator[pa.RecordBatch], budget: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows with session, generated and held. A batch at a time; between batches the open session is carried."""
    key, held, session, fresh = None, 0, 0, True
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, sizes, bases = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        starts = [*key_starts(keys).tolist(), len(keys)]
        sums = np.r_[0, np.cumsum(sizes)]
        then = closings(sums, budget)
        marks, number, offset = [], [], []  # where sessions begin or go on, which they are, and what they hold already
        for a, b in zip(starts, starts[1:], strict=False):
            own = keys[a].as_py()
            if fresh or own != key:
                key, fresh = own, False
                held, session = batch.column(3)[a].as_py() or 0, batch.column(4)[a].as_py() or 0
            session += int(bases[a:b].sum())
            at, end = a, int(np.searchsorted(sums, sums[a] + budget - held, "left"))
            while True:
                marks.append(at)
                number.append(session)
                offset.append(held)
                if end > b:
                    held += int(sums[b] - sums[at])
                    break
                held, session = 0, session + 1
                if end == b:
                    break
                at, end = end, then[end]
        lengths = np.diff([*marks, len(sizes)])
        inner = sums[:-1] - np.repeat(sums[marks], lengths) + np.repeat(offset, lengths)
        out = [np.repeat(number, lengths), inner, np.minimum(sizes, budget - inner)]
        made = [batch.column(k) for k in range(5, batch.num_columns)]
        yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(made, schema, strict=False)), *(pa.array(o, pa.int64()) for o in out)], schema=schema)


def open_sessions(rows: DataFrame, key: str, order: list[str], budget: int) -> DataFrame:
    """key, session, generated: the session that a key's next row belongs to, from rows of ``budget_sessions``."""
    last = rows.groupBy(key).agg(F.max_by(F.struct("session", (F.col("generated") + F.col("held")).alias("sum")), F.struct("session", "generated", *order)).alias("l"))
    full = F.col("l.sum") >= budget
    return last.select(key, (F.col("l.session") + full.cast("long")).alias("session"), F.when(full, 0).otherwise(F.col("l.sum")).cast("long").alias("generated"))
