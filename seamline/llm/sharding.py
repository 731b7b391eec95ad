"""Sharding by minimax contiguous partition (DataFrame operations only).

Rows with equal texts form one atomic group. Groups are ordered by the 64-bit hash of the text, so
an ordered run of groups is a hash range and its size is one grouped sum; no sort of the corpus is
needed. The smallest feasible shard capacity is found by binary search, each candidate being checked
greedily over the ordered sizes, and the ranges are cut there.

The driver never sees all groups. It starts with 4,096 hash ranges and keeps two answers per search:
one treats a range as a single atom (too pessimistic), the other as divisible between its groups (too
optimistic). While the two differ, only the ranges that a cut can fall into are split 16 ways and
summed again by Spark. What the driver holds is bounded by shards times levels, whatever the corpus.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.llm.ranking import number_rows
from seamline.session import durable

FIRST_SHIFT = 52
STEP_BITS = 4
ROWS_PER_DEAL = 50_000


@dataclass(frozen=True)
class Run:
    """A run of adjacent groups: the hashes of its first and last one, and its size."""

    low: int
    high: int
    size: int

    @property
    def atomic(self) -> bool:
        return self.low == self.high


def greedy_cuts(runs: list[Run], ends: list[int], capacity: int, shards: int, divisible: bool) -> list[int]:
    """Where greedy filling ends each shard. ``divisible``: runs of several groups can be cut anywhere."""
    cuts, at = [], 0
    for _ in range(shards):
        k = bisect_right(ends, at + capacity)
        reach = ends[k - 1] if k else 0
        if divisible and k < len(runs) and not runs[k].atomic:
            reach = at + capacity
        at = max(at, reach)
        cuts.append(at)
    return cuts


def least_capacity(runs: list[Run], ends: list[int], shards: int, divisible: bool) -> int:
    """Binary search for the smallest capacity whose greedy filling takes everything in."""
    low = max([-(-ends[-1] // shards), *(r.size for r in runs if r.atomic or not divisible)])
    high = ends[-1]
    while low < high:
        middle = (low + high) // 2
        if greedy_cuts(runs, ends, middle, shards, divisible)[-1] >= ends[-1]:
            high = middle
        else:
            low = middle + 1
    return low


def open_ranges(runs: list[Run], ends: list[int], low: int, high: int, shards: int) -> list[tuple[int, int]]:
    """Index ranges of runs that hold several groups and that some cut between both answers can enter."""
    firsts = greedy_cuts(runs, ends, low, shards, False)
    lasts = greedy_cuts(runs, ends, high, shards, True)
    found: list[tuple[int, int]] = []
    for a, b in sorted(zip(firsts, lasts, strict=True)):
        i, j = bisect_right(ends, a), min(bisect_left(ends, b), len(runs) - 1)
        loose = [k for k in range(i, j + 1) if not runs[k].atomic]
        if loose:
            i, j = loose[0], loose[-1]
            if found and i <= found[-1][1] + 1:
                found[-1] = (found[-1][0], max(found[-1][1], j))
            else:
                found.append((i, j))
    return found


def even_cuts(ends: list[int], capacity: int, shards: int) -> list[int]:
    """Among the partitions within ``capacity``, one whose shards are near equal.

    Each cut goes to the boundary next to an equal share of what is left, within the reach of the
    capacity and not before the point from which the other shards still hold the rest.
    """
    least = [ends[-1]]
    for _ in range(shards - 1):
        k = bisect_left(ends, least[-1] - capacity)
        least.append(0 if least[-1] <= capacity else ends[k])
    least.reverse()
    cuts, at = [], 0
    for shard in range(shards - 1):
        goal = at + (ends[-1] - at) / (shards - shard)
        k = bisect_left(ends, goal)
        near = min((ends[i] for i in (k - 1, k) if 0 <= i < len(ends)), key=lambda e: abs(e - goal))
        k = bisect_right(ends, at + capacity)
        reach = ends[k - 1] if k else at
        at = max(at, min(max(near, least[shard]), reach))
        cuts.append(at)
    return cuts


def minimax_bounds(sizes: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The least capacity and the last hash of each shard but the final one.

    ``sizes`` has ``group_hash`` and ``size``; any number of rows may share a hash.
    """

    def runs_of(part: DataFrame, shift: int) -> list[Run]:
        block = F.shiftright("group_hash", shift) if shift else F.col("group_hash")
        rows = (
            part.groupBy(block.alias("block"))
            .agg(F.min("group_hash").alias("low"), F.max("group_hash").alias("high"), F.sum("size").alias("size"))
            .collect()
        )
        return sorted((Run(r.low, r.high, r["size"]) for r in rows), key=lambda r: r.low)

    shift = FIRST_SHIFT
    runs = runs_of(sizes, shift)
    if not runs:
        return 0, []
    while True:
        ends = list(accumulate(r.size for r in runs))
        low, high = (least_capacity(runs, ends, shards, d) for d in (True, False))
        ranges = open_ranges(runs, ends, low, high, shards) if low < high else []
        if not ranges:
            break
        shift = max(0, shift - STEP_BITS)
        within = F.lit(False)
        for i, j in ranges:
            within = within | F.col("group_hash").between(runs[i].low, runs[j].high)
        finer = runs_of(sizes.where(within), shift)
        kept = [r for k, r in enumerate(runs) if not any(i <= k <= j for i, j in ranges)]
        runs = sorted(kept + finer, key=lambda r: r.low)
    at = {0: None} | {e: r.high for e, r in zip(ends, runs, strict=True)}
    lowest = -(2**63)
    return high, [lowest if at[c] is None else at[c] for c in even_cuts(ends, high, shards)]


def shard_rows(df: DataFrame, group: Column, size: Column, shards: int = 40) -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 within a shard).

    Rows with equal ``group`` (null being one value) share a shard; the largest shard is as small as
    contiguous hash order allows. Two groups whose 64-bit hashes collide stay together. Slots follow a
    deal of the rows by a hash of their columns, so that no task numbers a whole shard or group;
    repeated rows get slots next to each other in any order. An empty ``df`` stays empty. Columns of ``df``
    that have the name of one made here (shard, slot, group_hash, _size, deal) are replaced
    or go. ``df`` should be narrow: it is materialised once and shuffled once.
    """
    own = {"group_hash", "_size", "deal", "shard", "slot"}
    named = [c for c in df.columns if c.lower() not in own]
    plain = [c for c, kind in df.dtypes if c in named and not kind.startswith("map")]
    base = durable(df.select(*named, F.xxhash64(group).alias("group_hash"), size.cast("long").alias("_size")))
    capacity, bounds = minimax_bounds(base.select("group_hash", F.col("_size").alias("size")), shards)
    shard = F.lit(0)
    for b in bounds:
        shard = shard + (F.col("group_hash") > b).cast("int")
    deals = max(16, -(-base.count() // (shards * ROWS_PER_DEAL)))
    spread = F.xxhash64("group_hash", *plain)
    dealt = base.select(*named, "group_hash", shard.alias("shard"), F.pmod(spread, F.lit(deals)).alias("deal"))
    numbered = number_rows(dealt, ["shard"], "deal", ["group_hash", *plain], "slot")
    return numbered.select(*named, "shard", (F.col("slot") - 1).alias("slot"))


def op1_minimax_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes, equal texts together.

    A null text has size 16 and checksum 0, like an empty one, but is a group of its own.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    octets = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    narrow = docs.select(
        "doc_id",
        (octets + 16).alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64("text").alias("text_hash"),
    )
    return shard_rows(narrow, F.col("text_hash"), F.col("size"), 40).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
