"""Sharding and mixing against brute force, and their edge cases."""

import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from seamline.llm import mixing, sharding
from seamline.llm.words import word_count

SCHEMA = "doc_id long, text string, source string"


def least_max(sizes, shards):
    """Smallest possible greatest part of a contiguous partition, by dynamic programming."""
    sums = [0, *accumulate(sizes)]
    best = [0] + [10**18] * len(sizes)
    for _ in range(shards):
        best = [0] + [min(max(best[i], sums[j] - sums[i]) for i in range(j + 1)) for j in range(1, len(sums))]
    return best[-1]


@pytest.mark.parametrize("seed", range(4))
def test_capacity_is_minimal_at_every_level(spark, seed, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST_SHIFT", 61)  # few first ranges, so that several are refined
    r = random.Random(seed)
    groups = {r.getrandbits(64) - 2**63: r.choice([1, 5, 30, 200]) for _ in range(120)}
    rows = spark.createDataFrame([(h, s) for h, s in groups.items()], "group_hash long, size long")
    sizes = [groups[h] for h in sorted(groups)]
    for shards in (1, 3, 7):
        capacity, bounds = sharding.minimax_bounds(rows, shards)
        assert capacity == least_max(sizes, shards)
        parts = [0] * shards
        for h, s in groups.items():
            parts[sum(h > b for b in bounds)] += s
        assert max(parts) <= capacity


def test_shards_keep_groups_and_number_rows(spark):
    rows = [(i, f"text {i % 7}" if i % 3 else None, "a") for i in range(200)] + [(5, "same", "a")] * 3 + [(None, "", None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("shard", F.lit("clash")).withColumn("deal", F.lit(1))
    got = sharding.shard_rows(df, F.col("text"), F.coalesce(F.octet_length("text"), F.lit(0)) + 16, 5).collect()
    assert len(got) == len(rows)
    by_text, slots = {}, {}
    for r in got:
        by_text.setdefault(r.text, set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(0 <= s < 5 for s in slots)


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert sharding.shard_rows(empty, F.col("text"), F.lit(1), 3).count() == 0
    assert mixing.mix(empty, "doc_id", F.col("source"), word_count(F.col("text"))).count() == 0


def brute_targets(sizes, share=1.5, most=2.0):
    """Targets by repeated resharing of what is above the cap."""
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    out, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > most * sizes[s]]
        if not over:
            out |= {s: level * weight[s] for s in free}
            break
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_mix_meets_targets(spark, seed):
    r = random.Random(seed)
    rows = []
    for source, n in (("b", 300), ("a", 40), ("ä", 60), (None, 30), ("z", 5)):
        rows += [(len(rows) + i, " ".join(["w"] * r.choice([1, 3, 10, 40, 200])), source) for i in range(n)]
    rows += [(900, None, "a"), (901, "", "b"), (902, " \t\n", "b"), (5, rows[5][1], "b")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("extra", F.lit("clash")).withColumn("target", F.lit("clash"))
    size = word_count(F.col("text"))
    got = mixing.mix(df, "doc_id", F.col("source"), size).collect()
    assert sorted(str((x.row.doc_id, x.row.text)) for x in got) == sorted(str(x[:2]) for x in rows)
    sizes, taken, target = {}, {}, {}
    for x in got:
        assert 0 <= x.copies <= 2
        sizes[x.source] = sizes.get(x.source, 0) + x.size
        taken[x.source] = taken.get(x.source, 0) + x.size * x.copies
        target[x.source] = x.target
    for s, t in brute_targets(sizes).items():
        assert target[s] == pytest.approx(t)
        assert abs(taken[s] - t) <= max(2, 0.03 * t)
    again = mixing.mix(df, "doc_id", F.col("source"), size).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_word_count_is_split(spark):
    texts = [None, "", " ", "a", " a", "a ", "a b", "\ta\x0b\x0cb\r\n", "é x y", "\n\n", "x" * 50_000, "a " * 30_000]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", word_count(F.col("text")).alias("n"))
    for r in df.collect():
        assert r.n == len((r.text or "").encode().split())
