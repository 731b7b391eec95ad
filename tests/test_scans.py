"""Running state against plain loops, with all keys small and with one hot key in many blocks."""

import random

import pytest
from pyspark.sql import functions as F

from seamline.operators import boundaries as B
from seamline.operators import scans
from seamline.streaming import state


def events(seed, n=400):
    r = random.Random(seed)
    keys = [None, "a", "b", *["hot"] * 6, *map(str, range(40))]
    return [(r.choice(keys), i, r.choice([None, -2, 0, 0, *range(1, 12)])) for i in r.sample(range(n * 3), n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, i long, n long").repartition(6)


def by_key(rows):
    out = {}
    for k, i, n in sorted(rows, key=lambda r: r[1]):
        out.setdefault(k, []).append((i, n))
    return out


@pytest.mark.parametrize("hot_rows", [1_000, 5])
def test_scan_equals_loop(spark, hot_rows):
    rows = events(1)
    got = scans.scan(frame(spark, rows), "k", ["i"], {"number": F.lit(1), "above": F.coalesce("n", F.lit(0))}, {"last_n": F.col("n"), "last_i": F.col("i")}, hot_rows)
    want = []
    for k, own in by_key(rows).items():
        above, last = 0, (None, None)
        for at, (i, n) in enumerate(own):
            want.append((k, i, n, at, above, *last))
            above, last = above + (n or 0), (n, i)
    assert sorted(map(tuple, got.select("k", "i", "n", "number", "above", "last_n", "last_i").collect()), key=str) == sorted(want, key=str)
    assert got.columns[:3] == ["k", "i", "n"]


def sessions(rows, budget, state=None):
    out, left = [], dict(state or {})
    for k, own in by_key(rows).items():
        session, held = left.get(k, (0, 0))
        for i, n in own:
            n = max(n or 0, 0)
            out.append((k, i, session, held, min(n, budget - held)))
            held += n
            if held >= budget:
                session, held = session + 1, 0
        left[k] = (session, held)
    return sorted(out, key=str), left


@pytest.mark.parametrize("budget", [1, 7, 23, 5_000])
def test_sessions_equal_loop(spark, budget):
    rows = events(budget)
    got = scans.budget_sessions(frame(spark, rows), "k", ["i"], "n", budget)
    assert got.columns == ["k", "i", "n", "session", "generated", "held"]
    got = sorted(map(tuple, got.select("k", "i", "session", "generated", "held").collect()), key=str)
    assert got == sessions(rows, budget)[0]


def test_sessions_of_one_key_over_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        r = random.Random(3)
        rows = [("one", i, r.randint(0, 9)) for i in range(3_000)] + [("two", i, r.randint(0, 9)) for i in range(200)]
        for budget in (10, 64, 100_000):
            df = scans.budget_sessions(frame(spark, rows), "k", ["i"], "n", budget).withColumn("part", F.spark_partition_id())
            got = df.collect()
            assert len({x.part for x in got if x.k == "one"}) >= 4
            assert sorted(((x.k, x.i, x.session, x.generated, x.held) for x in got), key=str) == sessions(rows, budget)[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_sessions_go_on_from_a_state(spark):
    rows = events(5)
    early, late = [x for x in rows if x[1] < 600], [x for x in rows if x[1] >= 600]
    first = scans.budget_sessions(frame(spark, early), "k", ["i"], "n", 17)
    left = scans.open_sessions(first, "k", ["i"], 17)
    assert {r.k: (r.session, r.generated) for r in left.collect()} == sessions(early, 17)[1]
    then = scans.budget_sessions(frame(spark, late), "k", ["i"], "n", 17, left)
    both = sorted(map(tuple, first.unionByName(then).select("k", "i", "session", "generated", "held").collect()), key=str)
    assert both == sessions(rows, 17)[0]


def test_sessions_of_nothing(spark):
    df = frame(spark, []).withColumn("session", F.lit("clash"))
    got = scans.budget_sessions(df, "k", ["i"], "n", 5)
    assert got.collect() == [] and got.columns == ["k", "i", "n", "session", "generated", "held"]
    with pytest.raises(ValueError):
        scans.budget_sessions(df, "k", ["i"], "n", 0)


def test_hot_keys_change_no_result(spark, monkeypatch):
    """Traces, terminal drops and carried scores in two levels equal those of one window."""
    r = random.Random(6)
    rows = [("hot" if i % 2 else str(i % 9), i, [r.random()], [[r.random(), 1.0]], [r.random(), r.random()], r.uniform(-1, 1), r.randint(-1, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t int, s array<double>, v array<array<double>>, h array<double>, g double, n int")
    def made():
        traced = B.trace_offsets(df.select("k", "t", "n"), "k", ["t"], "n")
        return [sorted(map(str, x.collect())) for x in (traced, B.drop_terminal(traced, "k"), state.carry_scores(df, "k", "t", "s", "v", "h", "g", 2.0))]
    plain = made()
    monkeypatch.setattr(scans, "HOT_ROWS", 10)
    assert made() == plain
