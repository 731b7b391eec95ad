"""Action segments, and losses against plain arithmetic."""

import math

from pyspark.sql import functions as F

from seamline.functions import losses as L
from seamline.functions.kernels import actions as K


def test_actions():
    assert K.target("First, we multiply to find the total cost:") == "total cost"
    assert K.target("Calculate how many the apples are in the box") == "apples in the box" or K.target("Calculate how many the apples are in the box").startswith("apples")
    assert K.target("Add that number") == "that number" and K.target("Add 2") is None and K.target("") is None
    assert K.paired("Find the sum:", "2 + 3 = 5") == "sum: 2 + 3 = 5"
    assert K.narrated("The bill came out to $5") == "bill: $5" and K.narrated("So he made a profit of $9") == "profit: $9" and K.narrated("Answer: 3") == "Answer: 3"
    assert K.folded(["a)", "x", "(y)", "b."]) == ["a) x (y) b."]
    assert K.action_segments(["Find the sum:", "2 + 3 = 5", "The bill came out to $5"]) == ["sum: 2 + 3 = 5", "bill: $5"]
    assert K.code_boundary("x = 1\nreturn x") == 6 and K.code_boundary("  a\nb") == 4 and K.code_boundary("a\nb") == -1


def test_losses(spark):
    rows = [(2.0, 1.0, 1.0), (-1.0, 0.0, 1.0), (3.0, 0.0, 1.0), (9.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "z double, y double, m double")
    got = df.agg(L.cross_entropy(F.col("z"), F.col("y"), F.col("m"), 2.0).alias("b"), L.focal(F.col("z"), F.col("y"), F.col("m")).alias("f")).first()
    s = lambda z: 1 / (1 + math.exp(-z))
    b = sum(m * (-2 * y * math.log(s(z)) - (1 - y) * math.log(1 - s(z))) for z, y, m in rows) / 3
    f = sum(m * (-y * (1 - s(z)) * math.log(s(z)) - (1 - y) * s(z) ** 4 * math.log(1 - s(z))) for z, y, m in rows) / 3
    assert abs(got.b - b) < 1e-9 and abs(got.f - f) < 1e-9
    c = spark.createDataFrame([([1.0, 2.0], 1, 1.0)], "z array<double>, y int, m double").agg(L.class_entropy(F.col("z"), F.col("y"), F.col("m")).alias("c")).first().c
    assert abs(c - math.log(1 + math.exp(-1))) < 1e-9


def test_array_decisions(spark):
    one = lambda c: spark.range(1).select(c.alias("r")).first().r
    ints = lambda *v: F.array(*map(F.lit, v))
    assert one(L.before_phase_change(ints(1, 2, 2, 3), ints(0, 1, 1, 1))) == 2 and one(L.before_phase_change(ints(1), ints(0))) == 0
    assert one(L.one_hot(ints(1, 0), ints(1, 0), 2)) == [[0.0, 1.0], [0.0, 0.0]]
    assert one(L.dropped_span(ints(5, 6, 7), F.lit(1), F.lit(2), 0, F.lit(True))) == [5, 0, 7]
    assert one(L.noised(ints(5, 6), ints(1, 1), 9, F.lit("k"), 1, 0.0)) == [5, 6]
    assert 9 not in one(L.noised(ints(5), ints(1), 9, F.lit("k"), 1, 1.0))
    assert one(L.phase_threshold(F.lit(0.9), F.lit("x"), {"x": 0.3}, F.lit(0.1), 0.5)) == 1.0
