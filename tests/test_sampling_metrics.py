"""Splits, samples, allocations, metrics and rules."""

import hashlib

import pytest
from pyspark.sql import functions as F

from seamline.operators import metrics, rules, sampling


def test_md5_mod_is_exact(spark):
    df = spark.range(500).select("id", sampling.md5_mod(F.col("id")).alias("m"), sampling.md5_mod(F.col("id"), 997).alias("p"))
    for r in df.collect():
        n = int(hashlib.md5(str(r.id).encode()).hexdigest(), 16)
        assert (r.m, r.p) == (n % 1000, n % 997)


def test_split_counts():
    assert sampling.split_counts(275, {"train": 3, "valid": 1, "test": 1}) == {"train": 165, "valid": 55, "test": 55}
    assert sampling.largest_remainder(10, [1, 1, 1]) == [4, 3, 3]
    assert sampling.largest_remainder(5, [0, 0]) == [0, 0]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 11, 25])
def test_ratio_split_matches_counts(spark, n):
    ratios = {"train": 3, "valid": 1, "test": 1}
    df = spark.range(1, n + 1).select(sampling.ratio_split(F.col("id"), F.lit(n), ratios).alias("s")).groupBy("s").count()
    assert {r.s: r["count"] for r in df.collect()} == {k: v for k, v in sampling.split_counts(n, ratios).items() if v}


def test_balanced_has_each_source_in_each_split(spark):
    df = spark.createDataFrame([(i, "gum" if i < 9 else "juice") for i in range(14)], "id long, source string")
    got = sampling.balanced(df, "source", "id", F.md5(F.col("id").cast("string")), {"train": 3, "valid": 1, "test": 1})
    assert {(r.source, r.split): r["count"] for r in got.groupBy("source", "split").count().collect()} == {
        (s, p): n for s in ("gum", "juice") for p, n in (("train", 3), ("valid", 1), ("test", 1))
    }
    with pytest.raises(ValueError):
        sampling.balanced(df, "source", "id", F.col("id"), {"train": 1}, 6)


def test_equidistant():
    assert sampling.equidistant(10, 4) == [0, 3, 6, 9]
    assert sampling.equidistant(5, 9) == [0, 1, 2, 3, 4] and sampling.equidistant(5, 1) == [0] and sampling.equidistant(0, 3) == []
    for total in range(2, 40):
        for take in range(2, total):
            assert len(set(sampling.equidistant(total, take))) == take


def test_view_sample_fills_up_without_repeats(spark):
    df = spark.createDataFrame([(i, "a" if i < 3 else "b") for i in range(20)], "id long, view string")
    got = sampling.sample_by_view(df, "view", "id", {"a": 0.5, "b": 0.5}, 10, 1).collect()
    assert len({r.id for r in got}) == 10 and sum(r.view == "a" for r in got) == 3


def test_few_shot_exclusion(spark):
    rows = spark.createDataFrame([("Compute 2+2.",), ("Compute 3+3.",), ("Compute 4+4.",), (None,)], "t string")
    got = sampling.anti_join_text(rows, rows.limit(1), F.lower("t"), F.lower("t"))
    assert sorted(str(r.t) for r in got.collect()) == ["Compute 3+3.", "Compute 4+4.", "None"]


def test_pass_at_k(spark):
    rows = [("t", i < 3) for i in range(10)] + [("u", False)] * 10
    got = {r.k: r.pass_at_k for r in metrics.pass_table(spark.createDataFrame(rows, "task string, ok boolean"), "task", F.col("ok"), (1, 5, 20)).collect()}
    assert got[1] == pytest.approx(0.15) and got[5] == pytest.approx((1 - (7 * 6 * 5 * 4 * 3) / (10 * 9 * 8 * 7 * 6)) / 2) and 20 not in got


def test_ranking_and_gate(spark):
    df = spark.createDataFrame([(100, 0.55, 0.95), (200, 0.60, 0.20), (300, 0.60, 0.40)], "step int, a double, b double")
    got = metrics.ranked(df, [F.desc("a"), F.desc("b"), F.asc("step")]).orderBy("rank").collect()
    assert [r.step for r in got] == [300, 200, 100]
    kept = metrics.gate(df, F.col("b"), F.lit(None).cast("double"), 0.9).collect()
    assert [r.step for r in kept] == [100]
    assert metrics.gate(df, F.col("b"), F.lit(None).cast("double"), 2.0).count() == 3


def test_macro_f1_counts_absent_classes(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a"), ("b", "b")], "p string, g string")
    classes = metrics.per_class(df, "p", "g", ["a", "b", "c"])
    assert metrics.macro_f1(classes).first().macro_f1 == pytest.approx((2 / 3 + 2 / 3 + 0) / 3)


def test_reasons_and_summary(spark):
    df = spark.createDataFrame([("python", 5), (" Python ", 1), ("java", 9), (None, 9), ("", 2)], "language string, n int")
    counts = {r.reason: r.n for r in rules.reason_counts(df, [("language", F.lower(F.trim("language")) != "python"), ("short", F.col("n") < 3)]).collect()}
    assert counts == {"kept": 2, "language": 2, "short": 1}
    s = rules.keep_summary(df, "language", "python").first()
    assert (s.total, s.written, s.skipped, s.missing) == (5, 2, 1, 2)


def test_validation_raises(spark):
    good = spark.createDataFrame([([1.0, 2.0], 1)], "f array<double>, t int")
    assert rules.validate_vectors(good, "f", {"t": 2}).count() == 1
    with pytest.raises(ValueError):
        rules.validate_vectors(good.union(spark.createDataFrame([([1.0], 1)], good.schema)), "f", {"t": 2})
    for bad in ([([float("nan"), 1.0], 1)], [([1.0, 2.0], 5)]):
        with pytest.raises(Exception, match="finite|range"):
            rules.validate_vectors(spark.createDataFrame(bad, good.schema), "f", {"t": 2}).collect()
