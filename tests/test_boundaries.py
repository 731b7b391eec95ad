"""Boundary operators against the published examples."""

from pyspark.sql import functions as F

from seamline.operators import boundaries as B
from seamline.operators import ordering


def test_trace_offsets_and_terminal(spark):
    left = spark.createDataFrame([("a", 0, 5), ("a", 1, 7)], "sample_id string, step int, n int")
    right = spark.createDataFrame([("a", 0, 6), ("a", 1, 6)], "sample_id string, step int, n int")
    sides = [B.drop_terminal(B.trace_offsets(d, "sample_id", ["step"], "n"), "sample_id") for d in (left, right)]
    assert [[r.offset for r in s.collect()] for s in sides] == [[5], [6]]
    sets = [s.groupBy("sample_id").agg(F.collect_set("offset").alias(c)) for s, c in zip(sides, "lr")]
    row = B.overlap_counts(sets[0].join(sets[1], "sample_id"), "l", "r").first()
    assert (row.n_shared, row.left_within_0, row.left_within_1) == (0, 0, 1)


def test_negative_lengths_count_nothing(spark):
    d = spark.createDataFrame([("a", i, n) for i, n in enumerate([3, -2, 4])], "k string, i int, n int")
    assert [r.offset for r in B.trace_offsets(d, "k", ["i"], "n").orderBy("i").collect()] == [3, 3, 7]


def test_expanded_history(spark):
    d = spark.createDataFrame([("s", [3, 4]), ("t", [2, None, 0, 5]), ("u", []), ("v", None)], "sample_id string, h array<int>")
    got = B.expand_history(d, "sample_id", "h", F.lit(10)).orderBy("sample_id", "step_index").collect()
    assert [(r.sample_id, r.step_index, r.generated_length, r.boundary_position) for r in got] == [("s", 0, 0, 12), ("s", 1, 3, 16), ("t", 0, 0, 11), ("t", 3, 2, 16)]


def test_alignment_example(spark):
    a = spark.createDataFrame([("x", p) for p in (5, 10, 20)] + [("y", 1)], "sample_id string, position int")
    b = spark.createDataFrame([("x", p) for p in (5, 12, 20)] + [("z", None)], "sample_id string, position int")
    rows = {r.sample_id: r for r in B.aligned_sets(a, b, "sample_id", "position").withColumn("d", B.mean_nearest(F.col("left_positions"), F.col("right_positions"))).collect()}
    assert rows["x"].left_positions == [5, 10, 20] and round(rows["x"].d, 6) == round(2 / 3, 6)
    assert rows["y"].right_positions == [] and rows["y"].d == 0.0 and "z" not in rows
    m = spark.range(1).select(*[c.alias(n) for n, c in B.overlap_metrics(F.lit(2), F.lit(3), F.lit(3)).items()]).first()
    assert round(m.f1, 6) == round(2 / 3, 6)


def test_nearest_matches_all_pairs(spark):
    a, b = [("k", o) for o in (1, 5, 9, 9, 40)] + [("m", 3)], [("k", o) for o in (4, 8, 41)]
    got = B.nearest_distances(*[spark.createDataFrame(x, "key string, offset long") for x in (a, b)], "key").collect()
    assert sorted((r.key, r.offset, r.distance) for r in got if r.key == "k") == [("k", o, min(abs(o - y) for _, y in b)) for o in (1, 5, 9, 40)]
    assert [r.distance for r in got if r.key == "m"] == [None]


def test_cuts(spark):
    texts = [None, "", "a.b", ".", "no cut", "é😀.x.\ny", "x." * 500]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", B.cut_offsets(F.col("t"), ".").alias("o"), B.cut_offsets(F.col("t"), ".", True).alias("b"))
    for r in df.collect():
        want = [i + 1 for i, c in enumerate(r.t or "") if c == "."]
        assert r.o == want and r.b == [i - 1 for i in want]


def test_match_key(spark):
    a = spark.createDataFrame([("a", 1), ("b", 2)], "sample_id string, request_index int")
    assert B.choose_match_key(a, a) == "sample_id"
    assert B.choose_match_key(a, spark.createDataFrame([("q", 1), ("r", 2)], a.schema)) == "request_index"


def test_ordinals_and_zip(spark):
    df = spark.createDataFrame([(i * 37 % 101,) for i in range(101)], "v int").repartition(7)
    got = sorted((r.v, r.ordinal) for r in ordering.with_ordinal(df, ["v"]).collect())
    assert got == [(i, i) for i in range(101)]
    both = ordering.zip_in_order(df, df.select((F.col("v") * 2).alias("w")), ["v"], ["w"]).collect()
    assert all(r.w == 2 * r.v for r in both)


def test_round_robin_takes_one_of_each(spark):
    strata = ["a", "a", "a", "g", "g", "n", "c", "c"]
    df = spark.createDataFrame(list(enumerate(strata)), "ord int, s string")
    got = [r.s for r in ordering.round_robin(df, ["s"], "ord", 6).orderBy("position").collect()]
    assert got == ["a", "g", "n", "c", "a", "g"]


def test_islands(spark):
    df = spark.createDataFrame([("u", i, v) for i, v in enumerate(["x", "x", None, None, "y", "x"])], "k string, i int, v string")
    assert [(r.v, r.n) for r in ordering.islands(df, "k", ["i"], "v").orderBy("island").collect()] == [("x", 2), (None, 2), ("y", 1), ("x", 1)]
