"""The Jaccard join against all pairs."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seamline.llm import jaccard, skew


def shingles(text, words):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def brute(rows, words, percent):
    sets = [shingles(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            common = len(a & b)
            if a and b and 100 * common >= percent * (len(a) + len(b) - common):
                parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return sorted(((k, len(sets[i]), k if not sets[i] else least.get(root(i))) for i, (k, _) in enumerate(rows)), key=str)


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    passage = [r.choice(words) for _ in range(30)]
    for family in range(12):
        base = [r.choice(words) for _ in range(r.choice([3, 8, 40, 120, 300]))]
        for _ in range(r.choice([1, 2, 6, 25])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4, 9])):
                w[r.randrange(len(w))] = r.choice(words)
            if r.random() < 0.3:
                w += passage
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", " \n", "one", "ONE", "two words", "Two  Words\n", "w " * 5000, "w " * 4000])]
    return rows + [rows[3], (None, rows[4][1]), (None, "lonely text without partner at all")]


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80), (3, 60)])
def test_components_match_all_pairs(spark, words, percent, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 2_000)  # several blocks
    rows = corpus(words * percent)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("member", F.lit("clash")).repartition(5)
    got = jaccard.jaccard_components(df, "doc_id", "text", words, percent).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, words, percent)


def test_shuffled_ways_agree(spark, monkeypatch):
    rows = corpus(7)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    few = sorted(map(str, jaccard.jaccard_components(df, "doc_id", "text", 3, 80).collect()))
    monkeypatch.setattr(skew, "BROADCAST_ROWS", -1)
    assert sorted(map(str, jaccard.jaccard_components(df, "doc_id", "text", 3, 80).collect())) == few


def test_ways_for_large_corpora_agree(spark, monkeypatch):
    """Two steps of dealing, colliding names, spread keys and blocks of pairs, all forced on few rows."""
    rows = corpus(11)[:30]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for module, name, value in [
        (jaccard, "WIDE", 7), (jaccard, "CHARS_PER_BUCKET", 1_000), (jaccard, "BLOCK_SHINGLES", 3_000), (jaccard, "NAME_BITS", 4),
        (jaccard, "MEMBERS_PER_BLOCK", 3), (skew, "HOT_ROWS", 10),
    ]:
        monkeypatch.setattr(module, name, value)
    got = jaccard.jaccard_components(df, "doc_id", "text", 3, 80).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 3, 80)


def test_two_steps_count_as_one(spark, monkeypatch):
    rows = [(i, t) for i, (_, t) in enumerate(corpus(5))]
    docs = spark.createDataFrame(rows, "key long, text string").repartition(9)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 2_000)

    def counts(buckets, wide):
        got = jaccard.fact_rows(docs, 3, buckets, "bigint", pa.int64(), wide)
        counted = got.where("n is null").groupBy("member").agg(F.sum("singles").alias("s")).collect()
        return {r.member: r.s for r in counted}, sorted(r.key for r in got.where("n is not null").collect())

    one = counts(64, 1_000)
    assert counts(5_000, 16) == one and counts(16, 16) == one and len(one[1]) == len(rows)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_components(empty, "doc_id", "text").count() == 0
    assert jaccard.keep_one(empty, "doc_id", "text").count() == 0


def test_keep_one_of_each_group(spark):
    base = " ".join(f"a{i}" for i in range(100))
    rows = [(1, base), (2, base + " x"), (3, "other text that is alone"), (3, "other text that is alone"), (None, base), (4, None), (5, None), (3, "another one with the same id")]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string").withColumn("k", F.lit(1)), "doc_id", "text")
    assert kept.columns == ["doc_id", "text", "k"]
    found = sorted(((r.doc_id, (r.text or "")[:7]) for r in kept.collect()), key=str)
    assert found == sorted([(1, "a0 a1 a"), (3, "other t"), (3, "another"), (4, ""), (5, "")], key=str)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, 2), (5, 2), (9, 9)]
    got = {r.node: r.root for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(101, 161))
    assert got[2] == 1 and got[5] == 1
