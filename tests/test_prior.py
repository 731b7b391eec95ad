"""Block lengths from windows of tokens."""

import random
import re

import pytest
from pyspark.sql import functions as F

from seamline.functions import prior as P

WINDOWS = [
    (["We", " add", " 2.", " Then", ","], 3, 5, 9), (["First", ",", " so", " it"], 2, 3, 9), (["So", " we", " get", "\n", "x"], 9, 4, 9),
    (["x", " = 1", "\n", "return", " x"], 9, 3, 4), (["  a", "\n", "b"], 9, 2, 3), (["<<2+", "2=4>>", "4"], 9, 2, 9), ([], 9, 9, 9), (["so", "me", " of"], 9, 9, 9),
]


def test_lengths(spark):
    df = spark.createDataFrame([(i, *w) for i, w in enumerate(WINDOWS)], "i int, t array<string>, s long, m long, c long")
    nine = F.lit(9)
    got = df.select("*", P.sentence_length(F.col("t"), nine).alias("gs"), P.step_length(F.col("t"), nine).alias("gm"), P.code_length(F.col("t"), nine).alias("gc")).collect()
    for r in got:
        assert (r.gs, r.gc) == (r.s, r.c), r
    assert [r.gm for r in got[1:4]] == [3, 4, 3] and got[5].gm == 2 and got[6].gm == 9 and got[7].gm == 9


def test_parts(spark):
    one = lambda c: spark.range(1).select(c.alias("r")).first().r
    ints = lambda *v: F.array(*map(F.lit, v))
    assert one(P.planned_length(ints(5, 50), F.lit(1), 8, 30, F.lit(5))) == 25 and one(P.planned_length(ints(5), F.lit(3), 8, 30, F.lit(5))) == 8
    assert one(P.planned_length(ints(5), F.lit(0), 8, 30, F.lit(30))) == 0
    assert [tuple(x) for x in one(P.endpoint_scores(F.array(F.lit(0.1), F.lit(0.9)), ints(0, 2, 3)))] == [(2, 0.9, 1)]
    assert one(P.item_list(F.lit("[a| b,,c]"))) == ["a", "b", "c"] and one(P.item_list(F.lit(" "))) is None and one(P.item_list(F.lit("[]"))) == []
    assert one(P.accepted_offsets(F.expr("array(named_struct('offset', 3, 'accepted', true), named_struct('offset', 5, 'accepted', false))"))) == [3]
    assert P.bucket_ranges() == [(0, 49), (50, 99), (100, 163)]
    with pytest.raises(ValueError):
        P.bucket_ranges([(5, 2)])


def plain_first(tokens, pattern):
    return next((i for i in range(1, len(tokens) + 1) if re.search(pattern, "".join(tokens[:i]))), None)


def test_rules_equal_all_beginnings(spark):
    """Each rule against its pattern on every beginning of windows whose tokens cut words, marks and connectives."""
    r = random.Random(4)
    bits = ["so", "me", " so", "al", "We", " have", "we hav", "e", " it", " follows", "<", "<<", "2+2", ">", ">>", "#", "##", ".", "?", " ", "\n", ",", ";", "x", " there", "fore", "\nde", "f", "ault", "  a", "return", "\n ", "", "Thus", "hence "]
    windows = [[r.choice(bits) for _ in range(r.randrange(0, 12))] for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(windows)), "i int, t array<string>")
    none = F.lit(-1)
    got = df.select("i", P.sentence_length(F.col("t"), none).alias("s"), P.step_length(F.col("t"), none).alias("m"), P.code_length(F.col("t"), none).alias("c")).collect()
    connective = rf"(?i)\b(?:{P.CONNECTIVES})\b"
    code = rf"\n[^\S\n]*(?:{P.CODE_WORDS})\b|(?:^|\n)[^\S\n][^\n]*\n\S"
    for x in got:
        t = windows[x.i]
        s = plain_first(t, P.SENTENCE) or plain_first(t, P.CLAUSE) or -1
        k = plain_first(t, connective)
        if k and re.match(connective, "".join(t[:k])):
            k = None
        m = min([p for p in (plain_first(t, P.MARKER), k, plain_first(t, "\n")) if p], default=-1)
        assert (x.s, x.m, x.c) == (s, m, plain_first(t, code) or -1), t


def test_first_tokens(spark):
    values = [None, "", "  ", " a b\n c ", "one", "w " * 200_000, " " * 500_000 + "x y"]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    got = {r.i: r.t for r in df.select("i", P.first_tokens(F.col("v"), 2).alias("t")).collect()}
    assert got == {0: [], 1: [], 2: [], 3: [" a", " b"], 4: ["one"], 5: ["w", " w"], 6: [" " * 500_000 + "x", " y"]}
