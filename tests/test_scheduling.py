"""Window lengths, thresholds by position, stop strings, prompts and scorers against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from seamline.functions import generation as G
from seamline.functions import scheduling as S
from seamline.operators import scoring


def window(tokens, conf, learned, generated, delimiters, gen, default, threshold, weight, learned_threshold, ratio=0.25):
    rest = gen - generated
    n, held = min(max(int(ratio * gen), 1), rest), min(default, rest)
    marks = [c if t in delimiters else 0.0 for t, c in zip(tokens, conf)][: max(n, 0)]
    some = [t in delimiters for t in tokens][: max(n, 0)]
    if n <= 0:
        return held
    if learned is not None and marks:
        mix = [weight * a + (1 - weight) * b for a, b in zip(learned, marks)]
        bar = threshold if learned_threshold is None else learned_threshold
        if mix and bar is not None and max(mix) >= bar:
            return mix.index(max(mix)) + 1
    if not any(some) or threshold is None:
        return held
    return marks.index(max(marks)) + 1 if max(marks) >= threshold else held


@pytest.mark.parametrize(("threshold", "learned_threshold", "weight"), [(0.5, None, 0.5), (0.75, 0.25, 0.25), (None, 0.5, 1.0), (0.25, 0.75, 0.0)])
def test_window_lengths(spark, threshold, learned_threshold, weight):
    r = random.Random(1)
    rows = []
    for i in range(400):
        n = r.choice([0, 1, 3, 8, 20])
        rows.append((i, [r.randrange(4) for _ in range(n)], [r.choice([0.25, 0.5, 0.75, 1.0]) for _ in range(n)], [r.choice([0.0, 0.25, 0.5, 0.75]) for _ in range(n)], r.randrange(0, 33)))
    df = spark.createDataFrame(rows, "i long, t array<int>, c array<double>, l array<double>, g int")
    c = [F.col("t"), F.col("c"), [1, 3], F.lit(32), F.col("g"), F.lit(5)]
    got = df.select("i", S.window_block_length(*c, threshold=threshold).alias("a"), S.window_block_length(*c, threshold=threshold, learned=F.col("l"), weight=weight, learned_threshold=learned_threshold).alias("b"))
    want = [(i, window(t, cc, None, g, [1, 3], 32, 5, threshold, weight, None), window(t, cc, ll, g, [1, 3], 32, 5, threshold, weight, learned_threshold)) for i, t, cc, ll, g in rows]
    assert sorted(map(tuple, got.collect())) == want


def test_thresholds_by_position(spark):
    r = random.Random(2)
    rows = [(i, [r.choice([None, 0.1, 0.5, 0.5, 0.9]) for _ in range(r.randrange(7))], [r.randrange(2) for _ in range(7)], [r.choice([None, 0.0, 0.5, 1.0]) for _ in range(8)], r.randrange(5)) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, c array<double>, m array<int>, t array<double>, s int")
    got = dict(map(tuple, df.select("i", S.transfer_by_position(F.col("c"), F.col("m"), F.col("t"), F.col("s"))).collect()))
    for i, c, m, t, s in rows:
        open_ = [x if k else None for x, k in zip(c, m)]
        top = max((x for x in open_ if x is not None), default=None)
        bar = lambda k: t[s + k] if s + k < len(t) else None
        want = [int(x is not None and (k == open_.index(top) or (bar(k) is not None and x >= bar(k)))) for k, x in enumerate(open_)]
        assert got[i] == want


def cut(text, stops):
    for s in stops:
        if s and s in text:
            text = text.split(s)[0]
    return text.rstrip()


def test_stops_on_ten_thousand_texts(spark):
    r = random.Random(3)
    stops = ["ab", "bc", "abc", "ca b", "", "\n\n", "b\n", "caab", "éa"]
    texts = ["".join(r.choices("abc \né", k=r.randrange(40))) for _ in range(10_000)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "i long, t string")
    for order in (stops, stops[::-1]):
        got = dict(map(tuple, df.select("i", G.cut_at_first_stop(F.col("t"), order)).collect()))
        assert got.pop(-1) is None and got == {i: cut(t, order) for i, t in enumerate(texts)}


def test_generated_texts(spark):
    rows = [("humaneval/1", "humaneval", "", ["  return", " 1", "<|end|>", "\n``", "`", "more"]), ("x", "gsm8k", "#### 4", ["So it is", " 4.", "<|end|>", " STOP", " 9"]), ("x", "math", "", ["a", "<|end|>", " STOP", "b"]), ("x", None, None, [])]
    df = spark.createDataFrame(rows, "id string, s string, g string, t array<string>")
    of = lambda instruct, landing: [r[0] for r in df.select(G.generated_text(F.col("t"), [" STOP"], instruct, F.col("id"), F.col("s"), F.col("g"), ["<|end|>"], landing)).collect()]
    assert of(True, True) == ["  return 1", "So it is 4.\n#### 4", "a", ""]
    assert of(False, False) == ["  return 1\n```more", "So it is 4.", "a", ""]


def test_prompts(spark):
    rows = [("HumanEval/3", None, None, None, None), ("t", "f", "c", None, None), ("t", None, None, ["x"], "d"), (None, "f", None, ["x"], None)]
    df = spark.createDataFrame(rows, "id string, e string, c string, t array<string>, d string").withColumn("q", F.lit("ask \n"))
    code = G.completes_code(*map(F.col, ("id", "e", "c", "t", "d")))
    chat = lambda q: F.concat(F.lit("<user>"), q)
    of = lambda **k: [r[0] for r in df.select(G.generation_prompt(F.col("q"), code, **k)).collect()]
    assert of(instruct=True, chat=chat) == ["ask \n"] * 3 + ["<user>ask \n"]
    assert of(instruct=False, style=" Body_Comment ")[0] == "ask" + G.BODY_COMMENT and of(instruct=False, style="instruction_prefix", chat=chat)[0].endswith("\n\nask \n")
    assert df.select(G.with_prompt(F.col("q"), F.array(F.lit("a"), F.lit("b")))).first()[0] == ["ask \na", "ask \nb"]


DOCS = [(str(i), [5] * (i % 7), float(i)) for i in range(60)] + [("none", None, 0.0)]
SCHEMA = "sample_id string, oracle_block_sizes array<int>, x double"


def sizes_scorer():
    calls = []

    def score(batch):
        calls.append(len(batch))
        assert len(batch) <= 9
        return [sum(c.sizes) * 100 + len(calls) * 0 + c.doc["x"] for c in batch]

    return score


def test_scorer_sees_every_candidate_once(spark):
    df = spark.createDataFrame(DOCS, SCHEMA).repartition(3)
    got = {r.sample_id: r for r in scoring.scored(df, sizes_scorer, scoring.by_delta((-9, 0, 3)), batch=9).collect()}
    for name, sizes, x in DOCS:
        want = [(i, str(d), sum(max(1, s + (d if k == i else 0)) for k, s in enumerate(sizes)) * 100 + x) for i in range(len(sizes or [])) for d in (-9, 0, 3)]
        assert [tuple(s) for s in got[name].scores_] == want and got[name].error_ is None
    maps = scoring.scored(df, sizes_scorer, scoring.by_delta((0,)), batch=9).select("sample_id", scoring.delta_scores().alias("m")).collect()
    assert {r.sample_id: {k: set(v) for k, v in r.m.items()} for r in maps} == {n: {i: {0} for i in range(len(s or []))} for n, s, _ in DOCS}


@pytest.mark.parametrize(("scorer", "says"), [
    (lambda: lambda batch: [1.0] * (len(batch) - 1), "numbers for"), (lambda: lambda batch: [float("nan")] * len(batch), "gave nan"),
    (lambda: lambda batch: [None] * len(batch), "failed on"), (lambda: lambda batch: 1 / 0, "ZeroDivisionError"),
])
def test_scorer_errors_are_typed(spark, scorer, says):
    df = spark.createDataFrame(DOCS, SCHEMA).repartition(1)
    with pytest.raises(Exception, match="ScorerError.*" + says):
        scoring.scored(df, scorer, scoring.by_carry()).collect()
    kept = scoring.scored(df, scorer, scoring.by_carry(), on_error="keep").collect()
    assert all((says in r.error_) == bool(r.oracle_block_sizes) if r.error_ else not r.oracle_block_sizes for r in kept) and all(not r.scores_ for r in kept)


def test_one_bad_batch_leaves_the_others(spark):
    def picky():
        return lambda batch: [1 / (c.doc["x"] - 13) for c in batch]

    kept = scoring.scored(spark.createDataFrame(DOCS, SCHEMA).coalesce(1), picky, scoring.by_carry(), batch=1, on_error="keep").collect()
    assert [r.sample_id for r in kept if r.error_] == ["13"] and sum(len(r.scores_) for r in kept) == 2 * sum(len(s or []) for n, s, _ in DOCS if n != "13")
    with pytest.raises(IndexError):
        scoring.changed([1], 1, 0)
