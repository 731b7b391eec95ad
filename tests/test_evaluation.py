"""Documents of a mathematics evaluation and small record functions against plain Python."""

import random
import re

from pyspark.sql import functions as F

from seamline.functions import records as R
from seamline.operators import evaluation as E

SCHEMA = "position long, problem string, solution string, subject string, level string, unique_id string"


def norm(text):
    return " ".join(re.sub(r"[^a-z0-9 ]+", " ", re.sub(r"\s+", " ", (text or "").lower().strip())).split())


def chosen(train, tests, count):
    gone, picked, subjects = {norm(t[1]) for t in tests} - {""}, [], set()
    rows = [((r[1] or "").strip(), (r[2] or "").strip(), (r[3] or "").strip().lower()) for r in train]
    rows = [r for r in rows if r[0] and norm(r[0]) not in gone]
    for q, a, s in rows:
        if s not in subjects:
            subjects.add(s)
            picked.append((q, a))
    for q, a, _ in rows:
        if (q, a) not in picked:
            picked.append((q, a))
    return picked[:count]


def in_turn(tests, limit):
    if limit is None or limit >= len(tests):
        return tests
    groups, out = {}, []
    for t in tests:
        groups.setdefault((t[3] or "", t[4] or ""), []).append(t)
    while len(out) < limit:
        for g in groups.values():
            if g and len(out) < limit:
                out.append(g.pop(0))
    return out


def test_documents_of_an_evaluation(spark):
    r = random.Random(1)
    make = lambda n: [(i, r.choice([" Add 1 & 2? ", "add  1 2", "Sum up", "What is x", None, " ", f"No. {i}"]), r.choice(["x = 3", "Then\n\\boxed{4}", None]), r.choice(["A", "a ", "B", None]), r.choice(["1", "2", None]), r.choice([None, "", f"id{i}"])) for i in range(n)]
    for limit in (None, 0, 7, 100):
        train, tests = make(30), make(25)
        dfs = [spark.createDataFrame(x, SCHEMA).repartition(3) for x in (train, tests)]
        got = E.math_documents(*dfs, examples=5, limit=limit).collect()
        shown = "".join(f"Problem: {q}\nAnswer: {a}".rstrip() + "\n\n" for q, a in chosen(train, tests, 5))
        want = {t[5] or f"math/test/{i}": (t[3] or "", t[4] or "", t[1] and shown + f"Problem: {t[1].strip()}\nAnswer:") for i, t in enumerate(in_turn(tests, limit))}
        assert {d.sample_id: (d.subject, d.level, d.prompt_text) if d.problem is not None else (d.subject, d.level, None) for d in got} == want
    assert E.math_documents(dfs[0].limit(0), dfs[1].limit(0), 3).collect() == []


def test_small_record_functions(spark):
    df = spark.createDataFrame([(1, "a,b", None, ["x"], "so \\boxed{7}"), (2, None, 0.5, None, "no box")], "i int, s string, d double, t array<string>, solution string")
    assert [x.answer for x in E.with_answers(df).orderBy("i").collect()] == ["7", None]
    options = R.option_text({"path": F.col("s"), "steps": 4, "none": None, "on": True, "lengths": F.col("s")}, lists=("lengths",))
    assert [x[0] for x in df.orderBy("i").select(options).collect()] == ["path=a,b,steps=4,on=True,lengths=a|b", "steps=4,on=True"]
    assert [x[0] for x in df.orderBy("i").select(R.count_of(F.col("t"))).collect()] == [1, 0]
    assert [x[0] for x in df.orderBy("i").select(R.as_json(["i", "d"])).collect()] == ['{"i":1,"d":null}', '{"i":2,"d":0.5}']
    tokens = lambda s: {"\n": [], " ": [3], "##": [1, 2]}.get(s, [])
    assert df.select(R.separator_tokens(tokens, "##"), R.separator_tokens(tokens), R.separator_tokens(lambda _: [])).first() == ([1, 2], [3], [])


def test_records_of_an_evaluation(spark):
    schema = "sample_id string, source_dataset string, gold_solution string, prediction string, oracle_block_sizes array<int>, has_final_answer_anchor boolean, segments array<string>, block_history array<int>, nfe_history array<int>, predicted_deltas map<int,int>, carry_mask array<int>, question string, problem string, subject string, level string"
    rows = [
        ("a", "gsm8k", "#### 4", "It is 4.", [3, 5, 9], True, ["x", "y", "z"], [4, 4], [2, 3], {0: 1, 1: -2}, [1, 0, 1], "q", "p", "s", None),
        ("b", "gsm8k", "#### 4", None, None, None, None, None, None, None, None, None, None, None, None), ("c", "gsm8k", None, "\\boxed{\\frac{1}{2}}", [7], False, ["x"], [7], [1], None, [0], "q", "p", None, "1"),
    ]
    docs = spark.createDataFrame(rows, schema)
    got = {r.sample_id: r for r in E.evaluated(docs, "gsm8k", 10).collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a.is_correct, a.oracle_block_count, a.generation_length, a.segment_count, a.predicted_delta_count, a.carry_on_boundary_count, a.carry_rate, a.question) == (True, 3, 10, 3, 2, 2, 1.0, "q")
    assert (b.is_correct, b.oracle_block_sizes, b.generation_length, b.segment_count, b.prior_correction_applied, b.boundary_gate_applied, b.carry_rate, b.question) == (False, [], 10, 0, False, False, 0.0, "")
    assert (c.is_correct, c.carry_rate, c.prior_correction_applied, c.boundary_gate_applied) == (False, 0.0, False, True)
    maths = {r.sample_id: r for r in E.evaluated(docs.where("sample_id = 'c'").withColumn("gold_solution", F.lit("So $1/2$")), "math").collect()}
    assert maths["c"].is_correct and (maths["c"].subject, maths["c"].level) == ("", "1")
    (s,) = E.evaluation_summary(E.evaluated(docs, "gsm8k")).collect()
    assert (s.n, round(s.accuracy, 6), s.carry_on_boundary_count, s.carry_rate, s.nfe, s.boundary_gate_applied_doc_count) == (3, 0.333333, 2, 1.0, 6, 2)
    assert E.evaluation_summary(E.evaluated(docs.limit(0), "math")).collect() == []
    m = spark.range(1).select(E.training_metadata({"max_length": F.lit(5)}, {"global_step": F.lit(7)}).alias("m")).first().m
    assert (m.max_length, m.global_step, m.label_semantics) == (5, 7, "boundary_after_token")
