"""Conversation repair against a plain search over edits, whole and in blocks."""

import hashlib
import random
import re
import zlib
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline.llm import dialogue as D

SF = "/root/testdata/sf0.001"
BLANK = " \t\n\x0b\x0c\r"


def faulted(rows):
    """(role, text, fault) of a conversation's rows in order."""
    seen, out = set(), []
    for _, role, text in rows:
        said = text.strip(BLANK)
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def best(rows, costs):
    """Least (cost, audit, repaired): every edit of every row is tried."""
    rows = faulted(rows)
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    @cache
    def rest(i, last, inserts):
        ways = []
        if i == len(rows):
            if last in ("", "a"):
                ways.append((0, "", ()))
        else:
            role, text, fault = rows[i]
            cost, audit, said = rest(i + 1, last, 0)
            ways.append((cost + costs.delete, "D" + audit, said))
            extra = costs.truncated if fault == "truncated" else 0
            if fault not in ("blank", "duplicate"):
                if role[:1] and role[:1] in follows[last]:
                    cost, audit, said = rest(i + 1, role[:1], 0)
                    ways.append((cost + extra, "K" + audit, ((role, text), *said)))
                for to in follows[last]:
                    if to != "s":
                        cost, audit, said = rest(i + 1, to, 0)
                        ways.append((cost + extra + costs.rerole, "R" + audit, ((name[to], text), *said)))
        if inserts < 3:
            for to in follows[last]:
                if to != "s":
                    cost, audit, said = rest(i, to, inserts + 1)
                    ways.append((cost + costs.insert, "I" + audit, ((name[to], ""), *said)))
        return min(ways, default=(10**9, "", ()))

    return rest(0, "", 0)


def expected(rows, costs):
    """The result for one conversation; rows: (turn, role, text), None read as the operator says."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    cost, audit, said = best(rows, costs)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    faults = [f for _, _, f in faulted(rows)]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest)


def hurt(conv, turn, role, text):
    role, text = " " if role is None else role, " " if text is None else text
    key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
    kind = zlib.crc32(key.encode()) % 20
    if kind == 0:
        return []
    if kind == 1:
        text = ""
    if kind == 2:
        text = re.sub("[.!?]", "", text)
    if kind == 4:
        role = "user"
    return [(turn, role, text)] * (2 if kind == 3 else 1)


def invented(seed, conversations=60, longest=12):
    r = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "u", "abc", "Über"]
    texts = ["Yes.", "no", "", " \t\n", "Ω!", "a? \x0b", "Yes.", "x. ", None, "Long " * 40 + "."]
    out = []
    for c in range(conversations):
        for _ in range(r.randrange(longest + 1)):
            out.append((c or None, r.choice([None, *range(6)]), r.choice(roles), r.choice(texts)))
    return out


def results(df):
    return {r.conv: tuple(r)[1:] for r in df.collect()}


def by_conversation(rows):
    out = {}
    for c, *rest in rows:
        out.setdefault(c, []).append(tuple(rest))
    return out


SCHEMA = "conv_id long, turn long, role string, text string"
COSTS = [D.Costs(), D.Costs(rerole=3, delete=4, insert=1, truncated=1), D.Costs(rerole=9, delete=5, insert=2, truncated=0)]


@pytest.mark.parametrize("costs", COSTS)
def test_repair_equals_search(spark, costs):
    rows = invented(1)
    got = results(D.repair(spark.createDataFrame(rows, SCHEMA).repartition(5), "conv_id", "turn", "role", "text", costs=costs))
    assert got == {c: expected(own, costs) for c, own in by_conversation(rows).items()}


@pytest.mark.parametrize("costs", COSTS[:2])
def test_blocks_equal_search(spark, monkeypatch, costs):
    monkeypatch.setattr(D, "LONG_ROWS", 4)
    monkeypatch.setattr(D, "BLOCK", 3)
    rows = invented(2, 25, 30) + [(99, 1, "user", "Again.")] * 40 + [(98, k, "user", "Again.") for k in range(40)]
    got = results(D.repair(spark.createDataFrame(rows, SCHEMA), "conv_id", "turn", "role", "text", costs=costs))
    assert got == {c: expected(own, costs) for c, own in by_conversation(rows).items()}


def test_query_equals_search(spark):
    given = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {}
    for c, turn, role, text in given:
        want.setdefault(c, []).extend(hurt(c, turn, role, text))
    got = {r.conv_id: tuple(r)[1:] for r in D.op11_conversation_repair(spark, SF).collect()}
    assert got == {c: expected(rows, D.Costs()) for c, rows in want.items()}
    assert len({audit for *_, audit, _ in got.values()}) > 5


def test_damage_with_nulls_and_clashing_names(spark):
    rows = [(c, t, r, x, "k", 7) for c, t, r, x in invented(3, 200, 4)]
    df = spark.createDataFrame(rows, SCHEMA + ", cost string, conv int")
    want = {}
    for c, t, r, x, *_ in rows:
        want.setdefault(c, []).extend(hurt(c, t, r, x))
    got = results(D.repair(D.damaged(df), "conv_id", "turn", "role", "text", F.col("there")))
    assert got == {c: expected(own, D.Costs()) for c, own in want.items()}
    assert any(not own for own in want.values())


def test_empty_and_very_long(spark):
    assert D.repair(spark.createDataFrame([], SCHEMA), "conv_id", "turn", "role", "text").collect() == []
    rows = [(1, 0, "user", "x" * 9_000_000 + "."), (1, 1, "assistant", "y."), (2, 0, "assistant", " " * 2_000_000)]
    got = results(D.repair(spark.createDataFrame(rows, SCHEMA), "conv_id", "turn", "role", "text"))
    assert got == {c: expected(own, D.Costs()) for c, own in by_conversation(rows).items()}


def test_turns_of_repaired_conversations(spark):
    rows = [r for r in invented(4) if r[0] is not None]
    got = {}
    for r in D.repaired_turns(spark.createDataFrame(rows, SCHEMA), "conv_id", "turn", "role", "text").orderBy("conv", "position").collect():
        got.setdefault(r.conv, []).append(f"{r.role}:{r.text}")
    for c, own in by_conversation(rows).items():
        assert hashlib.sha256("\n".join(got.get(c, [])).encode()).hexdigest() == expected(own, D.Costs())[-1]


def test_thousands_of_turns_are_split(spark):
    r = random.Random(5)
    rows = [(1, k, r.choice(["user", "assistant"]), r.choice(["Aha.", f"{k}.", f"{k}", ""])) for k in range(9_000)]
    machine, df = D.Machine(D.Costs()), spark.createDataFrame(rows, SCHEMA)
    (got,) = results(D.repair(df, "conv_id", "turn", "role", "text")).values()
    whole = faulted([x[1:] for x in rows])
    steps = np.array([3 * "sua".index(role[0]) + {"": 0, "truncated": 2}.get(f, 1) for role, _, f in whole])
    cost, audits = D.repair_steps(machine, steps, np.array([0]), np.array([len(steps)]))
    assert got[5] == cost[0] and got[6] == audits[0].decode()
