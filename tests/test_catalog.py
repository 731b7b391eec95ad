"""Functions by name in SQL give what the column functions give."""

import random

import pytest
from pyspark.sql import functions as F

from seamline.functions import catalog as C
from seamline.functions.kernels import code, phases

r = random.Random(1)
WORDS = ["The", "answer", "is 4.", "x = 3", "So", "then", "#### 1,234", "\\boxed{\\frac12}", "it's", "\\n", "\n\n", "Answer: 5", "def f(a):", "\\frac12", "50\\%", '"q"', "é", "\t"]
VALUES = {
    "STRING": [None, "", " "] + [" ".join(r.choices(WORDS, k=r.randrange(1, 12))) for _ in range(40)], "BIGINT": [None, 0, 5, 10**6, 2 * 10**12], "INT": [None, 1, 3, 7],
    "DOUBLE": [None, 0.0, 0.25, 3.5, -2.0], "ARRAY<BIGINT>": [None, [], [3], [1, -2, 5] * 50], "ARRAY<INT>": [None, [], [0, 1, 1], [5, 9, 0, 4]],
    "ARRAY<DOUBLE>": [None, [], [0.5], [0.1, 0.9, 0.9], [0.25, 0.0, 0.75]], "ARRAY<STRING>": [None, [], ["One", " two.", " Three"], ["a,", " b", " c"]],
}


@pytest.fixture(scope="module")
def names(spark):
    return C.register(spark)


@pytest.mark.parametrize("name", C.FUNCTIONS)
def test_sql_equals_columns(spark, names, name):
    f = C.FUNCTIONS[name]
    parameters = [p.strip() for p in C.re.split(r",\s*(?![^<]*>)", f.parameters)]
    rows = [(i, *[r.choice(VALUES[p.split()[1]]) for p in parameters]) for i in range(60)]
    if name == "sm_even_parts":
        rows = [(i, a, s or 1) for i, a, s in rows]
    spark.createDataFrame(rows, "id LONG, " + f.parameters).createOrReplaceTempView("given")
    arguments = ", ".join(p.split()[0] for p in parameters)
    by_sql = spark.sql(f"SELECT id, {name}({arguments}) AS r FROM given").collect()
    by_column = spark.table("given").select("id", f.body().cast(f.returns).alias("r")).collect()
    assert sorted(map(str, by_sql)) == sorted(map(str, by_column)) and len(by_sql) == 60
    assert name in names and "Python" not in spark.sql(f"SELECT {name}({arguments}) FROM given")._jdf.queryExecution().executedPlan().toString()


CODE = ["def f(xs):\n    out = []\n    for x in xs:\n        out.append(x)\n    if not out:\n        return None\n    return out\n", "x = 1\n", "def broken(:\n", None, ""]


def test_table_function(spark, names):
    spark.createDataFrame(list(enumerate(CODE)), "id LONG, c STRING").createOrReplaceTempView("codes")
    got = spark.sql("SELECT id, p.* FROM codes, LATERAL sm_parts(c, 'phases') p").collect()
    assert sorted(map(tuple, got)) == sorted((i, k, *s[:4]) for i, c in enumerate(CODE) if c is not None for k, s in enumerate(phases.label(c)[0]))
    got = spark.sql("SELECT id, p.* FROM codes, LATERAL sm_parts(c, 'segments', 'python') p").collect()
    want = [(i, k, s, found[0]) for i, c in enumerate(CODE) if c is not None and (found := code.segment_code("python", c)) for k, s in enumerate(found[2])]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 1


@pytest.mark.parametrize("call", ["sm_parts('x', 'nothing')", "sm_parts(1, 'phases')", "sm_parts('x', 'phases', 'ruby')", "sm_parts('x', c)"])
def test_table_function_refuses(spark, names, call):
    spark.createDataFrame(list(enumerate(CODE)), "id LONG, c STRING").createOrReplaceTempView("codes")
    with pytest.raises(Exception, match="argument must be|Python only|analyze|correlated|UNRESOLVED|lateral"):
        spark.sql(f"SELECT p.* FROM codes, LATERAL {call} p").collect()


def test_functions_of_ones_own(spark):
    own = {"my_cut": C.stops_function(["STOP", "it's", "\n\n"])}
    assert C.register(spark, own) == ["my_cut", "sm_parts"]
    assert spark.sql("SELECT my_cut('go on STOP it') AS a, my_cut('x it\\'s') AS b, my_cut('none') AS c").first() == (6, 2, 4)
    assert C.sql_of(F.col("a") + 1) == "`+`(a, 1)"
