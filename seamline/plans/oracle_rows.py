"""Rows that teach gates and corrections, and labelled code, made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.operators import evaluation as E
from seamline.operators import oracle_rows as O
from seamline.operators import training_rows as T
from seamline.session import table

QUESTION = "How many parts of size {}?"
#: What is counted, one after the other; a part has one to four of them.
COUNTED = ("boxes", "crates on the ship", "pallets", "lids")


def order_documents(spark, sf: str) -> DataFrame:
    """Orders as documents: quantities as sizes, quantity and discount as features, prices as ``value`` in line order."""
    line = F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q"), F.col("l_discount").cast("double").alias("d"), F.col("l_extendedprice").cast("double").alias("p"))
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("r"))
    return rows.select(
        F.col("l_orderkey").cast("string").alias("sample_id"), F.lit(None).cast("string").alias("source_dataset"), F.lit(None).cast("boolean").alias("has_final_answer_anchor"),
        F.transform("r", lambda x: x["q"]).alias("oracle_block_sizes"), F.transform("r", lambda x: F.array(x["q"].cast("double"), x["d"])).alias("features"), F.transform("r", lambda x: x["p"]).alias("value"),
    )


def q75_gate_rows(spark, sf: str) -> DataFrame:
    """Gate targets; carrying scores the line's price, not carrying 30,000, and lines at even places have no scores."""
    pair = F.transform("value", lambda p, i: F.struct(i.alias("key"), F.struct(p.alias("carry_on"), F.lit(30000.0).alias("carry_off")).alias("value")))
    docs = O.several_blocks(order_documents(spark, sf).withColumn("scores", F.map_from_entries(F.filter(pair, lambda e: e["key"] % 2 == 1))))
    rows = O.gate_rows(docs)
    return rows.select("sample_id", "transition_index", "gate_target", F.col("gate_scores.carry_on").alias("carry_on"), F.get("features", 0).alias("feature"), F.size("oracle_block_sizes").alias("n_blocks"))


def q76_correction_rows(spark, sf: str) -> DataFrame:
    """Best deltas; -1 scores the price, 0 a flat 30,000, 2 the price of ten times the quantity, even places none."""
    of = lambda p, i: F.create_map(F.lit(-1), p, F.lit(0), F.lit(30000.0), F.lit(2), F.get("oracle_block_sizes", i) * F.lit(1000.0))
    entry = F.transform("value", lambda p, i: F.struct(i.alias("key"), of(p, i).alias("value")))
    docs = order_documents(spark, sf).withColumn("scores", F.map_from_entries(F.filter(entry, lambda e: e["key"] % 2 == 1)))
    return O.correction_rows(docs).select("sample_id", "boundary_index", "best_delta", "gate_target", "delta_target", "source_dataset")


def q77_oracle_documents(spark, sf: str) -> DataFrame:
    """Parts' sizes as questions with worked answers of two to five steps: blocks, and what lies around their ends."""
    n, size = F.col("p_size"), F.col("p_size").cast("string")
    counts = [F.when(F.col("p_partkey") % 4 >= i, F.format_string(f"Find the number of {what}:\n%d + {i} = %d\n", n, n + i)).otherwise("") for i, what in enumerate(COUNTED)]
    asked = table(spark, sf, "part").select(
        F.col("p_partkey").alias("position"), F.replace(F.lit(QUESTION), F.lit("{}"), size).alias("question"),
        F.concat(*counts, F.format_string("The total came out to %d.", n + 1)).alias("answer"),
    )
    docs = O.question_documents(asked, "part/train", F.lit(None).cast("array<struct<question:string,answer:string>>"))
    return docs.select("sample_id", "prompt_text", F.array_join("segments", "|").alias("steps"), F.size("oracle_block_sizes").alias("n_blocks"),
                       F.size(F.flatten(F.transform("oracle_prior_boundary_points", lambda x: x["candidate_indices"]))).alias("n_candidates"))


EXAMPLES, TASKS = 4, 60


def part_problems(spark, sf: str) -> DataFrame:
    """Parts as problems: their names ask, sizes answer; types are subjects and brands levels. Every sixteenth has an id."""
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    return table(spark, sf, "part").select(
        k.alias("position"), F.concat(F.lit("How large is the "), "p_name", F.lit(", in "), (k % 50).cast("string"), F.lit("?")).alias("problem"),
        F.concat(F.lit("It is = "), n, F.lit(".\nSo \\boxed{"), n, F.lit("}")).alias("solution"), F.col("p_type").alias("subject"), F.col("p_brand").alias("level"),
        F.when(k % 16 == 0, F.concat(F.lit("u"), k.cast("string"))).alias("unique_id"),
    )


def q90_math_documents(spark, sf: str) -> DataFrame:
    """Sixty parts with odd keys as tasks, in turn by type and brand, with four worked examples of parts with even keys."""
    rows = part_problems(spark, sf)
    docs = E.math_documents(rows.where("position % 2 = 0"), rows.where("position % 2 = 1"), EXAMPLES, TASKS)
    return docs.select("sample_id", "subject", "level", F.md5("prompt_text").alias("prompt"), F.size("oracle_block_sizes").alias("n_blocks"))


def q91_evaluation_summary(spark, sf: str) -> DataFrame:
    """All parts as tasks; every third prediction is wrong, every fifth missing, gates carry at even keys."""
    rows = part_problems(spark, sf).withColumn("unique_id", F.concat(F.lit("u"), F.col("position").cast("string")))
    docs = E.math_documents(rows.limit(0), rows, 0)
    k = F.substring("sample_id", 2, 20).cast("int")
    prediction = F.when(k % 5 != 0, F.when(k % 3 == 0, F.lit("\\boxed{x}")).otherwise(F.concat(F.lit("Then "), "gold_solution")))
    made = docs.withColumns({
        "prediction": prediction, "block_history": F.array(F.lit(8), F.lit(8)), "nfe_history": F.array(F.lit(3), k % 4), "carry_mask": F.when(k % 7 != 0, F.array((k % 2 == 0).cast("int"))),
        "predicted_deltas": F.when(k % 4 == 0, F.create_map(F.lit(0), F.lit(1))),
    })
    s = E.evaluation_summary(E.evaluated(made, "math"))
    return s.select("task_name", "n", F.round("accuracy", 6).alias("accuracy"), "prior_correction_applied_doc_count", "boundary_gate_applied_doc_count", "carry_on_boundary_count", "nfe", F.round("carry_rate", 6).alias("carry_rate"))


def part_code(spark, sf: str) -> DataFrame:
    """A short function for every part, with a task of the part's name."""
    none = lambda kind: F.lit(None).cast(kind)
    return table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("task_id"), none("string").alias("language"), F.format_string("def f(a):\n    b = a + %d\n    return b\n", "p_size").alias("code"), none("string").alias("code_text"),
        none("array<string>").alias("segments"), F.col("p_name").alias("docstring"), none("string").alias("signature"), none("string").alias("func_name"),
    )


def q78_labelled_code(spark, sf: str) -> DataFrame:
    """Labelled rows of every part's function, by signature and doc.

    A line's first word is one token with the line end before it, so the body's seven words after "b" are
    six tokens and "b" counts as condition. Of those "=" is claimed by the header's blanks and by the
    statement and has no phase, as "return", which begins before its statement; two statements end.
    """
    rows = T.documented_rows(part_code(spark, sf))
    ones = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x)
    return rows.select(
        "task_id", "serialized_text", "hard_mining_cluster", "synthetic_signature", F.size("boundary_labels").alias("n_tokens"), "condition_token_count",
        ones("boundary_labels").alias("n_boundaries"), ones("phase_loss_mask").alias("n_phased"), ones("boundary_loss_mask").alias("n_counted"),
    )


QUERIES = {f.__name__: f for f in (q75_gate_rows, q76_correction_rows, q77_oracle_documents, q78_labelled_code, q90_math_documents, q91_evaluation_summary)}
_LINES = """
WITH l AS (SELECT CAST(l_orderkey AS VARCHAR) AS sample_id, CAST(l_quantity AS INT) AS q, CAST(l_extendedprice AS DOUBLE) AS p,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_discount, l_extendedprice) - 1 AS INT) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)"""
ORACLE_SQL = {
    "q75_gate_rows": _LINES + """
SELECT sample_id, i AS transition_index, CASE WHEN i % 2 = 1 AND p > 30000 THEN 1 ELSE 0 END AS gate_target, CASE WHEN i % 2 = 1 THEN p ELSE 0 END AS carry_on, CAST(q AS DOUBLE) AS feature, CAST(n AS INT) AS n_blocks
FROM l WHERE n > 1""",
    "q76_correction_rows": _LINES + """,
b AS (SELECT *, CASE WHEN i % 2 = 0 THEN 0 WHEN 30000 >= p AND 30000 >= q * 1000.0 THEN 0 WHEN p >= q * 1000.0 THEN -1 ELSE 2 END AS d FROM l)
SELECT sample_id, i AS boundary_index, d AS best_delta, CAST(d <> 0 AS INT) AS gate_target, d + 2 AS delta_target, 'gsm8k' AS source_dataset FROM b""",
    "q77_oracle_documents": r"""
WITH p AS (SELECT p_partkey AS k, p_size AS n, p_partkey % 4 + 1 AS m, ['boxes', 'crates on the ship', 'pallets', 'lids'] AS w FROM part)
SELECT 'part/train/' || k AS sample_id, 'Q: How many parts of size ' || n || '?' || chr(10) || 'A: Let''s think step by step.' AS prompt_text,
  array_to_string(list_transform(range(0, m), lambda i: 'number of ' || w[i + 1] || ': ' || n || ' + ' || i || ' = ' || (n + i)), '|') || '|total: ' || (n + 1) || '.' AS steps,
  CAST(m + 1 AS INT) AS n_blocks, CAST(list_sum(list_transform(range(0, m + 1), lambda i: least(i, 2) + 1 + least(m - i, 2))) AS INT) AS n_candidates FROM p""",
    "q78_labelled_code": r"""
WITH t AS (SELECT CAST(p_partkey AS VARCHAR) AS task_id, 'def f(a):' || chr(10) || '    \"\"\"' || p_name || '\"\"\"' || chr(10) AS lead, '    b = a + ' || p_size || chr(10) || '    return b' AS body FROM part)
SELECT task_id, lead || body AS serialized_text, 'general' AS hard_mining_cluster, 'def f(a):' AS synthetic_signature,
  len(regexp_extract_all(lead || body, '[^ \t\n\r]+')) AS n_tokens, len(regexp_extract_all(lead, '[^ \t\n\r]+')) + 1 AS condition_token_count,
  2 AS n_boundaries, 4 AS n_phased, 7 AS n_counted FROM t""".replace(r"\"", '"'),
    "q90_math_documents": f"""
WITH r AS (SELECT p_partkey AS k, 'How large is the ' || p_name || ', in ' || (p_partkey % 50) || '?' AS q, 'It is = ' || p_size || '.' || chr(10) || 'So \\boxed{{' || p_size || '}}' AS a,
    p_type AS s, p_brand AS l, CASE WHEN p_partkey % 16 = 0 THEN 'u' || p_partkey END AS u FROM part),
n AS (SELECT *, trim(regexp_replace(lower(q), '[^a-z0-9]+', ' ', 'g')) AS w FROM r),
t AS (SELECT * FROM n WHERE k % 2 = 0 AND w NOT IN (SELECT w FROM n WHERE k % 2 = 1)),
e1 AS (SELECT q, a, k, 0 AS later FROM t QUALIFY row_number() OVER (PARTITION BY lower(s) ORDER BY k) = 1),
e2 AS (SELECT q, a, min(k) AS k, 1 AS later FROM t WHERE (q, a) NOT IN (SELECT (q, a) FROM e1) GROUP BY q, a),
e AS (SELECT * FROM (SELECT * FROM e1 UNION ALL SELECT * FROM e2) ORDER BY later, k LIMIT {EXAMPLES}),
x AS (SELECT string_agg('Problem: ' || q || chr(10) || 'Answer: ' || a, chr(10) || chr(10) ORDER BY later, k) AS x FROM e),
o AS (SELECT *, row_number() OVER (PARTITION BY s, l ORDER BY k) AS turn, min(k) OVER (PARTITION BY s, l) AS seen FROM r WHERE k % 2 = 1),
p AS (SELECT *, row_number() OVER (ORDER BY turn, seen, k) - 1 AS i FROM o QUALIFY i < {TASKS})
SELECT coalesce(u, 'math/test/' || i) AS sample_id, s AS subject, l AS level, md5(x || chr(10) || chr(10) || 'Problem: ' || q || chr(10) || 'Answer:') AS prompt, 2 AS n_blocks FROM p, x""",
    "q91_evaluation_summary": """
SELECT 'math' AS task_name, count(*) AS n, round(avg(CASE WHEN k % 5 <> 0 AND k % 3 <> 0 THEN 1.0 ELSE 0 END), 6) AS accuracy, count(*) FILTER (k % 4 = 0) AS prior_correction_applied_doc_count,
  count(*) FILTER (k % 7 <> 0) AS boundary_gate_applied_doc_count, count(*) FILTER (k % 7 <> 0 AND k % 2 = 0) AS carry_on_boundary_count, CAST(sum(3 + k % 4) AS BIGINT) AS nfe,
  round(count(*) FILTER (k % 7 <> 0 AND k % 2 = 0) / CAST(count(*) AS DOUBLE), 6) AS carry_rate FROM (SELECT p_partkey AS k FROM part)""",
}
