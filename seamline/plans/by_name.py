"""Queries written in SQL over functions of the library's catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame

from seamline.functions import catalog
from seamline.plans.boundaries import Q23_SQL
from seamline.plans.metrics import Q39_SQL
from seamline.session import table


def in_sql(spark, sf: str, name: str, query: str) -> DataFrame:
    """A query over one table, called ``given`` in it."""
    catalog.register(spark)
    return spark.sql(query, given=table(spark, sf, name))


def q87_sql_sentences(spark, sf: str) -> DataFrame:
    return in_sql(spark, sf, "documents", "SELECT doc_id, CAST(size(sm_sentences(text)) AS BIGINT) AS n_segments FROM {given}")


def q88_sql_answers(spark, sf: str) -> DataFrame:
    return in_sql(spark, sf, "documents", "SELECT doc_id, answer FROM (SELECT doc_id, sm_gsm8k_answer(text) AS answer FROM {given}) WHERE answer IS NOT NULL")


def q89_sql_budgets(spark, sf: str) -> DataFrame:
    """Lengths of an order's lines cut off at 60 by functions of arrays, and how they spread."""
    return in_sql(spark, sf, "lineitem", """
        SELECT l_orderkey, size(b) AS n_blocks, round(sm_entropy(transform(q, x -> x / CAST(total AS DOUBLE))), 6) AS entropy,
            element_at(sm_running_sums(CAST(b AS ARRAY<BIGINT>)), -1) AS n_tokens
        FROM (SELECT *, sm_budget_lengths(q, 60) AS b, aggregate(q, 0, (s, x) -> s + x) AS total
            FROM (SELECT l_orderkey, transform(array_sort(collect_list(struct(l_linenumber, CAST(l_quantity AS INT) AS q))), x -> x.q) AS q FROM {given} GROUP BY l_orderkey))
    """)


QUERIES = {f.__name__: f for f in (q87_sql_sentences, q88_sql_answers, q89_sql_budgets)}
Q89_SQL = """
WITH l AS (SELECT l_orderkey, CAST(l_quantity AS INT) AS q, sum(CAST(l_quantity AS INT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_quantity AS INT) ROWS UNBOUNDED PRECEDING) AS upto,
  CAST(l_quantity AS INT) / CAST(sum(CAST(l_quantity AS INT)) OVER (PARTITION BY l_orderkey) AS DOUBLE) AS p FROM lineitem)
SELECT l_orderkey, CAST(count(*) FILTER (least(q, 60 - (upto - q)) > 0) AS INT) AS n_blocks, round(sum(-p * ln(p)), 6) AS entropy,
  CAST(sum(greatest(0, least(q, 60 - (upto - q)))) AS BIGINT) AS n_tokens FROM l GROUP BY l_orderkey"""
ORACLE_SQL = {"q87_sql_sentences": Q23_SQL, "q88_sql_answers": Q39_SQL, "q89_sql_budgets": Q89_SQL}
