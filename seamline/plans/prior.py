"""Block lengths by prior rules, over every document's window of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.functions import prior as P
from seamline.session import table, texts

GEN_LENGTH, DEFAULT = 256, 32
TOKEN = r"[ \t\n\r]*[^ \t\n\r]+"


def q73_prior_lengths(spark, sf: str) -> DataFrame:
    """Length of every document's first block by each rule; tokens are words with the blanks before them."""
    d = texts(spark, sf).select("doc_id", P.first_tokens(F.col("text"), int(GEN_LENGTH * P.WINDOW_RATIO)).alias("t"))
    length = lambda task: P.prior_length(F.col("t"), GEN_LENGTH, F.lit(0), F.lit(DEFAULT), task)
    return d.select("doc_id", length("nl").alias("sentence"), length("math").alias("step"), length("code").alias("code"))


def q74_planned_lengths(spark, sf: str) -> DataFrame:
    """Planned lengths of blocks, sizes being an order's quantities and the block a line of it."""
    l = table(spark, sf, "lineitem")
    sizes = l.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.floor("l_quantity").cast("int").alias("q")))), lambda x: x["q"]).alias("sizes"))
    d = sizes.select("l_orderkey", "sizes", F.posexplode(F.sequence(F.lit(0), F.lit(4))).alias("block", "i"))
    return d.select("l_orderkey", "block", P.planned_length(F.col("sizes"), F.col("block"), 16, 100, F.col("block") * 24).cast("long").alias("length"))


QUERIES = {f.__name__: f for f in (q73_prior_lengths, q74_planned_lengths)}
_END = r"($|[^\pL\pN_])"
_MATH = rf"(?i)(^|[^\pL\pN_])({P.CONNECTIVES}){_END}"
_FIRST = lambda p: f"nullif(list_position(list_transform(b, lambda x: regexp_matches(x, '{p}')), true), 0)"
_BLANK = r"[ \t\r\f\v]"
ORACLE_SQL = {
    "q73_prior_lengths": rf"""
WITH t AS (SELECT doc_id, list_slice(regexp_extract_all(text, '{TOKEN}'), 1, 64) AS w FROM documents),
p AS (SELECT doc_id, list_transform(range(1, len(w) + 1), lambda i: array_to_string(list_slice(w, 1, i), '')) AS b FROM t),
f AS (SELECT doc_id, b, {_FIRST(P.SENTENCE)} AS s, {_FIRST(P.CLAUSE)} AS c, {_FIRST(P.MARKER)} AS m, {_FIRST(_MATH)} AS k, {_FIRST(chr(92) + 'n')} AS n,
  {_FIRST(rf"{chr(92)}n{_BLANK}*({P.CODE_WORDS}){_END}|(^|{chr(92)}n){_BLANK}[^{chr(92)}n]*{chr(92)}n[^ \t\r\f\v\n]")} AS d FROM p)
SELECT doc_id, CAST(coalesce(s, c, {DEFAULT}) AS BIGINT) AS sentence,
  CAST(coalesce(least(m, CASE WHEN NOT regexp_matches(b[k], '(?i)^({P.CONNECTIVES}){_END}') THEN k END, n), {DEFAULT}) AS BIGINT) AS step,
  CAST(coalesce(d, {DEFAULT}) AS BIGINT) AS code FROM f""",
    "q74_planned_lengths": """
WITH s AS (SELECT l_orderkey, list(CAST(floor(l_quantity) AS INT) ORDER BY l_linenumber, floor(l_quantity)) AS q FROM lineitem GROUP BY 1), i AS (SELECT unnest(range(0, 5)) AS block)
SELECT l_orderkey, CAST(block AS INT) AS block, CAST(least(coalesce(q[block + 1], 16), 100 - block * 24) AS BIGINT) AS length FROM s, i""",
}
