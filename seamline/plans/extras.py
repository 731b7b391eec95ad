"""Queries of summaries, classifiers, carried state and array operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seamline.functions import answers as M
from seamline.functions import arrays as A
from seamline.functions import records as R
from seamline.functions import text as X
from seamline.operators import boundaries as B
from seamline.operators import corpora, ordering, summaries
from seamline.operators import predicates as P
from seamline.operators.scans import scan
from seamline.session import table, texts
from seamline.streaming import state

def _orders(spark, sf: str) -> DataFrame:
    """Quantities and return marks of each order's lines, in a fixed order."""
    li = table(spark, sf, "lineitem").select("l_orderkey", F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q"), "l_partkey", (F.col("l_returnflag") == "R").cast("int").alias("m")).alias("r"))
    rows = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("r")).alias("r"))
    return rows.select("l_orderkey", F.transform("r", lambda x: x["q"]).alias("q"), F.transform("r", lambda x: x["m"]).alias("m"))


LINES = "l AS (SELECT l_orderkey, CAST(l_quantity AS INT) AS q, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS m, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_quantity AS INT), l_partkey) - 1 AS i FROM lineitem)"


def q55_task_categories(spark, sf: str) -> DataFrame:
    d = texts(spark, sf).select(F.explode(P.task_categories(F.col("text"))).alias("category"))
    return d.groupBy("category").agg(F.count("*").alias("n"))


def q56_failure_types(spark, sf: str) -> DataFrame:
    """What went wrong, of errors and completions that name the part: by its key one of six kinds."""
    k, name = F.col("p_partkey"), F.col("p_name")
    errors = [F.concat(F.lit("AssertionError: "), name), F.concat(name, F.lit(" IndexError")), F.concat(F.lit("TypeError in "), name), F.lit(""), F.lit(""), F.lit(None).cast("string")]
    completions = [F.lit(""), F.lit(""), F.concat(F.lit("fix = "), k.cast("string")), F.concat(F.lit("To solve this problem, "), name), F.lit("x"), F.lit(None).cast("string")]
    kind = (k % 6).cast("int")
    return table(spark, sf, "part").select(k.alias("id"), P.failure_type(F.get(F.array(*errors), kind), F.get(F.array(*completions), kind)).alias("failure"))


def q57_pass_changes(spark, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select((F.col("n_chars") > 1000).alias("old"), F.contains("text", F.lit("the")).alias("new"))
    return summaries.pass_changes(d, "old", "new")


def q58_document_summary(spark, sf: str) -> DataFrame:
    s = summaries.document_summary(_orders(spark, sf), "q", F.array_contains("m", 1))
    return s.select("n_documents", *[F.round(c, 6).alias(c) for c in ("avg_block_length", "avg_block_count", "coverage_rate", "anchor_rate")])


def q59_masked_histogram(spark, sf: str) -> DataFrame:
    return summaries.masked_histogram(_orders(spark, sf), "q", "m")


def q60_fixed_blocks(spark, sf: str) -> DataFrame:
    """Fixed blocks of 16 up to 100 tokens, one an order line."""
    f = corpora.fixed_blocks(_orders(spark, sf), "l_orderkey", 16, 100, "q")
    return f.select("l_orderkey", F.col("step_index").cast("long").alias("step_index"), F.col("generated_length").cast("long").alias("generated_length"), F.col("selected_block_length").cast("long").alias("block_length"))


def q61_labelled_summary(spark, sf: str) -> DataFrame:
    s = summaries.labelled_summary(_orders(spark, sf), "m")
    return s.select("n_rows", F.round("avg_length", 6).alias("avg_length"), F.col("min_length").cast("long").alias("min_length"), F.col("max_length").cast("long").alias("max_length"), F.round("positive_rate", 6).alias("positive_rate"))


def q62_transitions(spark, sf: str) -> DataFrame:
    """Changes of the return mark between adjacent lines, the last line having none."""
    t = A.transitions(F.col("m"), F.transform("m", lambda _: F.lit(1)))
    return _orders(spark, sf).select("l_orderkey", A.total(F.transform(t, lambda x: x["target"] * x["mask"])).alias("n_changes"), A.total(F.transform(t, lambda x: x["mask"])).alias("n_pairs"))


def q63_degraded_lengths(spark, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id", (F.floor(F.abs("value")) % 32 + 1).alias("block_length"))
    t = B.trace_offsets(e, "user_id", ["event_id"], "block_length")
    made = {m: R.degraded_length(F.col("block_length"), m, 4, F.col("step_index"), F.lit(24), F.lit(16), F.lit(0.0)).cast("long").alias(m) for m in ("early", "late", "jitter", "oversegment")}
    return t.select("event_id", *made.values())


def q64_revisit_plans(spark, sf: str) -> DataFrame:
    """How far back each block of a user's trace reopens, gated by the mark of the event before."""
    e = table(spark, sf, "events").select("event_id", "user_id", (F.floor(F.abs("value")) % 32 + 1).alias("block_length"), F.when(F.col("event_type") == "purchase", 0.25).otherwise(0.75).alias("gate"))
    t = B.trace_offsets(e, "user_id", ["event_id"], "block_length")
    t = scan(t, "user_id", ["event_id"], before={"before": F.col("gate")}).fillna(0.0, ["before"])
    plan = state.revisit_plan(F.lit(10), (F.col("generated_length") + 10).cast("int"), (F.col("offset") + 10).cast("int"), F.lit(8), F.col("before"))
    return t.select("event_id", plan.alias("p")).select("event_id", F.col("p.revisit_start").cast("long").alias("revisit_start"), F.col("p.overlap_tokens").cast("long").alias("overlap_tokens"), "p.carry_gate")


Q64_SQL = """
WITH e AS (SELECT event_id, user_id, CAST(floor(abs(value)) AS BIGINT) % 32 + 1 AS b, CASE WHEN event_type = 'purchase' THEN 0.25 ELSE 0.75 END AS g FROM events),
t AS (SELECT event_id, 10 + sum(b) OVER w - b AS s, CAST(coalesce(lag(g) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS DOUBLE) AS g FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
p AS (SELECT *, CASE WHEN s <= 10 THEN 0 ELSE least(s - 10, greatest(1, round_even(8 * (1 - g), 0))) END AS o FROM t)
SELECT event_id, CAST(s - o AS BIGINT) AS revisit_start, CAST(o AS BIGINT) AS overlap_tokens, CASE WHEN s <= 10 THEN 0.0 ELSE 1 - g END AS carry_gate FROM p
"""


def q65_carried_scores(spark, sf: str) -> DataFrame:
    """Scores of vectors raised by their likeness to the vector before with the same label."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    e = e.select("vec_id", "label", F.array(F.lit(0.5)).alias("s"), F.array("v").alias("vs"), "v", F.lit(0.5).alias("g"))
    c = state.carry_scores(e, "label", "vec_id", "s", "vs", "v", "g", 0.3)
    return c.select("vec_id", F.round(F.get("carried_scores", 0), 6).alias("score"))


def q66_latex_answers(spark, sf: str) -> DataFrame:
    """Answers written in ten ways, with digits by key and numbers by size, in one form."""
    k, n = F.col("p_partkey"), F.col("p_size")
    a, b = k % 9 + 1, n % 9 + 1
    ways = [
        F.format_string("\\frac%d%d", a, b), F.format_string("\\tfrac%d{%d}", a, n + 9), F.format_string("%d/%d", a, n), F.format_string("0%d/%d", a, n), F.format_string("\\sqrt%d", a),
        F.format_string("x = %d", n), F.format_string("%d\\text{ cm}", n), F.format_string("%d\\%%", n), F.format_string("\\left( %d \\right)", n), F.format_string("\\dfrac{%d}{%d}", n, a),
    ]
    return table(spark, sf, "part").select(k.alias("id"), M.canonical_latex(F.get(F.array(*ways), (k % 10).cast("int"))).alias("answer"))


Q66_SQL = r"""
WITH p AS (SELECT p_partkey AS k, p_size AS n, p_partkey % 9 + 1 AS a, p_size % 9 + 1 AS b FROM part)
SELECT k AS id, CASE k % 10 WHEN 0 THEN '\frac{' || a || '}{' || b || '}' WHEN 1 THEN '\frac{' || a || '}{' || (n + 9) || '}' WHEN 2 THEN '\frac{' || a || '}{' || n || '}'
  WHEN 3 THEN '0' || a || '/' || n WHEN 4 THEN '\sqrt{' || a || '}' WHEN 8 THEN '(' || n || ')' WHEN 9 THEN '\frac{' || n || '}{' || a || '}' ELSE CAST(n AS VARCHAR) END AS answer FROM p
""".replace("\\\\", "\\")


def q67_even_parts(spark, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", F.floor("o_totalprice").alias("t"))
    p = A.even_parts(F.col("t"), F.lit(7))
    return o.select("o_orderkey", F.get(p, 0).alias("first"), F.get(p, 6).alias("last"), A.total(p).alias("total"))


def q68_entropy(spark, sf: str) -> DataFrame:
    """Entropy of each order's quantities as shares."""
    o = _orders(spark, sf).withColumn("t", A.total(F.col("q")))
    return o.select("l_orderkey", F.round(A.entropy(F.transform("q", lambda x: x / F.col("t"))), 6).alias("entropy"))


def q69_position_labels(spark, sf: str) -> DataFrame:
    """0/1 labels of the first 10 positions from the line quantities as positions."""
    o = _orders(spark, sf).select("l_orderkey", A.positions_to_labels(F.lit(10), F.col("q")).alias("l"))
    return o.select("l_orderkey", F.array_join(F.col("l").cast("array<string>"), "").alias("labels"))


def q70_zip_in_order(spark, sf: str) -> DataFrame:
    """Customers and customers in order of balance, paired by position."""
    c = table(spark, sf, "customer")
    z = ordering.zip_in_order(c.select("c_custkey"), c.select(F.col("c_custkey").alias("other"), "c_acctbal"), ["c_custkey"], ["c_acctbal", "other"])
    return z.select("ordinal", "c_custkey", "other")


def q71_chat_text(spark, sf: str) -> DataFrame:
    """Each conversation's last user text, from an array of messages, without markup."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.lit(None).cast("string").alias("from"), F.col("text").alias("content"), F.lit(None).cast("string").alias("value")))).alias("m"))
    return c.select("conv_id", F.md5(R.last_text(F.col("m"), ["user", "human"])).alias("text_md5"), F.size("m").cast("long").alias("n"))


def q72_overlap_text(spark, sf: str) -> DataFrame:
    return texts(spark, sf).select("doc_id", F.md5(X.overlap_text(F.col("text"))).alias("text_md5"))


QUERIES = {f.__name__: f for f in (
    q55_task_categories, q56_failure_types, q57_pass_changes, q58_document_summary, q59_masked_histogram, q60_fixed_blocks, q61_labelled_summary, q62_transitions,
    q63_degraded_lengths, q64_revisit_plans, q65_carried_scores, q66_latex_answers, q67_even_parts, q68_entropy, q69_position_labels, q70_zip_in_order, q71_chat_text, q72_overlap_text,
)}
ORACLE_SQL = {
    "q55_task_categories": " UNION ALL ".join(f"SELECT '{n}' AS category, count(*) AS n FROM documents WHERE regexp_matches(text, '(?i){p}') HAVING count(*) > 0" for n, p in P.CATEGORIES.items()),
    "q56_failure_types": "SELECT p_partkey AS id, ['AssertionError', 'RuntimeError', 'TypeError', 'PromptLeakage', 'UnknownError', 'UnknownError'][p_partkey % 6 + 1] AS failure FROM part",
    "q57_pass_changes": "WITH d AS (SELECT n_chars > 1000 AS o, contains(text, 'the') AS w FROM documents) SELECT count(*) AS n, count(*) FILTER (WHERE o) AS old_pass, count(*) FILTER (WHERE w) AS new_pass, count(*) FILTER (WHERE w AND NOT o) AS rescued, count(*) FILTER (WHERE o AND NOT w) AS regressed FROM d",
    "q58_document_summary": f"WITH {LINES}, d AS (SELECT l_orderkey, sum(q) AS s, count(*) AS n, max(m) AS a FROM l GROUP BY 1) SELECT count(*) AS n_documents, round(sum(s) / sum(n), 6) AS avg_block_length, round(avg(n), 6) AS avg_block_count, round(avg(CASE WHEN n > 1 THEN 1 ELSE 0 END), 6) AS coverage_rate, round(avg(a), 6) AS anchor_rate FROM d",
    "q59_masked_histogram": f"WITH {LINES} SELECT q AS value, count(*) AS n FROM l WHERE m = 1 GROUP BY q",
    "q60_fixed_blocks": f"WITH {LINES} SELECT l_orderkey, i AS step_index, i * 16 AS generated_length, least(16, 100 - i * 16) AS block_length FROM l WHERE i * 16 < 100",
    "q61_labelled_summary": f"WITH {LINES}, d AS (SELECT l_orderkey, count(*) AS n, sum(m) AS m FROM l GROUP BY 1) SELECT count(*) AS n_rows, round(avg(n), 6) AS avg_length, min(n) AS min_length, max(n) AS max_length, round(sum(m) / sum(n), 6) AS positive_rate FROM d",
    "q62_transitions": f"WITH {LINES}, d AS (SELECT l_orderkey, m, lead(m) OVER (PARTITION BY l_orderkey ORDER BY i) AS n FROM l) SELECT l_orderkey, count(*) FILTER (WHERE n <> m) AS n_changes, count(n) AS n_pairs FROM d GROUP BY 1",
    "q63_degraded_lengths": "WITH e AS (SELECT event_id, least(CAST(floor(abs(value)) AS BIGINT) % 32 + 1, 24) AS b, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS s FROM events) SELECT event_id, greatest(1, b - 4) AS early, least(b + 4, 24) AS late, greatest(1, least(24, b + CASE WHEN s % 2 = 0 THEN 4 ELSE -4 END)) AS jitter, greatest(1, b // 4) AS oversegment FROM e",
    "q64_revisit_plans": Q64_SQL,
    "q65_carried_scores": "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, lag(CAST(embedding AS DOUBLE[])) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings) SELECT vec_id, round(0.5 + coalesce(list_cosine_similarity(v, p), 0) * 0.15, 6) AS score FROM e",
    "q66_latex_answers": Q66_SQL,
    "q67_even_parts": "WITH o AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS t FROM orders) SELECT o_orderkey, t // 7 + CASE WHEN t % 7 > 0 THEN 1 ELSE 0 END AS first, t // 7 AS last, t AS total FROM o",
    "q68_entropy": f"WITH {LINES}, s AS (SELECT l_orderkey, greatest(q / sum(q) OVER (PARTITION BY l_orderkey), 1e-8) AS p FROM l) SELECT l_orderkey, round(-sum(p * ln(p)), 6) AS entropy FROM s GROUP BY 1",
    "q69_position_labels": f"WITH {LINES}, d AS (SELECT l_orderkey, list(q) AS q FROM l GROUP BY 1) SELECT l_orderkey, array_to_string(list_transform(range(10), lambda i: CASE WHEN list_contains(q, CAST(i AS INT)) THEN '1' ELSE '0' END), '') AS labels FROM d",
    "q70_zip_in_order": "WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS ordinal FROM customer), b AS (SELECT c_custkey AS other, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS ordinal FROM customer) SELECT ordinal, c_custkey, other FROM a JOIN b USING (ordinal)",
    "q71_chat_text": "SELECT conv_id, md5(coalesce(arg_max(trim(text), turn) FILTER (WHERE lower(trim(role)) IN ('user', 'human') AND trim(text) <> ''), '')) AS text_md5, count(*) AS n FROM conversations GROUP BY conv_id",
    "q72_overlap_text": r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g'))) AS text_md5 FROM documents",
}
