"""Streaming and kernel queries: keyed state, phases of code, segmentation, answers, enrichment."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.functions import answers as M
from seamline.functions import arrays as A
from seamline.functions import text as X
from seamline.functions import maths
from seamline.functions.kernels import code, phases
from seamline.operators import sampling
from seamline.plans.boundaries import TRACE
from seamline.session import shared_folder, table, texts
from seamline.sources.sinks import enriched
from seamline.streaming import state, versions

def q45_kv_state_stream(spark, sf: str) -> DataFrame:
    """Running offsets of ``events`` as a stream with keyed state, run to its end."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    events = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parque[t]")
    events = events.select("event_id", "user_id", (F.floor(F.abs("value")) % 32 + 1).alias("block_length"))
    versions.run_to_end(events, versions.offsets_sink(folder, "user_id", "event_id", "block_length", state.OFFSETS), f"{folder}/checkpoint")
    return versions.results_of(spark, f"{folder}/results", state.OFFSETS)


def part_functions(spark, sf: str) -> DataFrame:
    """A Python function for every part: whether it has a doc, a conversion, a loop and a check goes by the part's key."""
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    some = lambda when, text: F.when(when, text).otherwise("")
    code = F.concat(
        F.format_string("def f%d(xs):\n", k), some(k % 2 == 0, F.concat(F.lit('    """'), "p_name", F.lit('"""\n'))), some(k % 3 == 0, F.lit("    values = list(xs)\n")),
        F.lit("    out = "), n, F.lit("\n"), some(k % 5 < 3, F.lit("    for v in xs:\n        out += v\n")),
        some(k % 7 < 4, F.concat(F.lit("    if out > "), n, F.lit(":\n        out = "), n, F.lit("\n"))), F.lit("    return out\n"),
    )
    return table(spark, sf, "part").select(k.alias("id"), code.alias("code"))


def q46_python_phase_spans(spark, sf: str) -> DataFrame:
    """Phases of every part's function, with their places."""
    spans = part_functions(spark, sf).select("id", phases.phase_labels(F.col("code")).alias("l")).select("id", F.posexplode("l.spans").alias("k", "s"))
    return spans.select("id", "k", "s.*")


#: Each statement by its phases: (when it is there, phase, quality, characters before, of, and after the span).
Q46_SQL = """
WITH p AS (SELECT p_partkey AS k, CAST(p_size AS VARCHAR) AS n, p_name AS d, length('def f' || p_partkey || '(xs):') + 1 AS h FROM part),
r AS (SELECT k, unnest([
  {'o': 0, 'there': true, 'phase': 'signature_or_doc', 'confidence': 'gold', 'lead': 0, 'len': CASE WHEN k % 2 = 0 THEN h + 10 + length(d) ELSE h + 4 END, 'tail': CASE WHEN k % 2 = 0 THEN 1 ELSE -4 END},
  {'o': 1, 'there': k % 3 = 0, 'phase': 'normalize', 'confidence': 'silver', 'lead': 4, 'len': 17, 'tail': 1},
  {'o': 2, 'there': true, 'phase': 'init_state', 'confidence': 'silver', 'lead': 4, 'len': 6 + length(n), 'tail': 1},
  {'o': 3, 'there': k % 5 < 3, 'phase': 'enumerate_or_iterate', 'confidence': 'gold', 'lead': 4, 'len': 21, 'tail': 0},
  {'o': 4, 'there': k % 5 < 3, 'phase': 'update_state', 'confidence': 'gold', 'lead': 0, 'len': 8, 'tail': 1},
  {'o': 5, 'there': k % 7 < 4, 'phase': 'check_or_verify', 'confidence': 'silver', 'lead': 4, 'len': 19 + length(n), 'tail': 0},
  {'o': 6, 'there': k % 7 < 4, 'phase': 'init_state', 'confidence': 'silver', 'lead': 0, 'len': 6 + length(n), 'tail': 1},
  {'o': 7, 'there': true, 'phase': 'return_emit', 'confidence': 'gold', 'lead': 4, 'len': 10, 'tail': 1}]) AS s FROM p),
c AS (SELECT k, s, row_number() OVER w - 1 AS i, coalesce(sum(s.lead + s.len + s.tail) OVER (PARTITION BY k ORDER BY s.o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + s.lead AS b
  FROM r WHERE s.there WINDOW w AS (PARTITION BY k ORDER BY s.o))
SELECT k AS id, CAST(i AS INT) AS k, s.phase AS phase, CAST(b AS INT) AS "start", CAST(b + s.len AS INT) AS "end", s.confidence AS confidence FROM c
"""


def part_snippets(spark, sf: str) -> DataFrame:
    """Code in three languages for the parts, some of it broken; names by key, numbers by size."""
    k, n = F.col("p_partkey"), F.col("p_size")
    texts_ = [
        F.format_string("def f%d(xs):\n    out = %d\n    return out\n", k, n), F.format_string("import os\n\ndef main%d():\n    print(os.name)\n\nmain%d()\n", k, k),
        F.format_string("def broken%d(:\n    return %d\n", k, n),
        F.format_string("function add%d(a, b) {\n  const total = a + b;\n  if (total > %d) {\n    return %d;\n  }\n  return total;\n}\n", k, n, n),
        F.format_string("def add%d(a, b)\n  # sum\n  total = a + b\n  if total > %d\n    total = %d\n  end\n  total\nend\n", k, n, n),
    ]
    languages = F.array(*map(F.lit, ("python", "python", "python", "javascript", "ruby")))
    kind = (k % 5).cast("int")
    return table(spark, sf, "part").select(k.alias("id"), F.get(languages, kind).alias("language"), F.get(F.array(*texts_), kind).alias("code"))


def q49_code_segments(spark, sf: str) -> DataFrame:
    """How every part's code is segmented, and into what; scripts that do not begin with a function are not."""
    cut = part_snippets(spark, sf).select("id", "language", code.segmented_code(F.col("language"), F.col("code")).alias("s"))
    return cut.select("id", "language", "s.method", "s.quality", F.array_join("s.segments", "|").alias("segments"))


Q49_SQL = """
WITH p AS (SELECT p_partkey AS k, CAST(p_size AS VARCHAR) AS n, chr(10) AS e, p_partkey % 5 AS kind FROM part)
SELECT k AS id, ['python', 'python', 'python', 'javascript', 'ruby'][kind + 1] AS language, CASE kind WHEN 0 THEN 'ast' WHEN 4 THEN 'ruby_indent' WHEN 1 THEN NULL ELSE 'heuristic' END AS method,
  CASE kind WHEN 0 THEN 'high' WHEN 1 THEN NULL ELSE 'fallback' END AS quality,
  CASE kind WHEN 0 THEN 'def f' || k || '(xs):|out = ' || n || e || 'return out'
    WHEN 2 THEN 'def broken' || k || '(:|return ' || n
    WHEN 3 THEN 'function add' || k || '(a, b) {|const total = a + b;' || e || 'if (total > ' || n || ') {' || e || '    return ' || n || ';' || e || '  }' || e || 'return total;' || e || '}'
    WHEN 4 THEN 'def add' || k || '(a, b)|# sum' || e || '  total = a + b' || e || 'if total > ' || n || e || '    total = ' || n || e || '  end' || e || 'total' || e || 'end' END AS segments FROM p
"""


def part_solutions(spark, sf: str) -> DataFrame:
    """Solutions that end in a box, a display, no number, a number or nothing, with numbers by size; half of the first are right."""
    k, n = F.col("p_partkey"), F.col("p_size")
    kinds = [
        (F.format_string("First, find x. We have $x = %d + 4$. Then $x = %d$, so 2x = %d.\n\nTherefore the answer is $\\boxed{%d}$.", n, n + 4, 2 * n + 8, 2 * n + 8), (2 * n + 8 + F.floor(k / 5) % 2).cast("string")),
        (F.format_string("Compute %d/4 + 1/4.\n$$\n= %d/4\n$$\nAnswer: \\boxed{\\frac{%d}{4}}", n, n + 1, n + 1), F.format_string("\\boxed{%d/4}", n + 1)),
        (F.concat(F.lit("No number in "), F.regexp_replace("p_name", "[^a-z ]", "")), F.lit("5")), (F.format_string("It is 1,%d.", n + 100), F.format_string("#### 1%d", n + 100)), (F.lit(None).cast("string"), F.lit("1")),
    ]
    kind = (k % 5).cast("int")
    return table(spark, sf, "part").select(k.alias("id"), F.get(F.array(*[s for s, _ in kinds]), kind).alias("solution"), F.get(F.array(*[g for _, g in kinds]), kind).alias("gold"))


def q50_math_answers(spark, sf: str) -> DataFrame:
    """Answers of every part's solution, whether they are right, and steps."""
    return part_solutions(spark, sf).select(
        "id", M.math_answer(F.col("solution")).alias("answer"), M.gsm8k_answer(F.col("solution")).alias("number"),
        M.math_correct(F.col("gold"), F.col("solution")).alias("correct"),
        F.coalesce(F.size(maths.math_segments(F.col("solution"))), F.lit(0)).cast("long").alias("n_steps"),
    )


Q50_SQL = r"""
WITH p AS (SELECT p_partkey AS k, p_size AS n, p_partkey % 5 AS kind, regexp_replace(p_name, '[^a-z ]', '', 'g') AS w FROM part)
SELECT k AS id, CASE kind WHEN 0 THEN CAST(2 * n + 8 AS VARCHAR) WHEN 1 THEN '\frac{' || (n + 1) || '}{4}' WHEN 2 THEN 'No number in ' || w WHEN 3 THEN 'It is 1,' || (n + 100) END AS answer,
  CASE kind WHEN 0 THEN '.' WHEN 1 THEN '4' WHEN 3 THEN '1' || (n + 100) END AS number,
  CASE kind WHEN 0 THEN (k // 5) % 2 = 0 WHEN 1 THEN true ELSE false END AS correct, CAST(CASE kind WHEN 0 THEN 4 WHEN 4 THEN 0 ELSE 1 END AS BIGINT) AS n_steps FROM p
""".replace("\\\\", "\\")


def q51_math_documents(spark, sf: str) -> DataFrame:
    """Segments of documents as mathematical prose: how many, and how many look like steps."""
    d = texts(spark, sf).select("doc_id", maths.math_segments(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("n_segments"), F.size(F.filter("s", lambda p: X.is_reasoning_step(p))).cast("long").alias("n_steps"))


def q52_enriched_documents(spark, sf: str) -> DataFrame:
    """Sentences of documents as segmented records, with boundary types; families by source number."""
    names = F.array(*[F.lit(n) for n in ("gum", "codesearchnet", "juice", "lean_workbook", "other")])
    source = F.element_at(names, (F.col("doc_id") % 5 + 1).cast("int"))
    d = texts(spark, sf).select(
        "doc_id", source.alias("source"), F.lit(None).cast("string").alias("source_dataset"), X.sentences(F.col("text")).alias("segments"),
        F.lit(None).cast("array<string>").alias("cell_types"), F.lit(False).alias("has_docstring"),
    )
    e = enriched(d)
    types = F.flatten("segment_boundary_types")
    return e.groupBy("source", "task_family").agg(
        F.count("*").alias("n_rows"), F.count_if("has_final_answer_anchor").alias("n_anchored"),
        F.sum(F.size(F.filter(types, lambda t: t == "safe_commit_boundary"))).alias("n_commits"), F.sum(F.size(types)).alias("n_types"),
    )


#: Segments as in q23; what each shows by patterns; then how many labels and which, by family.
Q52_SQL = r"""
WITH t AS (SELECT doc_id, trim(regexp_replace(text, '[ \t]+', ' ', 'g'), E' \n') AS t FROM documents),
p AS (SELECT doc_id, string_split_regex(t, '\n\s*\n+') AS l FROM t WHERE t <> ''),
q AS (SELECT doc_id, unnest(l) AS p, generate_subscripts(l, 1) AS i FROM p),
c AS (SELECT doc_id, i, string_split(regexp_replace(regexp_replace(p, '([.?!;:])\s+([A-Z0-9$\\(\["''])', E'\\1\x01\\2', 'g'), '([.?!;:])\s+([A-Z0-9$\\(\["''])', E'\\1\x01\\2', 'g'), chr(1)) AS l FROM q),
u AS (SELECT doc_id, i, unnest(l) AS s, generate_subscripts(l, 1) AS j FROM c),
s AS (SELECT doc_id, regexp_replace(s, '^\s+|\s+$', '', 'g') AS s, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS n, count(*) OVER (PARTITION BY doc_id) AS m FROM u WHERE regexp_matches(s, '\S')),
f AS (SELECT *, regexp_matches(s, '\boxed\s*\{') OR regexp_matches(s, '\A\s*####\s*[^\n]+\z') OR regexp_matches(s, '(?i)\A\s*(?:final\s+answer|answer)\s*[:=]') OR regexp_matches(s, '\A[-+]?\$?\d+(?:\.\d+)?(?:/\d+)?\$?\z') AS final,
  regexp_matches(s, '\A(?:def |async def |class |return |if |elif |else:|for |while |try:|except |with |import |from |public |private |protected |function |const |let |var |package |func |#include)')
    OR (regexp_matches(s, '[{}();]') AND NOT ends_with(s, '.')) OR (contains(s, chr(10)) AND regexp_matches(s, 'def |class |return |import |from |\{')) AS code,
  regexp_matches(s, '=|\\frac|\\sum|\\int|\\begin\{|\\end\{') OR s IN ('$$', '$', '\[', '\]') OR (regexp_matches(s, '\d') AND regexp_matches(s, '[=+\-*/^<>]')) AS shown FROM s),
d AS (SELECT doc_id, ['gum', 'codesearchnet', 'juice', 'lean_workbook', 'other'][doc_id % 5 + 1] AS source, ['discourse', 'code', 'notebook', 'formal_math', 'generic'][doc_id % 5 + 1] AS family FROM documents),
l AS (SELECT d.*, s IS NOT NULL AS there, CASE family WHEN 'code' THEN n > 1 OR code WHEN 'notebook' THEN NOT final AND code ELSE false END AS commit_,
  CASE family WHEN 'code' THEN false WHEN 'formal_math' THEN final OR (n = m AND shown) ELSE final END AS anchor FROM d LEFT JOIN f USING (doc_id))
SELECT source, family AS task_family, count(DISTINCT doc_id) AS n_rows, count(DISTINCT doc_id) FILTER (anchor) AS n_anchored, count(*) FILTER (commit_) AS n_commits,
  CAST(sum(CASE WHEN NOT there THEN 0 WHEN family IN ('discourse', 'generic') AND anchor THEN 2 ELSE 1 END) AS BIGINT) AS n_types FROM l GROUP BY 1, 2
"""


def q53_budgets(spark, sf: str) -> DataFrame:
    """Line lengths of each order cut off at a budget of 60, their positions, and steps of an even deal."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q"), "l_partkey"))).alias("r"))
    sizes = F.transform("r", lambda x: x["q"])
    o = li.select("l_orderkey", sizes.alias("s")).select("l_orderkey", "s", A.budget_lengths(F.col("s"), F.lit(60)).alias("b"))
    return o.select(
        "l_orderkey", F.size("b").cast("long").alias("n_blocks"), A.total(F.col("b")).alias("n_tokens"),
        A.generation_budget(F.col("s"), F.lit(60)).alias("budget"), F.element_at(A.running_sums(F.col("s")), -1).alias("total"),
    )


Q53_SQL = """
WITH t AS (SELECT l_orderkey, CAST(l_quantity AS INT) AS q, sum(CAST(l_quantity AS INT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_quantity AS INT), l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM lineitem),
b AS (SELECT *, least(q, greatest(60 - (c - q), 0)) AS b FROM t)
SELECT l_orderkey, count(*) FILTER (WHERE b > 0) AS n_blocks, CAST(sum(b) AS BIGINT) AS n_tokens, CAST(least(60, sum(q)) AS BIGINT) AS budget, CAST(sum(q) AS BIGINT) AS total FROM b GROUP BY l_orderkey
"""


def q54_record_digest_split(spark, sf: str) -> DataFrame:
    """Split of suppliers by the digest of the row."""
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return s.select("s_suppkey", sampling.record_digest(s).alias("digest"))


QUERIES = {f.__name__: f for f in (
    q45_kv_state_stream, q46_python_phase_spans, q49_code_segments, q50_math_answers, q51_math_documents, q52_enriched_documents, q53_budgets, q54_record_digest_split,
)}
ORACLE_SQL = {
    "q45_kv_state_stream": TRACE,
    "q46_python_phase_spans": Q46_SQL,
    "q49_code_segments": Q49_SQL,
    "q50_math_answers": Q50_SQL,
    "q52_enriched_documents": Q52_SQL,
    "q53_budgets": Q53_SQL,
    "q54_record_digest_split": """SELECT s_suppkey, md5('{"s_name":"' || s_name || '","s_nationkey":' || s_nationkey || ',"s_suppkey":' || s_suppkey || '}') AS digest FROM supplier""",
}
