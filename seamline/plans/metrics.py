"""Metric, ranking, answer and record queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.functions import answers as M
from seamline.functions import arrays as A
from seamline.functions import text as X
from seamline.operators import boundaries as B
from seamline.operators import metrics, rules
from seamline.operators.scans import scan
from seamline.session import table, texts

LANGS = ["de", "en", "es", "fr", "it"]
#: A few frequent words of each language, in the order in which ties are decided.
STOP_WORDS = {"en": ["the", "and", "of"], "de": ["der", "die", "und"], "fr": ["le", "la", "et"], "es": ["el", "los", "y"]}
BUCKETS = [(0, 50_000), (50_000, 100_000), (100_000, 200_000), (200_000, 400_000), (1_000_000, 2_000_000)]


def _labelled(spark, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return docs.join(table(spark, sf, "labels"), "doc_id").select("lang", (F.col("n_chars") > 1500).alias("guess"), (F.col("quality") == 1).alias("gold"))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def q25_binary_prf(spark, sf: str) -> DataFrame:
    counts = _labelled(spark, sf).agg(*metrics.confusion(F.col("guess"), F.col("gold")).values())
    return _rounded(metrics.with_prf(counts), "precision", "recall", "f1")


PRF = "SELECT {0}, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM (SELECT *, tp / greatest(tp + fp, 1) AS p, tp / greatest(tp + fn, 1) AS r FROM c)"
COUNTS = "count(*) FILTER (WHERE guess AND gold) AS tp, count(*) FILTER (WHERE guess AND NOT gold) AS fp, count(*) FILTER (WHERE NOT guess AND gold) AS fn"
LABELLED = "l AS (SELECT lang, n_chars > 1500 AS guess, quality = 1 AS gold FROM documents JOIN labels USING (doc_id))"


def _guessed_languages(spark, sf: str) -> DataFrame:
    words = F.split(F.lower("text"), "[^\\p{L}]+", -1)
    d = texts(spark, sf).select("doc_id", "lang", words.alias("w"))
    d = d.select("doc_id", "lang", *[_count_of("w", stop).alias(f"n_{k}") for k, stop in STOP_WORDS.items()])
    best = F.greatest(*[F.col(f"n_{k}") for k in STOP_WORDS])
    guess = F.when(best == 0, F.lit("none"))
    for k in STOP_WORDS:
        guess = guess.when(F.col(f"n_{k}") == best, k)
    return d.select("doc_id", "lang", guess.alias("guess"))


def _count_of(words: str, stop: list[str]):
    return F.size(F.filter(words, lambda w: w.isin(*stop)))


def q26_macro_f1(spark, sf: str) -> DataFrame:
    classes = metrics.per_class(_guessed_languages(spark, sf), "guess", "lang", LANGS)
    return _rounded(metrics.macro_f1(classes), "macro_f1")


def q26_class_f1(spark, sf: str) -> DataFrame:
    return _rounded(metrics.per_class(_guessed_languages(spark, sf), "guess", "lang", LANGS), "precision", "recall", "f1")


GUESS = "g AS (SELECT doc_id, lang, " + ", ".join(f"len(list_filter(string_split_regex(lower(text), '[^\\p{{L}}]+'), lambda w: w IN ({', '.join(repr(x) for x in v)}))) AS n_{k}" for k, v in STOP_WORDS.items()) + " FROM documents), h AS (SELECT lang, CASE WHEN greatest(n_en, n_de, n_fr, n_es) = 0 THEN 'none' " + " ".join(f"WHEN n_{k} = greatest(n_en, n_de, n_fr, n_es) THEN '{k}'" for k in STOP_WORDS) + " END AS guess FROM g)"
CLASSES = f"WITH {GUESS}, v(label) AS (VALUES {', '.join(f'({x!r})' for x in LANGS)}), c AS (SELECT label, count(*) FILTER (WHERE guess = label AND lang = label) AS tp, count(*) FILTER (WHERE guess = label AND lang <> label) AS fp, count(*) FILTER (WHERE guess <> label AND lang = label) AS fn FROM v, h GROUP BY label)"


def q27_grouped_metrics_total(spark, sf: str) -> DataFrame:
    counts = _labelled(spark, sf).rollup("lang").agg(*metrics.confusion(F.col("guess"), F.col("gold")).values(), F.grouping("lang").cast("long").alias("is_total"))
    return _rounded(metrics.with_prf(counts), "precision", "recall", "f1")


def q30_pass_at_k(spark, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return _rounded(metrics.pass_table(e, "user_id", F.col("event_type") == "purchase", (1, 5, 10)), "pass_at_k")


Q30_SQL = """
WITH t AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS c FROM events GROUP BY user_id),
k AS (SELECT * FROM t, (VALUES (1), (5), (10)) AS k(k)),
p AS (SELECT k, n, CASE WHEN n - c < k THEN 1.0 WHEN c = 0 THEN 0.0 ELSE 1 - list_reduce(list_transform(range(n - c + 1, n + 1), lambda i: CAST(1 - k / i AS DOUBLE)), lambda a, b: a * b) END AS p FROM k)
SELECT k, count(*) AS n_tasks, round(avg(p), 6) AS pass_at_k FROM p GROUP BY k HAVING min(n) >= k
"""


def q31_rank_records(spark, sf: str) -> DataFrame:
    """Suppliers by discount precision, revenue and name, missing metrics last, gated where they are present."""
    li = table(spark, sf, "lineitem")
    li = li.groupBy("l_suppkey").agg(F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("returned"), F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("revenue"))
    s = table(spark, sf, "supplier").join(li, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    s = s.withColumn("kept_rate", F.round(1 - F.col("returned") / F.col("n"), 6))
    gated = metrics.gate(s, F.col("kept_rate"), F.lit(None).cast("double"), 0.6)
    keys = [F.desc(metrics.or_missing(F.col("kept_rate"))), F.asc(metrics.or_unbounded(F.col("revenue"))), F.asc("s_suppkey")]
    return metrics.ranked(gated, keys).select("s_suppkey", "kept_rate", "revenue", F.col("rank").cast("long").alias("rank"))


Q31_SQL = """
WITH l AS (SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned, count(*) AS n, round(sum(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY 1),
s AS (SELECT s_suppkey, round(1 - returned / n, 6) AS kept_rate, revenue FROM supplier LEFT JOIN l ON s_suppkey = l_suppkey),
g AS (SELECT *, coalesce(kept_rate, -1) < 0 OR kept_rate >= 0.6 AS ok FROM s), h AS (SELECT *, bool_or(ok) OVER () AS any_ok FROM g)
SELECT s_suppkey, kept_rate, revenue, row_number() OVER (ORDER BY coalesce(kept_rate, -1) DESC, CASE WHEN revenue >= 0 THEN revenue ELSE 1e12 END, s_suppkey) AS rank FROM h WHERE ok OR NOT any_ok
"""


def q32_param_grid(spark, sf: str) -> DataFrame:
    """Every region with every combination of four parameter lists; the lists are literals, nothing is shuffled."""
    grids = {"threshold": [0.25, 0.5], "window_ratio": [0.1, 0.2], "entropy_gate": [0.6, 0.8], "weight": [0.0, 1.0]}
    out = table(spark, sf, "region").select("r_regionkey")
    for name, values in grids.items():
        out = out.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return out.withColumn("label", F.concat_ws("_", *[X.parameter_name(F.col(n)) for n in grids]))


def q33_win_loss(spark, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    a = d.select("doc_id", (F.col("n_chars") > 1000).alias("passed"), F.regexp_count("text", F.lit("[0-9]+")).alias("numbers"))
    b = d.where("lang = 'en'").select("doc_id", F.contains("text", F.lit("the")).alias("passed"))
    j = metrics.win_loss(a, b, "doc_id")
    return j.groupBy("outcome").agg(F.count("*").alias("n"), F.count_if(F.col("numbers") > 0).alias("with_numbers"))


Q33_SQL = """
WITH a AS (SELECT doc_id, n_chars > 1000 AS p, len(regexp_extract_all(text, '[0-9]+')) AS k FROM documents), b AS (SELECT doc_id, contains(text, 'the') AS q FROM documents WHERE lang = 'en'),
j AS (SELECT p, coalesce(q, false) AS q, k FROM a LEFT JOIN b USING (doc_id))
SELECT CASE WHEN q AND NOT p THEN 'win' WHEN p AND NOT q THEN 'loss' ELSE 'same' END AS outcome, count(*) AS n, count(*) FILTER (WHERE k > 0) AS with_numbers FROM j GROUP BY 1
"""


def q34_delta_vs_reference(spark, sf: str) -> DataFrame:
    """Order totals by customers' nation against those of the first nation."""
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    per = o.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("t")).join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("t").alias("t"))
    per = n.join(per, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    first = n.orderBy("n_nationkey").first()["n_name"]
    out = metrics.delta_to(per.select("n_name", F.round("t", 2).alias("revenue")), "n_name", first, "revenue")
    return out.withColumn("delta", F.round("delta", 2))


Q34_SQL = """
WITH r AS (SELECT n_nationkey, n_name, round(sum(o_totalprice), 2) AS revenue FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT n_name, revenue, round(revenue - (SELECT revenue FROM r ORDER BY n_nationkey LIMIT 1), 2) AS delta FROM r
"""


def q35_bucket_coverage(spark, sf: str) -> DataFrame:
    c = metrics.bucket_coverage(table(spark, sf, "orders"), F.col("o_totalprice"), BUCKETS)
    return c.select(F.col("bucket").cast("long").alias("bucket"), "low", "high", "n")


def q36_strip_html(spark, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select("page_id", X.strip_html(F.col("html")).alias("t"))
    return p.select("page_id", F.md5("t").alias("text_md5"), F.length("t").cast("long").alias("n_chars"), X.nonblank_lines(F.col("t")).cast("long").alias("n_lines"))


def _html_sql() -> str:
    text = "html"
    for entity, plain in X.ENTITIES:
        text = f"replace({text}, '{entity}', '{plain.replace(chr(39), chr(39) * 2)}')"
    for tag in X.LINE_TAGS:
        text = f"regexp_replace({text}, '{tag}', chr(10), 'g')"
    text = f"replace(regexp_replace({text}, '<[^>]+>', ' ', 'g'), chr(160), ' ')"
    text = f"regexp_replace(replace(replace({text}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \\t]+', ' ', 'g')"
    return f"""
WITH t AS (SELECT page_id, array_to_string(list_filter(list_transform(string_split({text}, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS t FROM pages)
SELECT page_id, md5(t) AS text_md5, length(t) AS n_chars, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, chr(10))) END AS n_lines FROM t
"""


def q37_last_message(spark, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").where((F.lower(F.trim("role")) == "assistant") & ~X.is_blank(F.col("text")))
    return c.groupBy("conv_id").agg(F.max_by("text", "turn").alias("last_text"), F.max("turn").alias("turn"))


def q38_first_nonempty(spark, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    value = X.first_nonblank(F.get_json_object("props", "$.missing"), F.get_json_object("props", "$.k"), F.col("event_type"), F.lit("none"))
    return e.select("event_id", value.alias("value"))


def q39_gsm8k_answer(spark, sf: str) -> DataFrame:
    d = texts(spark, sf).select("doc_id", M.gsm8k_answer(F.col("text")).alias("answer"))
    return d.where("answer is not null")


Q39_SQL = r"""
WITH m AS (SELECT doc_id, regexp_extract(text, '####\s*(-?[0-9.,]+)', 1) AS strict, regexp_extract_all(text, '-?[$0-9.,]{2,}|-?[0-9]+') AS all_ FROM documents),
c AS (SELECT doc_id, CASE WHEN strict <> '' THEN strict ELSE all_[-1] END AS c FROM m),
n AS (SELECT doc_id, regexp_replace(replace(ltrim(trim(c), '$'), ',', ''), '([0-9])[.!?,:;]+$', '\1') AS answer FROM c)
SELECT doc_id, answer FROM n WHERE answer <> ''
"""


def q40_numeric_margin(spark, sf: str) -> DataFrame:
    """Orders' totals guessed by the mean of their priority."""
    o = table(spark, sf, "orders")
    mean = o.groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 2).alias("guess"))
    j = o.join(mean, "o_orderpriority")
    return j.select("o_orderkey", F.round(M.margin_score(F.col("o_totalprice"), F.col("guess")), 6).alias("score"))


def q41_best_delta(spark, sf: str) -> DataFrame:
    """Per order, the line number offset (from the middle of 3) with the greatest rounded discount."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_discount").alias("d"))
    pairs = F.collect_list(F.struct((F.col("l_linenumber") - 3).alias("k"), "d"))
    m = li.groupBy("l_orderkey").agg(F.map_from_entries(pairs).alias("scores"))
    return m.select("l_orderkey", A.best_delta(F.col("scores")).cast("long").alias("best_delta"))


Q41_SQL = """
WITH s AS (SELECT l_orderkey, CAST(l_linenumber - 3 AS BIGINT) AS k, max(l_discount) AS d FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, k AS best_delta FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY d DESC, abs(k), k) AS r FROM s) WHERE r = 1
"""


def q42_carry_cosine(spark, sf: str) -> DataFrame:
    """Similarity of each vector to the one before it with the same label."""
    e = table(spark, sf, "embeddings")
    before = scan(e, "label", ["vec_id"], before={"before": F.col("embedding")}).where("before is not null")
    return before.select("vec_id", F.round(A.cosine(F.col("before"), F.col("embedding")), 6).alias("similarity"))


Q42_SQL = """
WITH e AS (SELECT vec_id, embedding AS v, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings)
SELECT vec_id, round(list_cosine_similarity(CAST(p AS DOUBLE[]), CAST(v AS DOUBLE[])), 6) AS similarity FROM e WHERE p IS NOT NULL
"""


def q43_docstring_audit(spark, sf: str) -> DataFrame:
    """Documents and lines that look like licences or symbol junk, by language."""
    line = X.lines(F.col("text"))
    d = table(spark, sf, "documents").select(
        "lang", F.size(F.filter(line, lambda x: F.lower(x).rlike("licen[sc]e|all rights reserved"))).alias("licence"),
        F.size(F.filter(line, lambda x: x.rlike(r"[#*$%&|]{3}"))).alias("junk"),
    )
    return d.groupBy("lang").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("licence") > 0).alias("licence_rows"), F.sum("licence").alias("licence_lines"),
        F.count_if(F.col("junk") > 0).alias("junk_rows"), F.sum("junk").alias("junk_lines"),
    )


Q43_SQL = """
WITH d AS (SELECT lang, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(lower(x), 'licen[sc]e|all rights reserved'))) AS a,
  len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[#*$%&|]{3}'))) AS b FROM documents)
SELECT lang, count(*) AS n_rows, count(*) FILTER (WHERE a > 0) AS licence_rows, CAST(sum(a) AS BIGINT) AS licence_lines, count(*) FILTER (WHERE b > 0) AS junk_rows, CAST(sum(b) AS BIGINT) AS junk_lines FROM d GROUP BY lang
"""


def q44_json_metric_lookup(spark, sf: str) -> DataFrame:
    """A metric by preferred key, then alias, then a missing mark."""
    value = F.coalesce(F.get_json_object("props", "$.score").try_cast("double"), F.get_json_object("props", "$.k").try_cast("double"))
    return table(spark, sf, "events").select("event_id", metrics.or_missing(value).alias("metric"))


def q47_vector_validation(spark, sf: str) -> DataFrame:
    return rules.vector_report(table(spark, sf, "embeddings"), "embedding").select(*[F.col(c).cast("long").alias(c) for c in ("n_rows", "n_widths", "min_width", "max_width", "n_bad")])


def q48_union_status(spark, sf: str) -> DataFrame:
    names = ["region", "nation", "supplier"]
    counts = None
    for n in names:
        c = table(spark, sf, n).agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("name"), "n_rows")
        counts = c if counts is None else counts.unionByName(c)
    return metrics.status_inventory([*names, "shadow"], counts, "name", "n_rows")


QUERIES = {f.__name__: f for f in (
    q25_binary_prf, q26_macro_f1, q26_class_f1, q27_grouped_metrics_total, q30_pass_at_k, q31_rank_records, q32_param_grid, q33_win_loss,
    q34_delta_vs_reference, q35_bucket_coverage, q36_strip_html, q37_last_message, q38_first_nonempty, q39_gsm8k_answer, q40_numeric_margin,
    q41_best_delta, q42_carry_cosine, q43_docstring_audit, q44_json_metric_lookup, q47_vector_validation, q48_union_status,
)}
ORACLE_SQL = {
    "q25_binary_prf": f"WITH {LABELLED}, c AS (SELECT {COUNTS} FROM l) " + PRF.format("1 AS x").replace("1 AS x, ", ""),
    "q26_macro_f1": f"{CLASSES} SELECT round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS macro_f1, count(*) AS n_classes FROM (SELECT *, tp / greatest(tp + fp, 1) AS p, tp / greatest(tp + fn, 1) AS r FROM c)",
    "q26_class_f1": f"{CLASSES} " + PRF.format("label"),
    "q27_grouped_metrics_total": f"WITH {LABELLED}, c AS (SELECT lang, {COUNTS}, grouping(lang) AS is_total FROM l GROUP BY ROLLUP (lang)) " + PRF.format("lang, is_total"),
    "q30_pass_at_k": Q30_SQL,
    "q31_rank_records": Q31_SQL,
    "q32_param_grid": "SELECT r_regionkey, a AS threshold, b AS window_ratio, c AS entropy_gate, d AS weight, replace(printf('%.2f_%.2f_%.2f_%.2f', a, b, c, d), '.', 'p') AS label FROM region, (VALUES (0.25::DOUBLE), (0.5)) AS a(a), (VALUES (0.1::DOUBLE), (0.2)) AS b(b), (VALUES (0.6::DOUBLE), (0.8)) AS c(c), (VALUES (0.0::DOUBLE), (1.0)) AS d(d)",
    "q33_win_loss": Q33_SQL,
    "q34_delta_vs_reference": Q34_SQL,
    "q35_bucket_coverage": "WITH b(bucket, low, high) AS (VALUES " + ", ".join(f"({i}::BIGINT, {a}::DOUBLE, {b}::DOUBLE)" for i, (a, b) in enumerate(BUCKETS)) + ") SELECT bucket, low, high, count(o_orderkey) AS n FROM b LEFT JOIN orders ON o_totalprice BETWEEN low AND high GROUP BY 1, 2, 3",
    "q36_strip_html": _html_sql(),
    "q37_last_message": "SELECT conv_id, arg_max(text, turn) AS last_text, max(turn) AS turn FROM conversations WHERE lower(trim(role)) = 'assistant' AND trim(text) <> '' GROUP BY conv_id",
    "q38_first_nonempty": "SELECT event_id, coalesce(nullif(json_extract_string(props, '$.missing'), ''), nullif(json_extract_string(props, '$.k'), ''), nullif(event_type, ''), 'none') AS value FROM events",
    "q39_gsm8k_answer": Q39_SQL,
    "q40_numeric_margin": "WITH m AS (SELECT o_orderpriority, round(avg(o_totalprice), 2) AS g FROM orders GROUP BY 1) SELECT o_orderkey, round(CASE WHEN g = o_totalprice THEN 1 ELSE 0.2 + 0.6 / (1 + abs(g - o_totalprice) / greatest(abs(o_totalprice), 1)) END, 6) AS score FROM orders JOIN m USING (o_orderpriority)",
    "q41_best_delta": Q41_SQL,
    "q42_carry_cosine": Q42_SQL,
    "q43_docstring_audit": Q43_SQL,
    "q44_json_metric_lookup": "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.score') AS DOUBLE), TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), -1) AS metric FROM events",
    "q47_vector_validation": "SELECT count(*) AS n_rows, count(DISTINCT len(embedding)) AS n_widths, min(len(embedding)) AS min_width, max(len(embedding)) AS max_width, count(*) FILTER (WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0) AS n_bad FROM embeddings",
    "q48_union_status": "WITH n(name) AS (VALUES ('region'), ('nation'), ('supplier'), ('shadow')), c AS (SELECT 'region' AS name, count(*) AS n_rows FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'supplier', count(*) FROM supplier) SELECT name, n_rows, CASE WHEN n_rows IS NULL THEN 'pending' ELSE 'done' END AS status FROM n LEFT JOIN c USING (name)",
}
