"""Boundary and trace queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seamline.functions import arrays as A
from seamline.functions import text as X
from seamline.operators import boundaries as B
from seamline.operators import ordering
from seamline.session import table, texts

LEFT = "SELECT doc_id, sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS o, i, len(l) AS n FROM (SELECT doc_id, l, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(text, '.') AS l FROM documents))"
RIGHT = "SELECT doc_id, sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS o, i, len(l) AS n FROM (SELECT doc_id, l, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
CUTS = f"""
WITH l AS (SELECT doc_id, o FROM ({LEFT}) WHERE i < n), r AS (SELECT doc_id, o FROM ({RIGHT}) WHERE i < n),
both_sides AS (SELECT DISTINCT doc_id FROM l INTERSECT SELECT DISTINCT doc_id FROM r),
u AS (SELECT doc_id, o, max(a) AS a, max(b) AS b FROM (SELECT doc_id, o, 1 AS a, 0 AS b FROM l UNION ALL SELECT doc_id, o, 0, 1 FROM r)
  WHERE doc_id IN (SELECT doc_id FROM both_sides) GROUP BY doc_id, o),
d AS (SELECT doc_id, sum(a) AS n_left, sum(b) AS n_right, sum(a * b) AS n_shared, count(*) AS n_union FROM u GROUP BY doc_id)
"""


def _pairs(spark, sf: str) -> DataFrame:
    """Sentence ends and line ends of each document that has both."""
    docs = texts(spark, sf).select("doc_id", B.cut_offsets(F.col("text"), ".").alias("l"), B.cut_offsets(F.col("text"), "\n", True).alias("r"))
    return docs.where((F.size("l") > 0) & (F.size("r") > 0))


def q01_boundary_overlap(spark, sf: str) -> DataFrame:
    d = B.overlap_counts(_pairs(spark, sf), "l", "r")
    m = B.overlap_metrics(F.col("n_shared"), F.col("n_left"), F.col("n_right"))
    return d.select(
        "doc_id", *[F.col(c).cast("long").alias(c) for c in ("n_left", "n_right", "n_shared", "n_union")],
        F.round(F.col("n_shared") / F.col("n_union"), 6).alias("jaccard"),
        F.round(m["precision"], 6).alias("precision"), F.round(m["recall"], 6).alias("recall"),
    )


def q01_boundary_overlap_total(spark, sf: str) -> DataFrame:
    d = B.overlap_counts(_pairs(spark, sf), "l", "r")
    sums = {c: F.sum(c).cast("long").alias(c) for c in ("n_left", "n_right", "n_shared", "n_union")}
    t = d.agg(F.count("*").alias("n_documents"), *sums.values())
    return t.select(
        "n_documents", *sums, F.round(B.ratio(F.col("n_shared"), F.col("n_union")), 6).alias("jaccard"),
        F.round(B.ratio(F.col("n_shared"), F.col("n_left")), 6).alias("precision"), F.round(B.ratio(F.col("n_shared"), F.col("n_right")), 6).alias("recall"),
    )


def q02_tolerance_match(spark, sf: str) -> DataFrame:
    d = B.overlap_counts(_pairs(spark, sf), "l", "r")
    sums = [F.sum(f"{s}_within_{t}").cast("long").alias(f"{s}_within_{t}") for s in ("left", "right") for t in B.TOLERANCES]
    return d.agg(*sums)


def q03_nearest_distance(spark, sf: str) -> DataFrame:
    pairs = _pairs(spark, sf)
    left, right = (pairs.select("doc_id", F.explode(c).alias("offset")) for c in ("l", "r"))
    return B.distance_summary(B.nearest_distances(left, right, "doc_id")).select("n", *[F.round(c, 6).alias(c) for c in ("mean_distance", "median_distance", "p90_distance")])


def q04_full_outer_alignment(spark, sf: str) -> DataFrame:
    """Hours of purchases and of errors of each user as two boundary sets."""
    e = table(spark, sf, "events").select("user_id", "event_type", F.hour("ts").alias("position"))
    both = B.aligned_sets(*[e.where(F.col("event_type") == t) for t in ("purchase", "error")], "user_id", "position")
    shared = F.size(F.array_intersect("left_positions", "right_positions"))
    m = B.overlap_metrics(shared, F.size("left_positions"), F.size("right_positions"), 0.0)
    near = [B.mean_nearest(F.col(a), F.col(b)) for a, b in (("left_positions", "right_positions"), ("right_positions", "left_positions"))]
    return both.select(
        "user_id", shared.cast("long").alias("n_shared"), *[F.round(c, 6).alias(n) for n, c in m.items()],
        F.round(near[0], 6).alias("left_distance"), F.round(near[1], 6).alias("right_distance"),
    )


Q04_SQL = """
WITH e AS (SELECT DISTINCT user_id, event_type, hour(ts) AS p FROM events WHERE event_type IN ('purchase', 'error')),
l AS (SELECT user_id, list(p) AS l FROM e WHERE event_type = 'purchase' GROUP BY user_id),
r AS (SELECT user_id, list(p) AS r FROM e WHERE event_type = 'error' GROUP BY user_id),
j AS (SELECT user_id, coalesce(l, []) AS l, coalesce(r, []) AS r FROM l FULL JOIN r USING (user_id)),
k AS (SELECT *, len(list_intersect(l, r)) AS n_shared FROM j),
m AS (SELECT *, CASE WHEN len(l) > 0 THEN n_shared / len(l) ELSE 0 END AS p, CASE WHEN len(r) > 0 THEN n_shared / len(r) ELSE 0 END AS q FROM k)
SELECT user_id, n_shared, round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 6) AS f1,
  round(CASE WHEN len(l) > 0 AND len(r) > 0 THEN list_avg(list_transform(l, lambda x: list_min(list_transform(r, lambda y: abs(x - y))))) ELSE 0 END, 6) AS left_distance,
  round(CASE WHEN len(l) > 0 AND len(r) > 0 THEN list_avg(list_transform(r, lambda x: list_min(list_transform(l, lambda y: abs(x - y))))) ELSE 0 END, 6) AS right_distance
FROM m
"""


def _trace(spark, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id", (F.floor(F.abs("value")) % 32 + 1).alias("block_length"))
    return B.trace_offsets(e, "user_id", ["event_id"], "block_length")


def q05_running_offsets(spark, sf: str) -> DataFrame:
    return _trace(spark, sf).select("event_id", "user_id", F.col("step_index").cast("long").alias("step_index"), "block_length", "generated_length", "offset")


TRACE = """SELECT event_id, user_id, row_number() OVER w - 1 AS step_index, block_length,
  CAST(sum(block_length) OVER w - block_length AS BIGINT) AS generated_length, CAST(sum(block_length) OVER w AS BIGINT) AS "offset"
FROM (SELECT event_id, user_id, CAST(floor(abs(value)) AS BIGINT) % 32 + 1 AS block_length FROM events)
WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def q06_terminal_drop(spark, sf: str) -> DataFrame:
    return B.drop_terminal(_trace(spark, sf), "user_id").select("event_id", "user_id", "offset")


def q23_sentence_segments(spark, sf: str) -> DataFrame:
    return texts(spark, sf).select("doc_id", F.size(X.sentences(F.col("text"))).cast("long").alias("n_segments"))


Q23_SQL = r"""
WITH t AS (SELECT doc_id, trim(regexp_replace(text, '[ \t]+', ' ', 'g'), E' \n') AS t FROM documents),
p AS (SELECT doc_id, unnest(string_split_regex(t, '\n\s*\n+')) AS p FROM t WHERE t <> ''),
s AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(p, '([.?!;:])\s+([A-Z0-9$\\(\["''])', E'\\1\x01\\2', 'g'), '([.?!;:])\s+([A-Z0-9$\\(\["''])', E'\\1\x01\\2', 'g'), chr(1))) AS s FROM p)
SELECT d.doc_id, count(s) FILTER (WHERE trim(s) <> '') AS n_segments FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id
"""


def q24_boundary_labels(spark, sf: str) -> DataFrame:
    """Blank-separated tokens of lines as segments; the last token of each is a boundary."""
    counts = F.transform(F.split("text", "\n", -1), lambda s: F.size(F.filter(F.split(s, " ", -1), lambda w: w != "")))
    docs = texts(spark, sf).select("doc_id", A.segment_labels(F.filter(counts, lambda n: n > 0), F.lit(0)).alias("labels"))
    ones = F.aggregate("labels", F.lit(0), lambda s, x: s + x)
    return docs.select(
        "doc_id", F.size("labels").cast("long").alias("n_tokens"), ones.cast("long").alias("n_boundaries"),
        F.round(B.ratio(ones, F.size("labels")), 6).alias("positive_rate"),
    )


Q24_SQL = """
WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents),
n AS (SELECT doc_id, len(list_filter(string_split(s, ' '), lambda w: w <> '')) AS n FROM s),
c AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_tokens, count(*) FILTER (WHERE n > 0) AS n_boundaries FROM n GROUP BY doc_id)
SELECT doc_id, n_tokens, n_boundaries, round(n_boundaries / nullif(n_tokens, 0), 6) AS positive_rate FROM c
"""


def q28_phase_transitions(spark, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    w = Window.partitionBy("user_id").orderBy("event_id")
    nxt = F.coalesce(F.lead("event_type").over(w), F.col("event_type"))
    return e.withColumn("changes", (F.col("event_type") != nxt).cast("long")).groupBy("user_id").agg(F.count("*").alias("n_events"), F.sum("changes").alias("n_transitions"))


Q28_SQL = """
SELECT user_id, count(*) AS n_events, CAST(sum(CASE WHEN event_type <> nxt THEN 1 ELSE 0 END) AS BIGINT) AS n_transitions
FROM (SELECT user_id, event_type, lead(event_type, 1, event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM events) GROUP BY user_id
"""


def q29_gaps_and_islands(spark, sf: str) -> DataFrame:
    i = ordering.islands(table(spark, sf, "events"), "user_id", ["event_id"], "event_type")
    return i.select("user_id", F.col("island").cast("long").alias("island"), "event_type", "n", "first_at", "last_at")


Q29_SQL = """
WITH a AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
b AS (SELECT *, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS island FROM a)
SELECT user_id, island, any_value(event_type) AS event_type, count(*) AS n, min(event_id) AS first_at, max(event_id) AS last_at FROM b GROUP BY user_id, island
"""

QUERIES = {f.__name__: f for f in (
    q01_boundary_overlap, q01_boundary_overlap_total, q02_tolerance_match, q03_nearest_distance, q04_full_outer_alignment, q05_running_offsets,
    q06_terminal_drop, q23_sentence_segments, q24_boundary_labels, q28_phase_transitions, q29_gaps_and_islands,
)}
ORACLE_SQL = {
    "q01_boundary_overlap": CUTS + "SELECT doc_id, CAST(n_left AS BIGINT) AS n_left, CAST(n_right AS BIGINT) AS n_right, CAST(n_shared AS BIGINT) AS n_shared, n_union, round(n_shared / n_union, 6) AS jaccard, round(n_shared / n_left, 6) AS precision, round(n_shared / n_right, 6) AS recall FROM d",
    "q01_boundary_overlap_total": CUTS + "SELECT count(*) AS n_documents, CAST(sum(n_left) AS BIGINT) AS n_left, CAST(sum(n_right) AS BIGINT) AS n_right, CAST(sum(n_shared) AS BIGINT) AS n_shared, CAST(sum(n_union) AS BIGINT) AS n_union, round(sum(n_shared) / sum(n_union), 6) AS jaccard, round(sum(n_shared) / sum(n_left), 6) AS precision, round(sum(n_shared) / sum(n_right), 6) AS recall FROM d",
    "q02_tolerance_match": CUTS + ", ll AS (SELECT doc_id, list(o) FILTER (WHERE a = 1) AS l, list(o) FILTER (WHERE b = 1) AS r FROM u GROUP BY doc_id) SELECT " + ", ".join(
        f"CAST(sum(len(list_filter({q}, lambda x: len(list_filter({r}, lambda y: abs(x - y) <= {t})) > 0))) AS BIGINT) AS {s}_within_{t}" for s, q, r in (("left", "l", "r"), ("right", "r", "l")) for t in B.TOLERANCES) + " FROM ll",
    "q03_nearest_distance": CUTS + ", ll AS (SELECT doc_id, list(o) FILTER (WHERE a = 1) AS l, list(o) FILTER (WHERE b = 1) AS r FROM u GROUP BY doc_id), g AS (SELECT unnest(list_transform(l, lambda x: list_min(list_transform(r, lambda y: abs(x - y))))) AS g FROM ll) SELECT count(*) AS n, round(avg(g), 6) AS mean_distance, round(quantile_cont(g, 0.5), 6) AS median_distance, round(quantile_cont(g, 0.9), 6) AS p90_distance FROM g",
    "q04_full_outer_alignment": Q04_SQL,
    "q05_running_offsets": TRACE,
    "q06_terminal_drop": f'WITH t AS ({TRACE}), m AS (SELECT *, max("offset") OVER (PARTITION BY user_id) AS last FROM t) SELECT event_id, user_id, "offset" FROM m WHERE "offset" < last',
    "q23_sentence_segments": Q23_SQL,
    "q24_boundary_labels": Q24_SQL,
    "q28_phase_transitions": Q28_SQL,
    "q29_gaps_and_islands": Q29_SQL,
}
