"""Lengths and choices from scores, stop strings and scorer callbacks, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.functions import generation as G
from seamline.functions import scheduling as S
from seamline.operators import oracle_rows as O
from seamline.operators import scoring
from seamline.plans.oracle_rows import ORACLE_SQL as ROWS_SQL
from seamline.plans.oracle_rows import order_documents
from seamline.session import table, texts

#: Overlapping on purpose: some begin within others.
STOPS = [". The", "the th", "he a", "\n\n", "er the re", "ing ed the", " an"]
GEN, DEFAULT, DELIMITERS = 128, 20, [0, 3]


def _signals(spark, sf: str) -> DataFrame:
    """Vectors as signals: tokens by hundredths modulo 7, confidence by size, learned scores by distance from a quarter."""
    v = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return v.select(
        "vec_id", F.transform("v", lambda x: (F.floor(F.abs(x) * 100) % 7).cast("int")).alias("tokens"), F.transform("v", lambda x: F.abs(x)).alias("confidence"),
        F.transform("v", lambda x: 1 - F.abs(F.abs(x) - 0.25)).alias("learned"),
    )


def q82_window_lengths(spark, sf: str) -> DataFrame:
    """Block lengths by delimiters alone, blended with learned scores, and blended at a bar that is seldom reached."""
    c = [F.col("tokens"), F.col("confidence"), DELIMITERS, F.lit(GEN), (F.col("vec_id") % GEN).cast("int"), F.lit(DEFAULT)]
    plain = S.window_block_length(*c, threshold=0.2)
    both = S.window_block_length(*c, threshold=0.2, learned=F.col("learned"), weight=0.7)
    strict = S.window_block_length(*c, threshold=0.2, learned=F.col("learned"), weight=0.4, learned_threshold=0.5)
    return _signals(spark, sf).select("vec_id", plain.alias("plain"), both.alias("blended"), strict.alias("strict"))


_SIGNALS = """
WITH e AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x)) AS c FROM embeddings),
s AS (SELECT vec_id, c, list_transform(c, lambda x: floor(x * 100) % 7) AS t, list_transform(c, lambda x: 1 - abs(x - 0.25)) AS l FROM e)"""
Q82_SQL = _SIGNALS + f""",
w AS (SELECT *, {GEN} - vec_id % {GEN} AS rest, least({int(GEN * S.WINDOW_RATIO)}, {GEN} - vec_id % {GEN}) AS n FROM s),
d AS (SELECT *, least({DEFAULT}, rest) AS held, list_transform(range(1, n + 1), lambda i: CASE WHEN t[i] IN (0, 3) THEN c[i] END) AS m,
  list_transform(range(1, n + 1), lambda i: l[i] * 0.7 + CASE WHEN t[i] IN (0, 3) THEN c[i] ELSE 0 END * (1 - 0.7)) AS b,
  list_transform(range(1, n + 1), lambda i: l[i] * 0.4 + CASE WHEN t[i] IN (0, 3) THEN c[i] ELSE 0 END * (1 - 0.4)) AS k FROM w),
p AS (SELECT *, CASE WHEN list_max(m) >= 0.2 THEN list_position(m, list_max(m)) ELSE held END AS plain FROM d)
SELECT vec_id, CAST(plain AS INT) AS plain, CAST(CASE WHEN list_max(b) >= 0.2 THEN list_position(b, list_max(b)) ELSE plain END AS INT) AS blended,
  CAST(CASE WHEN list_max(k) >= 0.5 THEN list_position(k, list_max(k)) ELSE plain END AS INT) AS strict FROM p"""


def q83_position_transfer(spark, sf: str) -> DataFrame:
    """Positions of vectors taken over by thresholds that rise along the sequence; every third position is settled already."""
    thresholds = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.lit(0.05) + i * 0.004)
    masked = F.transform("confidence", lambda _, i: ((i + F.col("vec_id")) % 3 != 0).cast("int"))
    t = S.transfer_by_position(F.col("confidence"), masked, thresholds, (F.col("vec_id") % 50).cast("int"))
    return _signals(spark, sf).select("vec_id", F.array_join(F.transform(t, lambda x: x.cast("string")), "").alias("taken"))


Q83_SQL = _SIGNALS + """,
m AS (SELECT vec_id, list_transform(range(1, len(c) + 1), lambda i: CASE WHEN (i - 1 + vec_id) % 3 <> 0 THEN c[i] END) AS o FROM s)
SELECT vec_id, array_to_string(list_transform(range(1, len(o) + 1), lambda i: CASE WHEN i = list_position(o, list_max(o))
  OR (vec_id % 50 + i - 1 < 100 AND o[i] >= 0.05 + (vec_id % 50 + i - 1) * 0.004) THEN '1' ELSE '0' END), '') AS taken FROM m"""


def q84_stop_cuts(spark, sf: str) -> DataFrame:
    """Documents cut at seven stop strings that overlap: where, and the digest of what is left."""
    d = texts(spark, sf).select("doc_id", "text", G.first_stop(F.col("text"), STOPS).cast("long").alias("cut"))
    return d.select("doc_id", "cut", F.md5(G.cut_at_first_stop(F.col("text"), STOPS)).alias("digest"))


def _cuts() -> str:
    quoted = [s.replace("\n", "' || chr(10) || '") for s in STOPS]
    steps, left = [], "length(text)"
    for k, (s, q) in enumerate(zip(STOPS, quoted, strict=True)):
        before = f"c{k - 1}" if k else "c"
        steps.append(f"s{k} AS (SELECT *, CASE WHEN strpos(text, '{q}') > 0 AND strpos(text, '{q}') - 1 + {len(s)} <= {before} THEN strpos(text, '{q}') - 1 ELSE {before} END AS c{k} FROM {f's{k - 1}' if k else 'd'})")
    return f"WITH d AS (SELECT doc_id, text, {left} AS c FROM documents), {', '.join(steps)} SELECT doc_id, c{len(STOPS) - 1} AS cut, md5(regexp_replace(left(text, c{len(STOPS) - 1}), '\\s+$', '')) AS digest FROM s{len(STOPS) - 1}"


def price_scorer():
    """The scores of q76 by callback: -1 scores the price, 0 a flat 30,000, 2 ten times the quantity, other deltas less than all."""
    of = {"-1": lambda c: c.doc["value"][c.index], "0": lambda _: 30000.0, "2": lambda c: c.doc["oracle_block_sizes"][c.index] * 1000.0}
    return lambda batch: [of.get(c.name, lambda _: -1.0)(c) if c.index % 2 else float(c.name == "0") for c in batch]


def q85_scored_corrections(spark, sf: str) -> DataFrame:
    """The rows of q76, their scores coming from a scorer that is called for every block end and delta."""
    docs = scoring.scored(order_documents(spark, sf), price_scorer, scoring.by_delta())
    rows = O.correction_rows(docs.withColumn("scores", scoring.delta_scores()))
    return rows.select("sample_id", "boundary_index", "best_delta", "gate_target", "delta_target", "source_dataset")


def carry_scorer():
    """The scores of q75 by callback: the line's price for carrying on, 30,000 for not, at odd places."""
    return lambda batch: [(c.doc["value"][c.index] if c.name == "carry_on" else 30000.0) if c.index % 2 else 0.0 for c in batch]


def q86_scored_gates(spark, sf: str) -> DataFrame:
    """The rows of q75 by a scorer that is called for every block end with its state carried on and not."""
    docs = scoring.scored(O.several_blocks(order_documents(spark, sf)), carry_scorer, scoring.by_carry())
    rows = O.gate_rows(docs.withColumn("scores", scoring.carry_scores()))
    return rows.select("sample_id", "transition_index", "gate_target", F.col("gate_scores.carry_on").alias("carry_on"), F.get("features", 0).alias("feature"), F.size("oracle_block_sizes").alias("n_blocks"))


QUERIES = {f.__name__: f for f in (q82_window_lengths, q83_position_transfer, q84_stop_cuts, q85_scored_corrections, q86_scored_gates)}
ORACLE_SQL = {
    "q82_window_lengths": Q82_SQL, "q83_position_transfer": Q83_SQL, "q84_stop_cuts": _cuts(),
    "q85_scored_corrections": ROWS_SQL["q76_correction_rows"], "q86_scored_gates": ROWS_SQL["q75_gate_rows"],
}
