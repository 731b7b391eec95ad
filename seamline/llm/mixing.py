"""Mixing sources to target weights by entropy balancing (DataFrame operations only).

Each document gets a rate of repetition. Among all rates of 0 to 2 that give every source its target
number of words, those nearest in relative entropy to "take everything once" have the form
min(2, exp(lambda * size / mean size)), one lambda a source. The lambdas solve a convex dual; its
gradient and curvature are sums over documents, taken by Spark in each Newton step. Rates depend on
source and size alone, so the steps run over the table of (source, size, count), not over documents.

Rounding keeps to the targets: within a source, from large documents to small ones, running totals of
fractional copies are rounded to whole copies per size, and a few last copies are moved to sizes that
fit what is missing. Which documents of a size get the additional copy is decided by hash rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamline.llm.ranking import number_rows
from seamline.llm.skew import fits_broadcast, salted_join
from seamline.llm.words import word_count
from seamline.session import durable

#: Weights of the sources by code point, repeating.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
STEPS = 40
FINISH = 4
ROWS_PER_BUCKET = 500


def targets(sources: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``source, source_size`` → the same with ``source_no`` and ``target`` (one row a source).

    Sources in order of code point, null last, weigh ``weights``, repeating. Targets stop at ``most``
    times the source's size; the excess is shared again by weight. In order of size per weight, the
    first source that an even filling of the rest does not reach fixes that filling for all after it.
    """
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    s = (
        sources.withColumn("source_no", F.row_number().over(ranked) - 1)
        .withColumn("weight", weight)
        .withColumn("cap", most * F.col("source_size"))
    )
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = s.withColumn("total", share * F.sum("source_size").over(everything)).withColumn(
        "level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    )
    place = F.row_number().over(by_ratio).alias("place")
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(place, F.col("level")))
    s = s.withColumn("fits", fits).withColumn("level", F.min("fits").over(everything)["level"])
    share_of = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return s.select("source", "source_no", "source_size", share_of.alias("target"))


def exact_sum(c: Column) -> Column:
    """A sum that does not depend on the order of rows: terms to six decimals, added as decimals."""
    return F.sum(c.cast("decimal(32,6)")).cast("double")


def solve(classes: DataFrame, goals: DataFrame, steps: int = STEPS) -> DataFrame:
    """Newton iterations on the dual. ``classes``: source_no, size, n, x; returns source_no, lam.

    Newton steps that leave the bracket known so far are replaced by its middle. Sources whose target
    is all they can give (twice their size) or nothing are not iterated.
    """
    state = durable(
        goals.select(
            "source_no",
            "target",
            F.lit(0.0).alias("lam"),
            F.lit(-1e6).alias("low"),
            F.lit(1e6).alias("high"),
            ((F.col("target") <= 0) | (F.col("target") >= MOST * F.col("source_size") * (1 - 1e-12))).alias("done"),
        )
    )
    for _ in range(steps):
        if state.where(~F.col("done")).isEmpty():
            break
        tilt = F.exp(F.least(F.col("lam") * F.col("x"), F.lit(1.0)))
        words = F.col("n") * F.col("size")
        sums = (
            classes.join(state.where(~F.col("done")), "source_no")
            .groupBy("source_no")
            .agg(
                exact_sum(words * F.least(tilt, F.lit(MOST))).alias("f"),
                exact_sum(F.when(tilt < MOST, words * F.col("x") * tilt).otherwise(0.0)).alias("slope"),
            )
        )
        s = state.join(sums, "source_no", "left")
        ended = F.col("done") | (F.abs(F.col("f") - F.col("target")) <= 1e-9 * F.col("target"))
        low = F.when(F.col("f") < F.col("target"), F.col("lam")).otherwise(F.col("low"))
        high = F.when(F.col("f") > F.col("target"), F.col("lam")).otherwise(F.col("high"))
        step = F.col("lam") + (F.col("target") - F.col("f")) / F.nullif(F.col("slope"), F.lit(0.0))
        s = s.select("source_no", "target", "lam", ended.alias("done"), low.alias("low"), high.alias("high"), step.alias("step"))
        moved = F.when((F.col("step") > F.col("low")) & (F.col("step") < F.col("high")), F.col("step")).otherwise(
            (F.col("low") + F.col("high")) / 2
        )
        state = durable(
            s.select("source_no", "target", F.when(F.col("done"), F.col("lam")).otherwise(moved).alias("lam"), "low", "high", "done")
        )
    return state.select("source_no", "lam")


def whole_copies(classes: DataFrame, goals: DataFrame, lams: DataFrame) -> DataFrame:
    """source_no, size, n, base (copies of every document of the size), extra (documents with one more)."""
    full = F.col("target") >= MOST * F.col("source_size") * (1 - 1e-12)
    rate = (
        F.when(F.col("target") <= 0, F.lit(0.0))
        .when(full, F.lit(MOST))
        .otherwise(F.least(F.exp(F.least(F.col("lam") * F.col("x"), F.lit(1.0))), F.lit(MOST)))
    )
    c = classes.drop("source").join(goals.select("source_no", "target", "source_size"), "source_no").join(lams, "source_no")
    c = c.withColumn("rate", rate).withColumn("base", F.floor("rate"))
    run = Window.partitionBy("source_no").orderBy(F.col("size").desc())
    upto = F.floor(F.sum((F.col("rate") - F.col("base")) * F.col("n")).over(run.rowsBetween(Window.unboundedPreceding, 0)) + 0.5)
    c = c.withColumn("upto", upto)
    extra = F.col("upto") - F.coalesce(F.lag("upto").over(run), F.lit(0))
    c = durable(c.select("source_no", "size", "n", "target", "base", F.greatest(F.lit(0), F.least("n", extra)).alias("extra")))
    for _ in range(FINISH):
        each = Window.partitionBy("source_no")
        missing = F.col("target") - F.sum((F.col("base") * F.col("n") + F.col("extra")) * F.col("size")).over(each)
        m = c.withColumn("missing", missing)
        free = F.when(F.col("missing") > 0, (F.col("base") < 2) & (F.col("extra") < F.col("n"))).otherwise(F.col("extra") > 0)
        gap = F.abs(F.abs(F.col("missing")) - F.col("size"))
        best = F.min(F.when(free & (gap < F.abs(F.col("missing"))), F.struct(gap.alias("gap"), F.col("size").alias("at")))).over(each)
        moved = F.when(F.col("size") == best["at"], F.signum("missing").cast("long")).otherwise(0)
        c = m.withColumn("extra", F.col("extra") + moved).drop("missing")
    return durable(c.select("source_no", "size", "n", "base", "extra"))


def mix(rows: DataFrame, key: str, source: Column, size: Column, share: float = SHARE) -> DataFrame:
    """``row`` (a struct of all columns of ``rows``), source, size, source_size, target, copies (0, 1 or 2).

    Nulls in ``source`` are one source, the last; documents of size 0 count for nothing and are kept
    once, or twice in a source whose target is twice its size. Rows repeated with the same key are documents of their own. Two runs give the same rows: which
    of a size get one copy more is drawn by hash of the key, among rows of one key by hash of all columns
    (but maps), so that only equal rows tie. ``rows`` is read twice.
    """
    whole = F.xxhash64(*[F.col(f"`{f.name}`") for f in rows.schema if "map<" not in f.dataType.simpleString()])
    rows = rows.select(F.struct("*").alias("row"), source.alias("source"), size.alias("size"), F.col(key).alias("key"), whole.alias("whole"))
    hist = durable(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    goals = durable(targets(hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), share))
    same = hist["source"].eqNullSafe(goals["source"])
    classes = hist.join(goals.drop("target"), same).select(hist["source"], "source_no", "size", "n", "source_size")
    mean = F.sum("n").over(Window.partitionBy("source_no"))
    x = F.when(F.col("source_size") > 0, F.col("size") * mean / F.col("source_size")).otherwise(0.0)
    classes = durable(classes.select("source", "source_no", "size", "n", x.alias("x")))
    copies = whole_copies(classes, goals, solve(classes, goals))
    named = classes.select("source_no", "source").distinct().join(goals.select("source_no", "source_size", "target"), "source_no")
    copies = durable(copies.join(named, "source_no").withColumnsRenamed({"source": "s", "size": "z"}))

    if fits_broadcast(copies):
        placed = rows.join(F.broadcast(copies), F.col("source").eqNullSafe(F.col("s")) & F.col("size").eqNullSafe(F.col("z"))).drop("s", "z")
    else:
        spot = lambda source, size: F.concat(F.coalesce(F.concat(F.lit("="), source), F.lit("")), F.lit("|"), F.col(size))
        kinds = copies.withColumn("spot", spot(F.col("s").cast("string"), "z")).drop("s", "z")
        spots = rows.withColumn("spot", spot(F.col("source").cast("string"), "size"))
        placed = salted_join(spots, kinds, "spot", F.col("whole"), rows.count()).drop("spot")
    out = ["row", "source", "size", "source_size", "target"]
    fixed = (F.col("extra") == 0) | (F.col("extra") == F.col("n"))
    sure = placed.where(fixed).select(*out, (F.col("base") + (F.col("extra") > 0).cast("long")).alias("copies"))
    open_ = placed.where(~fixed).withColumn("digest", F.xxhash64("key", "size", "source_no"))
    open_ = open_.withColumn("bucket", F.pmod("digest", F.ceil(F.col("n") / ROWS_PER_BUCKET)))
    drawn = number_rows(open_, ["source_no", "size"], "bucket", ["digest", "key", "whole"], "rank")
    drawn = drawn.select(*out, (F.col("base") + (F.col("rank") <= F.col("extra")).cast("long")).alias("copies"))
    return sure.unionByName(drawn)


def op2_entropy_mix(spark, sf_dir: str) -> DataFrame:
    """All documents, with the words of each that the mix takes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted = durable(docs.select("doc_id", "source", word_count(F.col("text")).alias("words")))
    mixed = mix(counted, "doc_id", F.col("source"), F.col("words"))
    return mixed.select(
        F.col("row.doc_id").alias("doc_id"), "size", "source_size", F.col("target").cast("double").alias("target"),
        (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies", "source",
    )
