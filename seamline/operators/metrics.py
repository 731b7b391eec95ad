"""Classification, pass@k, ranking and comparison metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.operators.boundaries import ratio
from seamline.operators.ordering import with_ordinal

MISSING, UNBOUNDED = -1.0, 1e12


def confusion(predicted: Column, actual: Column) -> dict[str, Column]:
    """Aggregates tp, fp and fn of two boolean columns."""
    return {
        "tp": F.count_if(predicted & actual).alias("tp"),
        "fp": F.count_if(predicted & ~actual).alias("fp"),
        "fn": F.count_if(~predicted & actual).alias("fn"),
    }


def with_prf(df: DataFrame) -> DataFrame:
    """precision, recall and F1 of tp, fp, fn; empty denominators count as 1."""
    p = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))
    r = F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    out = df.withColumn("precision", p).withColumn("recall", r)
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def per_class(df: DataFrame, predicted: str, actual: str, vocabulary: list[str]) -> DataFrame:
    """One-versus-rest counts and F1 for every class of the vocabulary, absent ones included.

    One shuffle: each row is one count for its predicted and one for its actual class.
    """
    spark = df.sparkSession
    sides = df.select(F.explode(F.array(
        F.struct(F.col(predicted).alias("label"), (F.col(predicted) == F.col(actual)).alias("hit"), F.lit(True).alias("guess")),
        F.struct(F.col(actual).alias("label"), (F.col(predicted) == F.col(actual)).alias("hit"), F.lit(False).alias("guess")),
    )).alias("s")).select("s.*")
    counts = sides.groupBy("label").agg(
        F.count_if(F.col("guess") & F.col("hit")).alias("tp"),
        F.count_if(F.col("guess") & ~F.coalesce(F.col("hit"), F.lit(False))).alias("fp"),
        F.count_if(~F.col("guess") & ~F.coalesce(F.col("hit"), F.lit(False))).alias("fn"),
    )
    words = spark.createDataFrame([(v,) for v in vocabulary], "label string")
    return with_prf(words.join(counts, "label", "left").na.fill(0, ["tp", "fp", "fn"]))


def macro_f1(classes: DataFrame) -> DataFrame:
    return classes.agg(F.avg("f1").alias("macro_f1"), F.count("*").alias("n_classes"))


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Unbiased pass@k of c correct of n samples."""
    product = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda a, i: a * (1 - F.lit(float(k)) / i))
    return F.when(n - c < k, 1.0).when(c == 0, 0.0).otherwise(1 - product)


def pass_table(df: DataFrame, task: str, passed: Column, ks: tuple[int, ...]) -> DataFrame:
    """k, n_tasks, pass_at_k: means over tasks, for each k that every task has samples for."""
    tasks = df.groupBy(task).agg(F.count("*").alias("n"), F.count_if(passed).alias("c"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), pass_at_k(F.col("n"), F.col("c"), k).alias("p"), F.col("n").alias("n")) for k in ks]))
    rows = tasks.select(each.alias("e")).select("e.*")
    out = rows.groupBy("k").agg(F.count("*").alias("n_tasks"), F.avg("p").alias("pass_at_k"), F.min("n").alias("least"))
    return out.where("least >= k").drop("least")


def or_missing(c: Column) -> Column:
    return F.coalesce(c, F.lit(MISSING))


def or_unbounded(c: Column) -> Column:
    """Negative and missing values sort last in ascending order."""
    return F.when(c >= 0, c).otherwise(UNBOUNDED)


def gate(df: DataFrame, precision: Column, rate_ratio: Column, least: float = 0.8, most: float = 1.5) -> DataFrame:
    """Records whose metrics pass where they are present; all records if none does."""
    p, r = or_missing(precision), or_missing(rate_ratio)
    good = ((p < 0) | (p >= least)) & ((r < 0) | (r <= most))
    flagged = df.withColumn("passes_gate", good)
    any_good = flagged.agg(F.max("passes_gate")).scalar()
    return flagged.where(F.col("passes_gate") | ~F.coalesce(any_good, F.lit(False)))


def ranked(df: DataFrame, keys: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with places from 1 in the total order of ``keys``; rows are dealt by range, so that no task sorts them all."""
    return with_ordinal(df, keys, name).withColumn(name, F.col(name) + 1)


def delta_to(df: DataFrame, name: str, reference: str, value: str) -> DataFrame:
    """``df`` with the difference of ``value`` to that of the row named ``reference`` (null without one)."""
    base = df.where(F.col(name) == reference).agg(F.max(value)).scalar()
    return df.withColumn("delta", F.col(value) - base)


def win_loss(current: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """``key``, passed, other_passed, outcome: "win" where only the other passed, "loss" where only the current one."""
    b = other.select(F.col(key), F.col("passed").alias("other_passed"))
    j = current.join(b, key, "left").withColumn("other_passed", F.coalesce("other_passed", F.lit(False)))
    outcome = F.when(F.col("other_passed") & ~F.col("passed"), "win").when(F.col("passed") & ~F.col("other_passed"), "loss").otherwise("same")
    return j.withColumn("outcome", outcome)


def bucket_coverage(df: DataFrame, value: Column, buckets: list[tuple[float, float]]) -> DataFrame:
    """Rows per inclusive range, empty ranges included; a value counts in every range that holds it.

    The ranges are a literal, so counting is one pass with partial sums.
    """
    spark = df.sparkSession
    counts = df.agg(*[F.count_if(value.between(a, b)).alias(f"b{i}") for i, (a, b) in enumerate(buckets)])
    stack = ", ".join(f"{i}, b{i}" for i in range(len(buckets)))
    counted = counts.select(F.expr(f"stack({len(buckets)}, {stack}) as (bucket, n)"))
    ranges = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(buckets)], "bucket int, low double, high double")
    return ranges.join(counted, "bucket")


def status_inventory(expected: list[str], results: DataFrame, key: str, value: str) -> DataFrame:
    """Every expected key with its value and "done", or "pending" where it is missing."""
    names = results.sparkSession.createDataFrame([(k,) for k in expected], f"{key} string")
    status = F.when(F.col(value).isNull(), "pending").otherwise("done")
    return names.join(results, key, "left").withColumn("status", status)


def positive_rate(labels: Column, mask: Column | None = None) -> tuple[Column, Column]:
    """Sums of positives and of labels, masked or not, to be divided after summing over rows."""
    if mask is None:
        return F.sum(F.aggregate(labels, F.lit(0), lambda s, x: s + x)), F.sum(F.size(labels))
    pairs = F.zip_with(labels, F.coalesce(mask, F.transform(labels, lambda _: F.lit(1))), lambda x, m: x * m)
    ones = F.coalesce(mask, F.transform(labels, lambda _: F.lit(1)))
    return F.sum(F.aggregate(pairs, F.lit(0), lambda s, x: s + x)), F.sum(F.aggregate(ones, F.lit(0), lambda s, x: s + x))


def micro(numerator: Column, denominator: Column, empty: float | None = None) -> Column:
    return ratio(numerator, denominator, empty)
