"""Writers: JSON lines by split, guarded appends, tables, reports and manifests."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.functions import text as X


def enriched(df: DataFrame, mode: str = "separate") -> DataFrame:
    """Segmented rows with family, mode, label schema, boundary types and whether they have a final answer."""
    types = X.boundary_types(F.col("segments"), F.col("source"), F.col("cell_types"), F.col("has_docstring"))
    source = F.lower(X.strip(F.coalesce("source", F.lit(""))))
    out = df.withColumns({
        "source": source, "source_dataset": F.lower(X.strip(F.coalesce("source_dataset", "source", F.lit("")))),
        "segments": X.filled(F.col("segments")), "task_family": X.task_family(F.col("source")), "training_mode": F.lit(mode),
        "label_schema_version": F.lit(X.LABEL_SCHEMA), "segment_boundary_types": types,
    })
    return out.withColumn("has_final_answer_anchor", F.exists("segment_boundary_types", lambda t: F.array_contains(t, "final_answer_anchor")))


def write_jsonl(df: DataFrame, path: str, by: list[str] | None = None, nulls: bool = True, append: bool = False) -> None:
    """JSON lines, null fields included by default, partitioned by ``by`` (empty partitions have no files)."""
    writer = df.write.mode("append" if append else "overwrite").option("ignoreNullFields", not nulls)
    (writer.partitionBy(*by) if by else writer).json(path)


def write_counted(df: DataFrame, path: str, name: str = "written") -> int:
    """``write_jsonl``, returning the rows written, counted in the same pass."""
    from pyspark.sql import Observation

    seen = Observation(name)
    write_jsonl(df.observe(seen, F.count(F.lit(1)).alias("n")), path)
    return seen.get["n"]


def guarded(df: DataFrame, forbidden: list[str]) -> DataFrame:
    """``df``, failing on the first row whose JSON holds a forbidden name (in any case)."""
    body = F.lower(F.to_json(F.struct(*df.columns)))
    hit = F.lit(False)
    for name in forbidden:
        hit = hit | F.contains(body, F.lit(name.lower()))
    first = df.columns[0]
    kind = df.schema[first].dataType
    return df.withColumn(first, F.when(hit, F.raise_error(F.lit("a row names a forbidden benchmark")).cast(kind)).otherwise(F.col(first)))


def append_guarded(df: DataFrame, path: str, forbidden: list[str]) -> None:
    write_jsonl(guarded(df, forbidden), path, append=True)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def markdown(df: DataFrame, columns: list[str], most: int = 1_000) -> str:
    """A table of at most ``most`` rows for a report; more are an error, since a report is small."""
    rows = df.select(*columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    show = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(show(r[c]) for c in columns) + " |" for r in rows]) + "\n"


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small report as one text file in any store that Spark writes."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_splits(train: DataFrame, valid: DataFrame, path: str, summary: DataFrame) -> None:
    """Train and valid rows, and a one-row summary, below ``path``."""
    write_jsonl(train, f"{path}/train")
    write_jsonl(valid, f"{path}/valid")
    write_jsonl(summary, f"{path}/summary")


def subset_manifest(spark: SparkSession, label: str, strategy: str, seed: int, total: int, indices: list[int], buckets: list[tuple[int, int]] = ()) -> DataFrame:
    """A one-row manifest of a subset."""
    row = (datetime.now(timezone.utc).isoformat(), label, strategy, len(indices), seed, total, list(indices), [f"task_{i}" for i in indices], [tuple(b) for b in buckets])
    from seamline.schemas import MANIFEST

    return spark.createDataFrame([row], MANIFEST)


def examples(df: DataFrame, passed: Column, order: str, count: int = 10) -> tuple[DataFrame, DataFrame]:
    """The first successes and the first failures of a report."""
    return df.where(passed).orderBy(order).limit(count), df.where(~passed).orderBy(order).limit(count)
