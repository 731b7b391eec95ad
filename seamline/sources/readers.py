"""Readers: JSON lines and documents, traces, notebooks, token streams, manifests, logs.

All go through Spark's own sources, so paths can be in any store that Spark reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seamline import schemas
from seamline.functions.arrays import empty
from seamline.functions.text import filled, rx
from seamline.operators.boundaries import expand_history

#: Keys under which a JSON document can hold its records.
WRAPPERS = ("data", "rows", "items", "train", "valid", "test")
MODES = {"raise": "FAILFAST", "skip": "DROPMALFORMED", "keep": "PERMISSIVE"}


def jsonl(spark: SparkSession, path: str, schema: StructType | str | None = None, bad: str = "raise", glob: str | None = None, recursive: bool = False) -> DataFrame:
    """JSON lines, plain or compressed; blank lines are skipped. ``bad``: raise, skip or keep (in ``_corrupt_record``)."""
    reader = spark.read.option("mode", MODES[bad]).option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def numbered_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """file, line (from 1), value: lines in their order, for readers that need it.

    A file is one record here, so that its lines stay in order; the reader is for sources of many
    moderate files (token streams, logs, manifests).
    """
    reader = spark.read.format("text").option("wholetext", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return files.select("file", F.posexplode(F.split("value", "\r?\n", -1)).alias("line", "value")).withColumn("line", F.col("line") + 1)


def strict_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines whose first bad line is an error that names file and line; no rows are an error too."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = numbered_lines(spark, path).where(F.col("value").rlike(r"\S"))
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    sound = F.col("value").rlike(r"(?s)\A\s*\{") & F.try_parse_json("value").isNotNull()
    where = F.concat(F.lit("not a JSON object: "), F.col("file"), F.lit(":"), F.col("line").cast("string"))
    rows = rows.select("file", "line", F.when(sound, parsed).otherwise(F.raise_error(where).cast(schema)).alias("r"))
    if rows.select("line").isEmpty():
        raise ValueError(f"{path} has no rows")
    return rows.select("file", "line", "r.*")


def records(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Records of Parquet, JSON lines, a JSON array, or JSON objects that hold arrays under known keys."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith((".jsonl", ".jsonl.gz")):
        return jsonl(spark, path, schema, "skip")
    text = spark.read.format("text").option("wholetext", True).load(path)
    kind = f"array<{schema.simpleString()}>"
    parts = [F.from_json(F.get_json_object("value", f"$.{k}"), kind) for k in WRAPPERS]
    wrapped = F.flatten(F.filter(F.array(*parts), lambda p: p.isNotNull()))
    found = F.when(F.col("value").rlike(r"(?s)\A\s*\["), F.from_json("value", kind)).otherwise(wrapped)
    return text.select(F.explode(F.filter(found, lambda r: r.isNotNull())).alias("r")).select("r.*")


def traces(spark: SparkSession, path: str) -> DataFrame:
    """Scheduler events of a file or of ``rank_*.jsonl`` below a folder, malformed lines being errors."""
    many = not path.endswith((".jsonl", ".jsonl.gz"))
    return jsonl(spark, path, schemas.TRACE, "raise", "rank_*.jsonl" if many else None, many)


def predictions_as_traces(spark: SparkSession, path: str) -> DataFrame:
    """Prediction records, one row a block."""
    return expand_history(jsonl(spark, path, schemas.PREDICTION, "raise"), "sample_id", "block_history")


def segmented(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, schemas.SEGMENTED, "raise", "*.jsonl", True)


def code_corpus(spark: SparkSession, path: str, schema: str = "code STRING, original_string STRING, docstring STRING, repo STRING, path STRING, func_name STRING") -> DataFrame:
    """Code rows with ``split`` and ``language`` taken from the file's path (…/language/…/split/…)."""
    df = jsonl(spark, path, schema, "skip", "*.jsonl*", True).withColumn("file", F.input_file_name())
    split = F.regexp_extract("file", r"/(train|valid|test)[/_.]", 1)
    language = F.regexp_extract("file", r"/(python|java|javascript|php|ruby|go)/", 1)
    code = F.coalesce(F.nullif(F.col("code"), F.lit("")), "original_string")
    return df.withColumns({"split": F.nullif(split, F.lit("")), "language": F.nullif(language, F.lit("")), "code": code})


def token_documents(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Documents of a token stream: ``# newdoc id =`` begins one, ``Seg=B-seg`` in the last field a segment.

    source, split, doc_id, tokens (an array of token arrays, one a segment). Lines of under ten fields are
    no tokens; documents without tokens go.
    """
    lines = numbered_lines(spark, path)
    opened = F.regexp_extract("value", r"\A#\s*newdoc id\s*=\s*(.*)\z", 1)
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    fields = F.split("value", "\t", -1)
    rows = lines.withColumn("doc_id", F.trim(opened)).withColumn("document", F.sum((F.col("doc_id") != "").cast("int")).over(w))
    rows = rows.withColumn("doc_id", F.last(F.nullif("doc_id", F.lit("")), True).over(w))
    rows = rows.withColumns({"token": F.get(fields, 1), "last": F.element_at(fields, -1)}).where((F.size(fields) >= 10) & (F.col("document") > 0) & ~F.startswith("value", F.lit("#")))
    rows = rows.withColumn("segment", F.sum((F.col("last") == "Seg=B-seg").cast("int")).over(Window.partitionBy("file", "document").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))
    segments = rows.groupBy("file", "document", "doc_id", "segment").agg(F.array_sort(F.collect_list(F.struct("line", "token"))).alias("t"))
    segments = segments.withColumn("t", F.transform("t", lambda x: x["token"]))
    docs = segments.groupBy("file", "document", "doc_id").agg(F.array_sort(F.collect_list(F.struct("segment", "t"))).alias("s"))
    return docs.select(F.lit("gum").alias("source"), F.lit(split).alias("split"), "doc_id", F.transform("s", lambda s: s["t"]).alias("tokens"))


def notebooks(spark: SparkSession, path: str) -> DataFrame:
    """Notebooks with ordered cell types and texts; ``valid`` tells those that are JSON with cells.

    A cell's source is a string or a list of strings; both become text.
    """
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.ipynb").load(path)
    files = files.select(F.col("_metadata.file_path").alias("notebook_path"), "value")
    cells = F.from_json(F.get_json_object("value", "$.cells"), "array<struct<cell_type:string,source:string>>")
    listed = F.from_json(F.col("c.source"), "array<string>")
    text = F.when(F.startswith("c.source", F.lit("[")) & listed.isNotNull(), F.array_join(listed, "")).otherwise(F.col("c.source"))
    rows = files.select("notebook_path", F.posexplode_outer(cells).alias("i", "c")).withColumn("text", text)
    return rows.groupBy("notebook_path").agg(
        F.max(F.col("c").isNotNull()).alias("valid"),
        F.array_sort(F.collect_list(F.when(F.col("c").isNotNull(), F.struct("i", F.coalesce("c.cell_type", F.lit("unknown")).alias("kind"), F.coalesce("text", F.lit("")).alias("text"))))).alias("cells"),
    ).select("notebook_path", "valid", F.transform("cells", lambda c: c["kind"]).alias("cell_types"), F.transform("cells", lambda c: c["text"]).alias("cell_texts"))


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """id, position: one trimmed id a line, blank lines out."""
    rows = numbered_lines(spark, path).select(F.trim("value").alias("id"), F.col("line").alias("position"))
    return rows.where("id <> ''")


def cached_strings(spark: SparkSession, path: str) -> DataFrame:
    """position, text: JSON strings, one a line, in order; any other value raises."""
    rows = numbered_lines(spark, path).where(F.col("value").rlike(r"\S"))
    text = F.get_json_object(F.concat(F.lit('{"v":'), F.col("value"), F.lit("}")), "$.v")
    sound = F.col("value").rlike(r'(?s)\A\s*".*"\s*\z')
    where = F.concat(F.lit("not a JSON string: line "), F.col("line").cast("string"))
    return rows.select(F.col("line").alias("position"), F.when(sound, text).otherwise(F.raise_error(where)).alias("text"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """position, idx: the indices of a subset manifest, in its order. An empty manifest is an error."""
    m = spark.read.schema(schemas.MANIFEST).option("multiLine", True).json(path)
    rows = m.select(F.posexplode("indices").alias("position", "idx"))
    if rows.isEmpty():
        raise ValueError(f"{path} has no indices")
    return rows


def metric_documents(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """file, modified, task, metric, value: numeric leaves of result documents."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    files = files.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"), "value")
    tasks = F.from_json(F.get_json_object("value", "$.results"), "map<string,map<string,string>>")
    rows = files.select("file", "modified", F.explode(tasks).alias("task", "m")).select("file", "modified", "task", F.explode("m").alias("metric", "v"))
    return rows.select("file", "modified", "task", "metric", F.col("v").try_cast("double").alias("value")).where("value is not null")


def latest_file(spark: SparkSession, path: str, glob: str, by: str = "time") -> str | None:
    """The newest file by modification time, or the greatest path (``by`` = "path")."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    best = F.max("path") if by == "path" else F.max_by("path", F.struct("modificationTime", "path"))
    return files.agg(best.alias("p")).first()["p"]


def step_files(spark: SparkSession, path: str, glob: str = "*.pt") -> DataFrame:
    """path, step: checkpoint files by the number in their names, ascending."""
    from seamline.functions.text import step_of_path

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", step_of_path(F.col("path")).alias("step")).where("step is not null").orderBy("step", "path")


def folder_sizes(spark: SparkSession, path: str) -> DataFrame:
    """name, n_files, bytes of each folder directly below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    root = path.rstrip("/").split(":", 1)[-1].lstrip("/")
    name = F.regexp_extract("path", rf"\Q{root}\E/([^/]+)/", 1)
    return files.groupBy(name.alias("name")).agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes"))


def log_averages(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The last "name: number" or "name = number" of each name in whole log files."""
    logs = spark.read.format("text").option("wholetext", True).load(path).select(F.col("_metadata.file_path").alias("file"), "value")
    found = {n: F.regexp_extract_all("value", F.lit(rf"(?i)\Q{n}\E\s*[:=]\s*(-?[0-9.]+)"), F.lit(1)) for n in names}
    return logs.select("file", *[F.try_element_at(c, F.lit(-1)).try_cast("double").alias(n) for n, c in found.items()])


def unify_labels(df: DataFrame, tokens_of: Column | None = None) -> DataFrame:
    """``input_ids`` and ``boundary_labels`` of any of three layouts: labels, positions, or segments.

    Segments count blank-separated words as tokens unless ``tokens_of`` gives an array of token counts.
    Rows of no layout, or whose arrays differ in length, raise.
    """
    from seamline.functions.arrays import positions_to_labels, segment_labels

    parts = filled(F.col("segments"))
    counts = F.transform(parts, lambda s: F.size(F.filter(F.split(s, rx(r"\s+"), -1), lambda w: w != ""))) if tokens_of is None else tokens_of
    by_segment = segment_labels(counts, F.lit(0))
    by_position = positions_to_labels(F.size("input_ids"), F.col("boundary_positions"))
    labels = (
        F.when(F.col("segments").isNotNull(), by_segment)
        .when(F.col("boundary_labels").isNotNull(), F.col("boundary_labels"))
        .when(F.col("boundary_positions").isNotNull(), by_position)
        .otherwise(F.raise_error(F.lit("a row has neither segments nor labels nor positions")).cast("array<int>"))
    )
    ids = F.coalesce("input_ids", F.when(F.size(labels) > 0, F.sequence(F.lit(0), F.size(labels) - 1)).otherwise(empty("int")))
    same = F.size(ids) == F.size(labels)
    checked = F.when(same, labels).otherwise(F.raise_error(F.lit("labels and tokens differ in length")).cast("array<int>"))
    return df.withColumns({"boundary_labels": checked, "input_ids": ids})
