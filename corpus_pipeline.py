"""The corpus pipeline: documents in, training rows out.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next stage's docs. All but the last return the columns of ``documents``.

In every stage an empty table gives none, columns beyond those of ``documents`` are passed through (but by the last),
whatever they are called, and texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.llm import jaccard, mixing, pieces, pii, quality
from seamline.llm.words import word_count
from seamline.session import stored


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that the base rules or the log-likelihood ratio reject go.

    Null and blank texts are rejected, as all under 50 words; repeated rows are judged alike; a score at the bar stays.
    """
    ratios = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, "text", ratios)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (five words, 0.8): one document of each group of near copies stays.

    Of a group that with the least doc_id stays, rows without one last; repeated rows are one. Texts without a word,
    null ones among them, are like nothing and stay, but for repeated rows.
    """
    return jaccard.keep_one(docs, "doc_id", "text")


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data: confirmed spans are replaced by tags, and ``n_chars`` follows the text.

    Null texts stay null, with a null ``n_chars``; overlapping spans get one tag; repeated rows are changed alike.
    """
    clean = pii.redact(docs, "text")
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: each document none, once or twice.

    Null sources are one, the last; texts without words are kept once, or twice where their source's target is twice its
    size; repeated rows are documents of their own, and which of equal rows is taken once more makes no difference.
    """
    mixed = mixing.mix(docs, "doc_id", F.col("source"), word_count(F.col("text")))
    times = F.sequence(F.lit(1), F.col("copies").cast("int"))
    return mixed.where("copies > 0").select("row", F.explode(times)).select("row.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding: the ids and scores of the best three segmentations.

    Null and empty texts have one empty segmentation; ties go by ids; repeated rows are encoded each.
    """
    return pieces.encode(docs, "text", ["doc_id", "lang", "source"])


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", one_of_each_group),
    ("personal_data", without_personal_data),
    ("mixing", mixed_sources),
    ("pieces", encoded),
]
#: Components, Newton steps and A* search are not expressed in SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
