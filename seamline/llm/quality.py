"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio of trusted text to the corpus.

Words and word pairs of every text are hashed into buckets. Two multinomials over the buckets are
counted, one from all documents and one from documents labelled good (a sample by hash, bounded by
``TRUSTED_DOCS``; labels of all others go unused). A document's score is the mean, over its n-grams, of
log p(trusted) - log p(corpus); a document is kept if it passes the base rules and its score reaches a
fixed threshold. Counts are whole numbers and the order of summation within a text is fixed, so a rerun
gives the same verdicts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seamline.llm.texts import WordHashes, as_bytes, bound_batches, map_texts, word_hashes

BUCKETS = 65_536
TRUSTED_DOCS = 20_000
THRESHOLD = -0.08
#: N-grams of the expected share that every bucket of both multinomials has on top of its count.
PRIOR = 20
SYMBOLS = b"#*$%&|<>"
NOT_COUNTED = bytes(range(0x80, 0xC0)) + b" \t\n\x0b\x0c\r"
FIELDS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, score double, kept boolean"
)


def _hashed(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def _grams(w: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of a text's words and word pairs."""
    pairs = w[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    pairs ^= pairs >> np.uint64(31)
    return (np.concatenate((w, pairs)) % np.uint64(buckets)).astype(np.int64)


def _repeated(w: np.ndarray) -> int:
    """Words in windows of three that the text has twice or more."""
    if len(w) < 4:
        return 0
    key = w[:-2] * np.uint64(0x9E3779B97F4A7C15) + w[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + w[2:] * np.uint64(0x165667B19E3779F9)
    ordered = np.sort(key)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    twice = np.isin(key, ordered[1:][ordered[1:] == ordered[:-1]])
    inside = np.zeros(len(w), bool)
    for k in range(3):
        inside[k : len(key) + k] |= twice
    return int(inside.sum())


def base_counts(text: bytes, words: list[bytes], w: np.ndarray) -> tuple[int, int, int, int, int]:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text.translate(None, NOT_COUNTED)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        _repeated(w),
    )


def count_grams(df: DataFrame, text: str, trusted: str, buckets: int = BUCKETS) -> DataFrame:
    """``bucket``, ``corpus``, ``trusted``: n-grams of all rows, and of those whose column ``trusted`` is true."""
    schema = pa.schema([("bucket", pa.int32()), ("corpus", pa.int64()), ("trusted", pa.int64())])

    def run(batches):
        hashes, counts = word_hashes(), np.zeros((2, buckets), np.int64)
        for batch in batches:
            for t, good in zip(as_bytes(batch.column(0)), batch.column(1), strict=True):
                words = (t.as_py() or b"").split()
                if words:
                    found = np.bincount(_grams(_hashed(words, hashes), buckets), minlength=buckets)
                    counts[0] += found
                    if good.as_py():
                        counts[1] += found
        some = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[0][some]), pa.array(counts[1][some])], schema=schema)

    parts = bound_batches(df).select(text, trusted).mapInArrow(run, "bucket int, corpus bigint, trusted bigint")
    return parts.groupBy("bucket").agg(F.sum("corpus").alias("corpus"), F.sum("trusted").alias("trusted"))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log p(trusted) - log p(corpus) of every bucket; all 0 without trusted text.

    Corpus counts are scaled to the trusted total, and both get the same prior, so that a bucket that is
    rare in the trusted sample says little. The driver holds ``buckets`` rows.
    """
    table = np.zeros((2, buckets))
    for r in counts.collect():
        table[:, r.bucket] = r.corpus, r.trusted
    if not table[1].sum():
        return np.zeros(buckets)
    expected = table[0] * (table[1].sum() / table[0].sum())
    return np.log(table[1] + PRIOR) - np.log(expected + PRIOR)


def trusted_ids(labels: DataFrame, most: int = TRUSTED_DOCS) -> DataFrame:
    """At most ``most`` documents, by hash, that all their labels call good and not toxic."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and t = 0 and doc_id is not null")
    return good.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Bucket log ratios from all of ``docs`` and its trusted documents."""
    ids = trusted_ids(labels).select(F.col("doc_id").alias("trusted_id"), F.lit(True).alias("trusted"))
    marked = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(ids), F.col("id") == F.col("trusted_id"), "left")
    return log_ratios(count_grams(marked.select("text", F.coalesce("trusted", F.lit(False)).alias("trusted")), "text", "trusted", buckets), buckets)


def verdicts(ratios: np.ndarray, threshold: float = THRESHOLD):
    """A function of a text's bytes: base counts, whether they fail, score, verdict."""
    buckets, hashes = len(ratios), word_hashes()

    def of(t: bytes | None) -> tuple:
        t = t or b""
        words = t.split()
        w = _hashed(words, hashes)
        counts = base_counts(t, words, w)
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        score = float(ratios[_grams(w, buckets)].mean()) if words else 0.0
        return (*counts, failed, score, not failed and score >= threshold)

    return of


def judge(df: DataFrame, text: str, ratios: np.ndarray, keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` (all columns by default) with base counts, score and verdict; columns of the same name are replaced.

    Null and empty texts count 0 of everything, score 0 and fail.
    """
    return map_texts(df, text, FIELDS, lambda: verdicts(ratios, threshold), keep)


def keep_good(df: DataFrame, text: str, ratios: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` that are kept, as they were."""

    def make():
        of = verdicts(ratios, threshold)
        return lambda t: () if of(t)[-1] else None

    return map_texts(df, text, StructType([]), make)


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ratios = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, "text", ratios, ["doc_id"])
