"""Vector code compression: codebooks by parts of vectors, nearest entries found by annular norm pruning.

Components are made integers (floor of ``scale`` times x), so that all distances, sums and codes are exact. A
codebook has at most 256 entries; each round sends it to every task (at most ``ENTRIES`` times the vector's
length in numbers, whatever the table's size), and every task returns sums and counts by entry, added up by Spark.

Nearest entry: entries are sorted by norm. The distance to the tile of entries about a part's own norm bounds its best;
entries whose norm differs by more than that cannot be nearer, so a binary search gives the interval of norms, ends
included, that is evaluated exactly. Parts whose intervals cover the same tiles are evaluated together.

Defined cases: rows whose vector is null, empty, or holds nulls or non-finite components are dropped; a length that
parts do not divide is filled up with zeros; vectors of another length than that of the least vec_id are dropped, as
they cannot be compared; components beyond what 64-bit distances allow (131,072 at 64 components) are held at it;
repeated vec_ids give one seed (their least vector) but are all coded; null vec_ids are coded and give no seed; fewer
vectors than entries give a smaller codebook; equal distances go to the lower index; an empty table gives no rows;
other columns do not matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from seamline.llm.skew import fits_broadcast, salted_join
from seamline.llm.texts import bound_batches
from seamline.session import stored, table

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Entries, in order of their norms, that are evaluated together.
TILE = 16
#: Vectors that a task turns into integers at a time.
VECTORS = 4_096
#: Whole numbers that a double holds.
EXACT = 2.0**53


def held_at(length: int) -> int:
    """Greatest component whose squared distances, summed over a vector, stay below 2^62."""
    return math.isqrt((1 << 62) // max(1, length)) // 2


def integers(vectors: pa.Array, parts: int, scale: int) -> np.ndarray:
    """Vectors as vector x part x component; all of one length."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    n = len(vectors)
    length = len(flat) // n if n else 0
    most = held_at(length)
    whole = np.clip(np.floor(flat * scale), -most, most).astype(np.int64).reshape(n, length)
    fill = -length % parts
    return np.pad(whole, ((0, 0), (0, fill))).reshape(n, parts, (length + fill) // parts)


class Codebook:
    """The entries of one part (entry x component), sorted by norm for search."""

    def __init__(self, entries: np.ndarray):
        squares = (entries * entries).sum(axis=1)
        self.order = np.argsort(squares, kind="stable")
        self.entries, self.squares = entries[self.order], squares[self.order]
        self.norms = np.sqrt(self.squares.astype(np.float64))
        self.greatest = int(np.abs(entries).max(initial=0))
        self.seen = 0

    def distances(self, queries: np.ndarray, squares: np.ndarray, a: int, b: int) -> np.ndarray:
        """Exact squared distances to the entries a to b by norm. Doubles are used where they hold all numbers in between."""
        self.seen += len(queries) * (b - a)
        most = max(self.greatest, int(np.abs(queries).max(initial=0)))
        kind = np.float64 if 4.0 * most * most * queries.shape[1] < EXACT else np.int64
        dots = queries.astype(kind) @ self.entries[a:b].T.astype(kind)
        return squares[:, None] + self.squares[a:b] - 2 * dots.astype(np.int64)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of and squared distance to each query's nearest entry, the lowest index of equals."""
        n, squares = len(self.entries), (queries * queries).sum(axis=1)
        norms = np.sqrt(squares.astype(np.float64))
        tiles = -(-n // TILE)
        home = np.minimum(np.searchsorted(self.norms, norms), n - 1) // TILE
        bound = np.empty(len(queries), np.int64)
        for tile in np.unique(home):
            own = np.flatnonzero(home == tile)
            bound[own] = self.distances(queries[own], squares[own], tile * TILE, min(n, (tile + 1) * TILE)).min(axis=1)
        radius = np.sqrt(bound.astype(np.float64))
        slack = 1e-9 * (norms + radius + 1)  # roots are rounded; the interval's ends belong to it
        low = np.searchsorted(self.norms, norms - radius - slack, "left") // TILE
        high = (np.searchsorted(self.norms, norms + radius + slack, "right") - 1) // TILE
        index, least = np.empty(len(queries), np.int64), np.empty(len(queries), np.int64)
        pair = low * tiles + high
        for p in np.unique(pair):
            own = np.flatnonzero(pair == p)
            a, b = int(p // tiles) * TILE, min(n, (int(p % tiles) + 1) * TILE)
            found = self.distances(queries[own], squares[own], a, b)
            least[own] = found.min(axis=1)
            index[own] = np.where(found == least[own][:, None], self.order[a:b], n).min(axis=1)
        return index, least


def usable(vector: Column) -> Column:
    """Whether a vector can be coded: not null, not empty, all components finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(False))


def seeds(df: DataFrame, vector: str, key: str, entries: int) -> list:
    """The vectors of the least ``entries`` keys in their order, each key's least vector.

    Each task sorts out its least keys; only if repeated keys leave too few different ones are all keys compared.
    """
    keys = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"))
    first = [r.k for r in keys.orderBy("k").limit(entries).collect()]
    if len(set(first)) < len(first) == entries:
        first = [r.k for r in keys.distinct().orderBy("k").limit(entries).collect()]
    rows = df.where(F.col(key) <= first[-1]) if first else df.limit(0)
    least = rows.groupBy(F.col(key).alias("k")).agg(F.min(F.col(vector).cast("array<double>")).alias("v"))
    return [r.v for r in least.where(F.col("k").isNotNull()).orderBy("k").collect()]


def same_length(df: DataFrame, vector: str, key: str) -> DataFrame:
    """Rows that can be coded, of the length of the one with the least key (null last)."""
    good = df.where(usable(F.col(vector)))
    first = good.agg(F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("k"), F.size(vector).alias("n"))).alias("first")).first()
    return good.where(F.size(vector) == (first["first"]["n"] if first["first"] else 0))


def books_of(codebooks: np.ndarray) -> list[Codebook]:
    return [Codebook(codebooks[p]) for p in range(len(codebooks))]


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(a, VECTORS) for a in range(0, batch.num_rows, VECTORS))


def sums_by_entry(df: DataFrame, vector: str, codebooks: np.ndarray, scale: int) -> DataFrame:
    """part, entry, place, total, n: of the parts nearest to each entry; one row an entry and component from each task."""
    parts, entries, width = codebooks.shape
    names = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = books_of(codebooks)
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in runs(batches):
            cut = integers(batch.column(0), parts, scale)
            for p, book in enumerate(books):
                index, _ = book.nearest(cut[:, p])
                order = np.argsort(index, kind="stable")
                used, starts = np.unique(index[order], return_index=True)
                sums[p, used] += np.add.reduceat(cut[order, p], starts, axis=0)
                counts[p] += np.bincount(index, minlength=entries)
        part, entry = np.nonzero(counts)
        if len(part):
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], schema=names)

    made = bound_batches(df.select(vector)).mapInArrow(run, "part int, entry int, n long, sums array<long>")
    placed = made.select("part", "entry", "n", F.posexplode("sums").alias("place", "x"))
    return placed.groupBy("part", "entry", "place").agg(F.sum("x").alias("total"), F.sum("n").alias("n"))


def fit_codebooks(df: DataFrame, vector: str, key: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray | None:
    """part x entry x component, after ``rounds`` of assigning all vectors and replacing entries by the floor of their mean.

    ``df``: of ``same_length``. None without any vector with a key.
    """
    first = seeds(df, vector, key, entries)
    if not first:
        return None
    codebooks = integers(pa.array(first, pa.list_(pa.float64())), parts, scale).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        means = sums_by_entry(df, vector, codebooks, scale).collect()  # at most one number an entry and component
        for r in means:
            codebooks[r.part, r.entry, r.place] = r.total // r.n
    return codebooks


def encode(df: DataFrame, vector: str, codebooks: np.ndarray, keep: list[str], scale: int = SCALE) -> DataFrame:
    """``keep`` with code (two hexadecimal digits a part) and error (squared distance, summed over parts)."""
    given = df.select(*keep, F.col(vector).alias("vector_to_code"))
    schema = StructType([*given.schema.fields[:-1], *StructType.fromDDL("code string, error long").fields])
    arrow = to_arrow_schema(schema)
    parts = len(codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = books_of(codebooks)
        for batch in runs(batches):
            *old, vectors = batch.columns
            cut = integers(vectors, parts, scale)
            codes, error = np.zeros((batch.num_rows, parts), np.uint8), np.zeros(batch.num_rows, np.int64)
            for p, book in enumerate(books):
                codes[:, p], least = book.nearest(cut[:, p])
                error += least
            text = codes.tobytes().hex()
            made = [pa.array([text[a : a + 2 * parts] for a in range(0, len(text), 2 * parts)], pa.string()), pa.array(error)]
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(old, arrow, strict=False)), *made], schema=arrow)

    return bound_batches(given).mapInArrow(run, schema)


def decode(codes: DataFrame, code: str, codebooks: np.ndarray) -> DataFrame:
    """``codes`` with decoded: the entries that a code names, one after the other, as integers; null for a null code."""
    schema = StructType([*codes.schema.fields, StructField("decoded", ArrayType(LongType()))])
    arrow, at = to_arrow_schema(schema), codes.columns.index(code)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches):
            made = [c and np.concatenate([book[i] for book, i in zip(codebooks, bytes.fromhex(c), strict=True)]) for c in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns, arrow, strict=False)), pa.array(made, pa.list_(pa.int64()))], schema=arrow)

    return codes.mapInArrow(run, schema)


def fingerprint(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def with_group_sum(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over equal groups, nulls together. Sums are made by task first; hot groups are spread."""
    keyed = df.withColumn("group_key", F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")))
    sums = keyed.groupBy("group_key").agg(F.sum(value).alias(name))
    if fits_broadcast(sums):
        return keyed.join(F.broadcast(sums), "group_key").drop("group_key")
    return salted_join(keyed, sums, "group_key", F.col(value), keyed.count()).drop("group_key")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = same_length(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), "embedding", "vec_id")
    codebooks = fit_codebooks(rows, "embedding", "vec_id")
    if codebooks is None:
        none = StructType([f for f in rows.schema if f.name == "vec_id"] + StructType.fromDDL("code string, error long, label_error long").fields + [StructField("codebooks_sha256", StringType())])
        return spark.createDataFrame([], none)
    coded = stored(encode(rows, "embedding", codebooks, ["vec_id", "label"]), "codes")
    out = with_group_sum(coded, "label", "error", "label_error")
    return out.select("vec_id", "code", "error", "label_error", F.lit(fingerprint(codebooks)).alias("codebooks_sha256"))
