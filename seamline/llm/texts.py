"""Row-wise text functions over Arrow batches: keys pass through, memory stays within a few rows."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that are turned to Python values and back at a time.
ROWS_AT_A_TIME = 128


#: Rows of an Arrow batch. Spark's default holds ten times as many; batches of long texts are then what
#: fills an executor's memory outside the heap.
ROWS_PER_BATCH = 1_000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Distinct words whose hashes a worker remembers.
KNOWN_WORDS = 100_000
_held: dict = {}


def bound_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches are small enough for texts; a smaller setting is left.

    The setting stays: it is read when a plan runs, which may be long after this. It bounds memory and changes no result.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH_SETTING)) <= ROWS_PER_BATCH:
        conf.set(BATCH_SETTING, str(ROWS_PER_BATCH))
    return df


def worker_memory(key: tuple, build: Callable[[], object]) -> object:
    """What ``build`` made, kept by this worker process from task to task until another key is asked for."""
    if key not in _held:
        _held.clear()
        _held[key] = build()
    return _held[key]


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def word_hashes() -> WordHashes:
    gc.enable()  # another kernel may have stopped it in this worker
    return worker_memory(("words",), WordHashes)


def as_bytes(column: pa.Array) -> pa.Array:
    """A string column as its UTF-8 bytes."""
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    return column.cast(pa.large_binary() if large else pa.binary())


def map_texts(
    df: DataFrame, text: str, fields: StructType | str, make: Callable[[], Callable[[bytes | None], tuple | None]], keep: list[str] | None = None
) -> DataFrame:
    """``keep`` (all columns by default) and ``fields``, which a function of the text's bytes gives.

    ``make`` is called once a task and returns that function; where it returns None, the row goes.
    Columns of ``keep`` that have the name of a field are replaced by it.
    """
    fields = StructType.fromDDL(fields) if isinstance(fields, str) else fields
    named = {f.name.lower() for f in fields}
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in named]
    kept = df.select(*keep)
    schema = StructType([*kept.schema.fields, *fields.fields])
    arrow = to_arrow_schema(schema)
    column = "text_of_row"
    while column in keep:
        column += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_A_TIME):
                part = batch.slice(at, ROWS_AT_A_TIME)
                made = [of(t) for t in as_bytes(part.column(part.num_columns - 1)).to_pylist()]
                stay = [m is not None for m in made]
                if not all(stay):
                    part, made = part.filter(pa.array(stay)), [m for m in made if m is not None]
                if made:
                    new = [pa.array(c, arrow.field(len(keep) + k).type) for k, c in enumerate(zip(*made, strict=True))]
                    old = [part.column(k).cast(arrow.field(k).type) for k in range(len(keep))]
                    yield pa.RecordBatch.from_arrays(old + new, schema=arrow)

    return bound_batches(df).select(*keep, df[text].alias(column)).mapInArrow(run, schema)
