"""Token counts: batch encoding over Arrow batches that returns lengths only.

Texts are cut at safe boundaries, places where no token of the vocabulary can reach across: its count for a text is
then the sum over the pieces. Pieces that a worker does not remember are encoded in batches of about equal bytes,
equal pieces once; a text of any length is worked off in slices, so that memory does not grow with it. Only a piece
without any safe boundary (letters without a blank) is encoded whole. Nothing is shuffled.

Boundaries by ``cut``: "blanks", for vocabularies that drop white space, at ASCII white space (no composition, token or
special string holds it); "spaces", for byte-level ones, in front of a single space between visible ASCII characters,
which opens a token of its own. Long pieces are also cut in front of ASCII digits where digits stand alone ("blanks").

Defined cases: a null or empty text has 0 bytes and no tokens; a special string within a text counts as the library
counts it; repeated rows are counted each; an empty table gives no rows; columns that have the name of a result are
replaced by it.
"""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from seamline.llm.texts import ROWS_AT_A_TIME, as_bytes, bound_batches, worker_memory
from seamline.session import texts

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Bytes of a text that are in work at a time, and of an encoded batch.
SLICE = 1 << 20
BATCH = 1 << 18
#: Pieces from this length on are cut further where that is safe, and are not remembered.
LONG_PIECE = 1 << 14
#: Pieces whose counts a worker remembers.
KNOWN_PIECES = 600_000

ENDS = {"blanks": re.compile(rb"[\t-\r ]"), "spaces": re.compile(rb"(?<=[!-~])(?= [!-~])")}
#: A digit is a token's whole text under "blanks"; none is in a special string, and none takes part in a composition.
BEFORE_DIGIT = re.compile(rb"(?=[0-9])")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(text: bytes, end: re.Pattern[bytes]) -> Iterator[bytes]:
    """``text`` in parts of about SLICE bytes that end at boundaries."""
    at = 0
    while len(text) - at > SLICE:
        found = end.search(text, at + SLICE)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def cut_long(piece: bytes) -> list[bytes]:
    """A long piece cut in front of digits, parts of LONG_PIECE bytes or more joined; whole if it has none."""
    out, at = [], 0
    while len(piece) - at > LONG_PIECE and (found := BEFORE_DIGIT.search(piece, at + LONG_PIECE)):
        out.append(piece[at : found.start()])
        at = found.start()
    return [*out, piece[at:]]


def pieces(part: bytes, cut: str) -> list[bytes]:
    if cut == "spaces":
        return ENDS[cut].split(part)
    words = part.split()
    if any(len(w) > LONG_PIECE for w in words):
        words = [p for w in words for p in (cut_long(w) if len(w) > LONG_PIECE else (w,))]
    return words


def balanced(unknown: list[bytes]) -> Iterator[list[bytes]]:
    """Batches of about BATCH bytes; a longer piece is a batch of its own."""
    batch, size = [], 0
    for piece in unknown:
        if batch and size + len(piece) > BATCH:
            yield batch
            batch, size = [], 0
        batch.append(piece)
        size += len(piece)
    if batch:
        yield batch


class Counter:
    """Counts tokens of texts with one vocabulary; pieces seen before are remembered up to a bound."""

    def __init__(self, path: str, cut: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.cut, self.known = cut, {}
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def learn(self, unknown: list[bytes]) -> None:
        for batch in balanced(unknown):
            made = self.tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in batch], add_special_tokens=False)
            self.known.update(zip(batch, map(len, made), strict=True))

    def __call__(self, texts: list[bytes | None]) -> list[int]:
        """Tokens of each text. Texts are worked off in shares of about SLICE bytes: short ones together, long ones in parts."""
        totals = [0] * len(texts)
        for share in shares(texts, ENDS[self.cut]):
            found = [pieces(part, self.cut) for _, part in share]
            unknown = set().union(*found).difference(self.known)
            if len(self.known) + len(unknown) > KNOWN_PIECES:
                self.known.clear()
                unknown = set().union(*found)
            self.learn(list(unknown))
            for (row, _), own in zip(share, found, strict=True):
                totals[row] += sum(map(self.known.__getitem__, own))
            for piece in unknown:
                if len(piece) > LONG_PIECE:
                    del self.known[piece]
        return totals


def shares(texts: list[bytes | None], end: re.Pattern[bytes]) -> Iterator[list[tuple[int, bytes]]]:
    """(row, part) of texts in order, about SLICE bytes at a time."""
    held, size = [], 0
    for row, text in enumerate(texts):
        for part in slices(text or b"", end):
            held.append((row, part))
            size += len(part)
            if size >= SLICE:
                yield held
                held, size = [], 0
    if held:
        yield held


def count_tokens(df: DataFrame, text: str, path: str, cut: str = "blanks", keep: list[str] | None = None, limit: int = LIMIT) -> DataFrame:
    """``keep`` (all columns by default) with n_bytes, n_tokens and over_limit, whether a text has more than ``limit`` tokens.

    ``path``: of a tokenizers file (.json). ``keep`` may name ``text`` itself.
    """
    if cut not in ENDS:
        raise ValueError(f"no boundaries are known for {cut}")
    named = {"n_bytes", "n_tokens", "over_limit"}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in named]
    size = F.octet_length(F.coalesce(df[text], F.lit(""))).cast("long").alias("n_bytes")
    given = df.select(*kept, size, df[text].alias("text_to_count"))
    schema = StructType([*given.schema.fields[:-1], StructField("n_tokens", LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.enable()  # another kernel may have stopped it in this worker
        count = worker_memory(("tokens", path, cut), lambda: Counter(path, cut))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_A_TIME):
                part = batch.slice(at, ROWS_AT_A_TIME)
                *old, texts = part.columns
                made = pa.array(count(as_bytes(texts).to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(old, arrow, strict=False)), made], schema=arrow)

    counted = bound_batches(given).mapInArrow(run, schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(texts(spark, sf_dir), "text", vocabulary_path(), keep=["doc_id"])
