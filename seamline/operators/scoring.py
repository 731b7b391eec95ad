"""Scores from a callback: candidates of each document are put to a Python scorer that is set up once a partition.

The scorer sees bounded batches, made one after the other from the documents of a partition, so that neither a
document's candidates nor a partition's are ever held together. Nothing is shuffled: a document keeps its row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from seamline.operators.oracle_rows import DELTAS

BATCH = 256
SCORES = "scores_ array<struct<index:int,name:string,score:double>>"


class ScorerError(ValueError):
    """A scorer failed, or gave other than one finite number a candidate; names the document and the candidate."""


class Candidate:
    """What is scored: the document (a dict of its columns), the index of a block end, the name of the change, and the sizes it gives."""

    __slots__ = ("doc", "index", "name", "sizes")

    def __init__(self, doc: dict, index: int, name: str, sizes: list[int]):
        self.doc, self.index, self.name, self.sizes = doc, index, name, sizes


Scorer = Callable[[list[Candidate]], Iterable[float]]


def changed(sizes: list[int], index: int, delta: int) -> list[int]:
    """Sizes of 1 at least, that of ``index`` changed."""
    if not 0 <= index < len(sizes):
        raise IndexError(f"there is no block {index} of {len(sizes)}")
    out = [max(1, int(s)) for s in sizes]
    out[index] = max(1, out[index] + int(delta))
    return out


def by_delta(deltas: tuple[int, ...] = DELTAS) -> Callable[[dict, list[int]], Iterator[Candidate]]:
    """Every block end moved by every delta."""
    return lambda doc, sizes: (Candidate(doc, i, str(d), changed(sizes, i, d)) for i in range(len(sizes)) for d in deltas)


def by_carry() -> Callable[[dict, list[int]], Iterator[Candidate]]:
    """Every block end with its state carried on and not."""
    return lambda doc, sizes: (Candidate(doc, i, way, changed(sizes, i, 0)) for i in range(len(sizes)) for way in ("carry_on", "carry_off"))


def numbers(scorer: Scorer, batch: list[Candidate], key: str) -> list[float]:
    """One finite number a candidate, or ``ScorerError``."""
    where = f"from document {batch[0].doc.get(key)!r}, block {batch[0].index}, {batch[0].name}"
    try:
        found = [float(x) for x in scorer(batch)]
    except Exception as e:
        raise ScorerError(f"the scorer failed on {len(batch)} candidates {where}: {type(e).__name__}: {e}") from e
    if len(found) != len(batch):
        raise ScorerError(f"the scorer gave {len(found)} numbers for {len(batch)} candidates {where}")
    for c, x in zip(batch, found, strict=True):
        if not math.isfinite(x):
            raise ScorerError(f"the scorer gave {x} for document {c.doc.get(key)!r}, block {c.index}, {c.name}")
    return found


def scored(
    docs: DataFrame, make: Callable[[], Scorer], candidates: Callable[[dict, list[int]], Iterator[Candidate]], sizes: str = "oracle_block_sizes",
    key: str = "sample_id", batch: int = BATCH, on_error: str = "raise",
) -> DataFrame:
    """``docs`` with scores_ (structs index, name, score, in order of candidates) and error_ (null, or why a document has none).

    ``make`` sets a scorer up, once a partition and only where there are candidates; batches hold ``batch`` candidates at
    most. ``on_error``: "raise" ends the job with ``ScorerError``; "keep" leaves the scores of the documents in the
    failing batch empty and says why, the others keep theirs. Null sizes, and documents without blocks, have no scores.
    """
    if on_error not in ("raise", "keep") or batch < 1:
        raise ValueError(f"batches of {batch}, errors to {on_error}: neither is known")
    schema = StructType([*docs.schema.fields, *StructType.fromDDL(SCORES + ", error_ string").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for rows in batches:
            records = rows.to_pylist()
            scores: list[list[dict]] = [[] for _ in records]
            errors: list[str | None] = [None] * len(records)
            stream = ((k, c) for k, doc in enumerate(records) for c in candidates(doc, doc[sizes] or []))
            while part := list(islice(stream, batch)):
                scorer = scorer or make()
                try:
                    found = numbers(scorer, [c for _, c in part], key)
                except ScorerError as e:
                    if on_error == "raise":
                        raise
                    for k, _ in part:
                        errors[k] = str(e)
                    continue
                for (k, c), x in zip(part, found, strict=True):
                    scores[k].append({"index": c.index, "name": c.name, "score": x})
            scores = [[] if e else s for s, e in zip(scores, errors, strict=True)]
            columns = [c.cast(f.type) for c, f in zip(rows.columns, arrow, strict=False)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, arrow.field("scores_").type), pa.array(errors, pa.string())], schema=arrow)

    return docs.mapInArrow(run, schema)


def maps_of(value: Callable[[Column], Column], scores: str = "scores_") -> Column:
    """Map of index to ``value`` of the index's structs (name, score)."""
    indices = F.array_distinct(F.transform(scores, lambda s: s["index"]))
    own = lambda i: F.filter(scores, lambda s: s["index"] == i)
    return F.map_from_entries(F.transform(indices, lambda i: F.struct(i.alias("key"), value(own(i)).alias("value"))))


def delta_scores(scores: str = "scores_") -> Column:
    """``scores`` as ``correction_rows`` reads them: map of index to map of delta to score."""
    return maps_of(lambda own: F.map_from_entries(F.transform(own, lambda s: F.struct(s["name"].cast("int").alias("key"), s["score"].alias("value")))), scores)


def carry_scores(scores: str = "scores_") -> Column:
    """``scores`` as ``gate_rows`` reads them: map of index to struct (carry_on, carry_off)."""
    one = lambda own, name: F.get(F.transform(F.filter(own, lambda s: s["name"] == name), lambda s: s["score"]), F.lit(0))
    return maps_of(lambda own: F.struct(one(own, "carry_on").alias("carry_on"), one(own, "carry_off").alias("carry_off")), scores)
