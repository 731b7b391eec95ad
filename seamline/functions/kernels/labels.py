"""Token labels of serialised code: phases, boundaries, and the masks that say which labels count.

Tokens come as the offsets of their first characters (code points), so that any tokenizer serves. A place
in the text belongs to the tokens that begin before it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seamline.functions.kernels.code import is_text, parsed
from seamline.functions.kernels.completions import signature
from seamline.functions.kernels.phases import FUNCTIONS, PHASES, Source, label

#: The id of a boundary, and the fields of nested solutions that are looked into.
BOUNDARY = 1
SOLUTION_KEYS = ("python", "python3", "py", "solutions", "accepted")

LABELS = ("phase_labels", "boundary_labels", "typed_transition_labels", "boundary_type_labels", "phase_loss_mask", "transition_loss_mask", "boundary_loss_mask")
FIELDS = ", ".join(f"{name} array<int>" for name in LABELS) + ", condition_token_count int"
PARTS = "signature string, body string, function string, body_start int"


def token_labels(starts: list[int], code: str, code_start: int, whole: str | None = None, offset: int = 0, most: int = 4096) -> tuple:
    """The fields of ``FIELDS`` for a text whose ``code`` begins at ``code_start``.

    Phases are those of ``whole`` (the code itself by default), in which the code begins at ``offset``. A
    token that gets two phases gets none. Beyond ``most`` tokens all is cut, and the last one that is left
    ends nothing.
    """
    at = np.asarray(starts, np.int64)
    phase, edge, typed, kind, phase_counts, typed_counts = np.zeros((6, len(at)), np.int32)
    condition = int(np.searchsorted(at, code_start))
    counts = (np.arange(len(at)) >= condition).astype(np.int32)
    spans, edges = label(code if whole is None else whole)
    shift, stop = code_start - offset, offset + len(code)
    for name, start, end, confidence in spans:
        start, end = max(start, offset), min(end, stop)
        if confidence == "ignore" or start >= end:
            continue
        first, last = np.searchsorted(at, (start + shift, end + shift))
        held = slice(first, max(last, first + 1))
        number = PHASES.index(name)
        clash = (phase_counts[held] == 1) & (phase[held] != number)
        phase[held], phase_counts[held] = np.where(clash, 0, number), ~clash
    ends = np.array([p for p, *_ in edges if offset <= p < stop], np.int64)
    tokens = np.searchsorted(at, ends + shift + 1) - 1
    tokens = tokens[tokens >= 0]
    for array in (edge, counts, typed_counts):
        array[tokens] = 1
    typed[tokens] = kind[tokens] = BOUNDARY
    out = [a[:most] for a in (phase, edge, typed, kind, phase_counts, typed_counts, counts)]
    if len(at) > most > 0:
        for array in out[1:4]:
            array[-1] = 0
    return (*out, min(condition, most))


def with_labels(df: DataFrame, starts: str, code: str, code_start: str, whole: str, offset: str, most: int = 4096) -> DataFrame:
    """``df`` with ``FIELDS``, in place of the named columns ``starts``, ``code_start``, ``whole`` and ``offset``.

    A null ``whole`` is the code itself; other nulls are empty or 0. Batches pass as they are, so that rows
    made by other Python functions need no second plan.
    """
    gone = {starts, code_start, whole, offset}
    kept = [f for f in df.schema.fields if f.name not in gone]
    added = StructType.fromDDL(FIELDS).fields

    def run(batches):
        for batch in batches:
            told = [batch.column(c).to_pylist() for c in (starts, code, code_start, whole, offset)]
            made = [token_labels(s or [], c or "", b or 0, w, o or 0, most) for s, c, b, w, o in zip(*told, strict=True)]
            columns = [batch.column(f.name) for f in kept]
            for k, field in enumerate(added):
                kind = pa.int32() if k == len(LABELS) else pa.list_(pa.int32())
                columns.append(pa.array([row[k] for row in made], kind))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in (*kept, *added)])

    return df.mapInArrow(run, StructType([*kept, *added]))


def function_parts(source: str) -> tuple[str, str, str, int] | None:
    """Signature, body without docstring, text, and the body's place in that text, of the longest function.

    The longest by characters, the later of equals; None without a function or a body.
    """
    tree = parsed(source)
    found = [n for n in tree.body if isinstance(n, FUNCTIONS)] if tree else []
    if not found:
        return None
    text = Source(source)
    node = max(found, key=lambda n: (text.span(n)[1] - text.span(n)[0], n.lineno))
    body = node.body[1:] if is_text(node.body[0]) else node.body
    if not body:
        return None
    start, end = text.span(node)
    begin = max(text.offset(body[0].lineno, 0), start)
    inner = source[begin:end].rstrip()
    return (signature(node), inner, source[start:end].rstrip(), begin - start) if inner.strip() else None


def parts(code: Column) -> Column:
    """Struct of ``PARTS``; null fields where there is no function."""

    @F.pandas_udf(PARTS)
    def run(codes: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([function_parts(c or "") or (None, None, None, None) for c in codes], columns=["signature", "body", "function", "body_start"])

    return run(code)


def solutions(value) -> Iterator[str]:
    """Codes of a nested value, outermost first: texts, and the field code of records."""
    waiting = [value]
    while waiting:
        v = waiting.pop()
        if isinstance(v, str):
            yield v
        elif isinstance(v, list):
            waiting += reversed(v)
        elif isinstance(v, dict):
            if isinstance(v.get("code"), str):
                yield v["code"]
            waiting += [v[k] for k in reversed(SOLUTION_KEYS) if v.get(k) is not None]


def nested_solutions(payload: Column) -> Column:
    """Codes of a JSON text, of any depth; text that is no JSON is one code itself, null has none."""

    def of(text: str | None) -> list[str]:
        if text is None:
            return []
        try:
            return list(solutions(json.loads(text)))
        except ValueError:
            return [text]

    @F.pandas_udf("array<string>")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([of(v) for v in values], dtype=object)

    return run(payload)
