"""Lengths of blocks and choice of positions from scores over a window of tokens. Array expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seamline.functions.arrays import let

WINDOW_RATIO = 0.25
WEIGHT = 0.7


def first_best(scores: Column) -> Column:
    """Struct (score, index) of the first greatest score; null for null and empty arrays. Null scores are not looked at."""

    def of(a: Column) -> Column:
        top = F.array_max(a)
        return F.when(top.isNotNull(), F.struct(top.alias("score"), (F.array_position(a, top) - 1).cast("int").alias("index")))

    return let(scores, of)


def window_size(gen_length: Column, remaining: Column, ratio: float = WINDOW_RATIO) -> Column:
    """Tokens that are looked at: a share of what is generated in all, one at least, at most what remains."""
    return F.greatest(F.least(F.greatest(F.floor(gen_length * ratio), F.lit(1)), remaining), F.lit(0)).cast("int")


def blended(marks: Column, learned: Column, weight: float = WEIGHT) -> Column:
    """weight times the learned scores and the rest times the marks' scores, the weight held within 0 and 1."""
    w = max(0.0, min(1.0, weight))
    return F.zip_with(learned.cast("array<double>"), marks.cast("array<double>"), lambda a, b: a * w + b * (1 - w))


def window_block_length(
    tokens: Column, confidence: Column, delimiters: list[int], gen_length: Column, generated: Column, default: Column,
    threshold: float | None = None, learned: Column | None = None, weight: float = WEIGHT, learned_threshold: float | None = None, ratio: float = WINDOW_RATIO,
) -> Column:
    """Length of the next block from the scores of candidate ends within a window.

    ``tokens`` and ``confidence`` are arrays from the block's start on. A delimiter scores its confidence, other tokens 0.
    With ``learned`` scores the first best of their blend ends the block if it reaches ``learned_threshold`` (``threshold``
    if None). Else, and without them, the first most confident delimiter ends it if it reaches ``threshold``; a window
    without a delimiter, and a threshold of None, give ``default``, at most what remains. Scores missing at the end of
    an array count as none; an empty window gives the default.
    """
    remaining = gen_length - generated
    size = window_size(gen_length, remaining, ratio)
    cut = lambda a: F.slice(a, F.lit(1), size)
    marked = F.zip_with(cut(tokens), cut(confidence).cast("array<double>"), lambda t, c: F.when(t.isin(delimiters), c))
    held = F.least(default, remaining).cast("int")

    def reaches(best: Column, least: float | None, other: Column) -> Column:
        return other if least is None else F.when(best["score"] >= least, best["index"] + 1).otherwise(other)

    def of(marks: Column) -> Column:
        plain = let(first_best(marks), lambda b: reaches(b, threshold, held))
        if learned is None:
            return plain
        least = threshold if learned_threshold is None else learned_threshold
        zeros = F.transform(marks, lambda m: F.coalesce(m, F.lit(0.0)))
        return let(first_best(blended(zeros, cut(learned), weight)), lambda b: reaches(b, least, plain))

    return F.when(size > 0, let(marked, of)).otherwise(held).cast("int")


def transfer_by_position(confidence: Column, masked: Column, thresholds: Column, start: Column | None = None) -> Column:
    """0/1 of positions whose token is taken over: masked ones that reach their threshold, and always the best masked one.

    Thresholds are looked up by absolute position, ``start`` being that of the first confidence (0 by default). A position
    without a threshold is taken only as the best; null confidences never are. Nothing masked, nothing taken.
    """
    begin = F.lit(0) if start is None else start
    rows = F.transform(confidence, lambda c, i: F.when(F.get(masked, i) == 1, c))

    def of(open_: Column) -> Column:
        best = first_best(open_)["index"]
        reached = lambda c, i: F.coalesce(c >= F.get(thresholds, (begin + i).cast("int")), F.lit(False))
        return let(best, lambda b: F.transform(open_, lambda c, i: (reached(c, i) | F.coalesce(i == b, F.lit(False))).cast("int")))

    return let(rows, of)
