"""Array expressions: running sums, offsets, masks, spans and argmax with ties."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def total(a: Column, zero: Column | None = None) -> Column:
    return F.aggregate(a, F.lit(0).cast("long") if zero is None else zero, lambda s, x: s + x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once. A lambda computes its outer expressions for every element."""
    return F.transform(F.array(value), body)[0]


def running_sums(a: Column, kind: str = "bigint") -> Column:
    """Inclusive running sums of an array of numbers; blockwise, so that long arrays stay near linear."""
    zero = F.lit(0).cast(kind)

    def sums(x: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.ceil(F.size(x) / BLOCK).cast("int") - 1)
        parts = F.transform(blocks, lambda b: F.slice(x, b * BLOCK + 1, F.lit(BLOCK)))
        return let(parts, with_starts)

    def with_starts(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: total(p, zero))
        starts = F.aggregate(totals, F.array(zero), lambda s, v: F.concat(s, F.array(F.element_at(s, -1) + v)))
        return let(starts, lambda st: F.flatten(F.transform(parts, lambda p, b: F.transform(p, lambda _, i: F.get(st, b) + total(F.slice(p, F.lit(1), i + 1), zero)))))

    return let(a.cast(f"array<{kind}>"), lambda x: F.when(F.size(x) > 0, sums(x)).otherwise(empty(kind)))


def offsets_of_lengths(lengths: Column) -> Column:
    """Where each block starts: the sum of the lengths before it, negatives counting 0."""
    held = F.transform(lengths, lambda n: F.greatest(n, F.lit(0)))
    return let(held, lambda h: F.zip_with(running_sums(h), h, lambda s, n: s - n))


def positions_to_labels(length: Column, positions: Column) -> Column:
    """0/1 labels of the given length; positions outside are ignored, a null array has no position."""
    at = F.coalesce(positions, empty("int"))
    labels = F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.array_contains(at, i.cast("int")).cast("int"))
    return F.when(length > 0, labels).otherwise(empty("int"))


def segment_labels(lengths: Column, separator: Column, terminal: bool = True) -> Column:
    """Labels over the tokens of segments: 1 on the last token of each, 0 on separators between them.

    ``lengths``: tokens of each segment; ``separator``: tokens put between two. Without ``terminal``, the
    last segment ends with 0.
    """
    n = F.size(lengths)

    def one(length: Column, i: Column) -> Column:
        ends = F.lit(True) if terminal else i < n - 1
        inner = F.array_repeat(F.lit(0), F.greatest(length - 1, F.lit(0)).cast("int"))
        last = F.array_repeat(F.when(ends, 1).otherwise(0), F.least(length, F.lit(1)).cast("int"))
        between = F.array_repeat(F.lit(0), F.when(i < n - 1, separator).otherwise(0).cast("int"))
        return F.concat(inner, last, between)

    return F.when(n > 0, F.flatten(F.transform(lengths, one))).otherwise(empty("int"))


def transitions(labels: Column, mask: Column) -> Column:
    """Structs (target, mask): whether a label differs from the next one; the last pair is masked."""
    n = F.size(labels)
    return F.transform(
        labels,
        lambda x, i: F.struct(
            (x != F.coalesce(F.get(labels, i + 1), x)).cast("int").alias("target"),
            F.when(i < n - 1, F.get(mask, i) * F.get(mask, i + 1)).otherwise(0).alias("mask"),
        ),
    )


def masked(values: Column, mask: Column) -> Column:
    """The values whose mask is set."""
    pairs = F.arrays_zip(values.alias("v"), mask.alias("m"))
    return F.transform(F.filter(pairs, lambda p: p["m"] == 1), lambda p: p["v"])


def padded(a: Column, size: Column, pad: Column) -> Column:
    return F.concat(a, F.array_repeat(pad, F.greatest(size - F.size(a), F.lit(0)).cast("int")))


def set_at(a: Column, index: Column, value: Column) -> Column:
    return F.transform(a, lambda x, i: F.when(i == index, value).otherwise(x))


def add_at(a: Column, index: Column, delta: Column) -> Column:
    """One element changed, never below 1."""
    return F.transform(a, lambda x, i: F.when(i == index, F.greatest(x + delta, F.lit(1))).otherwise(x))


def add_map(a: Column, deltas: Column) -> Column:
    """Elements changed by a map of index to delta, never below 1; indices outside are ignored."""
    return F.transform(a, lambda x, i: F.greatest(F.lit(1), x + F.coalesce(F.try_element_at(deltas, i), F.lit(0))))


def best_delta(scores: Column) -> Column:
    """Key of a map's greatest value; ties to the least absolute key, then the least key."""
    ranked = F.transform(
        F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("loss"), F.abs(e["key"]).alias("size"), e["key"].alias("key"))
    )
    return F.array_min(ranked)["key"]


def adjacent_merge(lengths: Column) -> Column:
    """Index of the adjacent pair whose joint length is least; ties to the first."""
    pairs = F.transform(
        F.sequence(F.lit(0), F.size(lengths) - 2),
        lambda i: F.struct((F.get(lengths, i) + F.get(lengths, i + 1)).alias("n"), i.alias("i")),
    )
    return F.when(F.size(lengths) > 1, F.array_min(pairs)["i"])


def scheduled_length(scores: Column, default: Column, threshold: Column) -> Column:
    """Struct (length, index, score): first greatest score within the first ``default`` ones, if it reaches the threshold."""
    window = F.slice(scores, F.lit(1), F.greatest(default, F.lit(1)).cast("int"))
    top = F.array_max(window)
    index = F.array_position(window, top) - 1
    hit = top >= threshold
    return F.when(F.size(window) > 0, F.struct(
        F.when(hit, index + 1).otherwise(default).cast("int").alias("length"),
        F.when(hit, index).cast("int").alias("index"),
        top.cast("double").alias("score"),
    )).otherwise(F.struct(default.cast("int").alias("length"), F.lit(None).cast("int").alias("index"), F.lit(None).cast("double").alias("score")))


def window_length(scores: Column, default: Column, threshold: Column) -> Column:
    """First greatest score of the whole window if it reaches the threshold, capped at ``default``."""
    top = F.array_max(scores)
    return F.when((F.size(scores) > 0) & (top >= threshold), F.least(F.array_position(scores, top), default)).otherwise(default).cast("int")


def candidate_length(scores: Column, lengths: Column, default: Column, threshold: Column) -> Column:
    """Length of the best candidate that reaches the threshold, the first of equals; else ``default``."""
    pairs = F.filter(F.arrays_zip(scores.alias("score"), lengths.alias("length")), lambda p: p["score"] >= threshold)
    top = F.array_max(F.transform(pairs, lambda p: p["score"]))
    return F.coalesce(F.get(F.filter(pairs, lambda p: p["score"] == top), F.lit(0))["length"], default)


def delta_candidates(previous: Column, deltas: Column, remaining: Column) -> Column:
    """Distinct lengths previous + delta, held within 1 and what remains, ascending."""
    return F.array_sort(F.array_distinct(F.transform(deltas, lambda d: F.greatest(F.lit(1), F.least(previous + d, remaining)))))


def budget_lengths(lengths: Column, most: Column) -> Column:
    """Lengths cut off at a total of ``most``; empty ones go."""
    cut = F.zip_with(lengths, running_sums(lengths), lambda n, s: F.least(n, F.greatest(most - (s - n), F.lit(0))))
    return F.filter(cut, lambda n: n > 0)


def generation_budget(lengths: Column, default: Column) -> Column:
    """Sum of the positive lengths, at most ``default``; ``default`` if there are none."""
    some = F.filter(lengths, lambda n: n > 0)
    return F.when(F.coalesce(F.size(some), F.lit(0)) > 0, F.least(total(some), default.cast("long"))).otherwise(default.cast("long"))


def neighbours(count: Column, index: Column, radius: int) -> Column:
    """Indices from index - radius to index + radius that exist."""
    return F.filter(F.sequence(index - radius, index + radius), lambda i: (i >= 0) & (i < count))


def even_parts(amount: Column, steps: Column) -> Column:
    """``amount`` dealt over ``steps``, the remainder one each to the first."""
    return F.transform(F.sequence(F.lit(0), steps - 1), lambda i: F.floor(amount / steps) + (i < amount % steps).cast("long"))


def entropy(p: Column) -> Column:
    """Shannon entropy in nats, probabilities held at 1e-8 or more."""
    def term(s: Column, x: Column) -> Column:
        q = F.greatest(x.cast("double"), F.lit(1e-8))
        return s - q * F.log(q)

    return F.aggregate(p, F.lit(0.0), term)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two numeric arrays; null where a norm is 0."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def window_mean(a: Column, start: Column, end: Column) -> Column:
    """Mean of a[start:end] held within the array; of the nearest element where that is empty."""
    n = F.size(a)
    lo = F.greatest(F.least(start, n), F.lit(0))
    hi = F.greatest(F.least(end, n), F.lit(0))
    near = F.get(a, F.least(F.greatest(start, F.lit(0)), n - 1))
    part = F.slice(a, lo + 1, F.greatest(hi - lo, F.lit(0)))
    mean = F.aggregate(part, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(part)
    return F.when(n == 0, F.lit(None).cast("double")).when(hi > lo, mean).otherwise(near.cast("double"))
