"""Losses and decisions over exploded logits and scores: aggregates of plain columns, no tensors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-6


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def masked_mean(loss: Column, mask: Column) -> Column:
    """Aggregate: the sum of masked losses by the masked count, 1 at least."""
    return F.sum(loss * mask) / F.greatest(F.sum(mask), F.lit(1.0))


def cross_entropy(logit: Column, label: Column, mask: Column, positive: float = 1.0) -> Column:
    """Aggregate: masked binary cross-entropy with a weight of positives, in the form that does not overflow."""
    soft = F.log1p(F.exp(-F.abs(logit)))
    loss = positive * label * (soft + F.greatest(-logit, F.lit(0.0))) + (1 - label) * (soft + F.greatest(logit, F.lit(0.0)))
    return masked_mean(loss, mask)


def focal(logit: Column, label: Column, mask: Column, easy_positive: float = 1.0, easy_negative: float = 4.0, positive: float = 1.0) -> Column:
    """Aggregate: masked focal loss with different exponents for positives and negatives."""
    p = F.greatest(F.lit(TINY), F.least(F.lit(1 - TINY), sigmoid(logit)))
    q = F.greatest(F.lit(TINY), F.least(F.lit(1 - TINY), 1 - sigmoid(logit)))
    loss = -label * positive * F.pow(1 - p, F.lit(easy_positive)) * F.log(p) - (1 - label) * F.pow(1 - q, F.lit(easy_negative)) * F.log(q)
    return masked_mean(loss, mask)


def class_entropy(logits: Column, label: Column, mask: Column) -> Column:
    """Aggregate: masked cross-entropy of an array of logits to a class index."""
    top = F.array_max(logits)
    total = F.aggregate(F.transform(logits, lambda z: F.exp(z - top)), F.lit(0.0), lambda s, x: s + x)
    return masked_mean(top + F.log(total) - F.get(logits, label), mask)


def phase_threshold(base: Column, phase: Column, offsets: dict[str, float], entropy: Column, gate: float) -> Column:
    """A threshold with the phase's offset where the phase is sure (entropy within the gate), held between 0 and 1."""
    known = F.create_map(*[F.lit(x) for p in offsets.items() for x in p])
    offset = F.when(entropy <= gate, F.coalesce(F.try_element_at(known, phase), F.lit(0.0))).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + offset))


def one_hot(labels: Column, mask: Column, classes: int) -> Column:
    """For every label an array of 0 and 1 by class; zeros where masked out."""
    return F.zip_with(labels, mask, lambda v, m: F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: ((k == v) & (m == 1)).cast("double")))


def sure_phases(entropies: Column, classes: int, gate: float) -> Column:
    """Whether entropy, as a share of the greatest possible, is within the gate."""
    return F.transform(entropies, lambda e: e / F.log(F.lit(float(classes))) <= gate)


def before_phase_change(phases: Column, masked: Column) -> Column:
    """How many positions from the first masked one on have its phase without a break; 0 without a masked one."""
    start = F.array_position(masked, 1) - 1
    tail = F.slice(phases, start.cast("int") + 1, F.size(phases))
    other = F.array_position(F.transform(tail, lambda p: (p != F.get(tail, 0)).cast("int")), 1)
    return F.when(start < 0, 0).when(other > 0, other - 1).otherwise(F.size(tail)).cast("int")


def uniform(key: Column, seed: int) -> Column:
    """A reproducible number from 0 to below 1 for a key."""
    return F.conv(F.substr(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"))), F.lit(1), F.lit(12)), 16, 10).cast("double") / float(16**12)


def dropped_span(ids: Column, first: Column, last: Column, pad: int, chosen: Column) -> Column:
    """Ids with the span first:last blanked in chosen rows; a negative ``first`` means no span."""
    return F.transform(ids, lambda x, i: F.when(chosen & (first >= 0) & (i >= first) & (i < last), F.lit(pad)).otherwise(x))


def noised(ids: Column, visible: Column, mask_id: int, key: Column, seed: int, most: float) -> Column:
    """Ids with a random share of the visible ones masked, by hash; the first visible one stays if all would go."""
    share = uniform(key, seed) * most
    hit = F.transform(visible, lambda v, i: (v == 1) & (uniform(F.concat_ws(":", key.cast("string"), i.cast("string")), seed + 1) < share))
    left = F.exists(F.zip_with(visible, hit, lambda v, h: (v == 1) & ~h), lambda x: x)
    first = F.array_position(visible, 1) - 1
    keep = F.transform(hit, lambda h, i: h & (left | (i != first)))
    return F.zip_with(ids, keep, lambda x, h: F.when(h, F.lit(mask_id)).otherwise(x))
