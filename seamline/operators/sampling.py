"""Deterministic splits, samples, allocations and mixtures."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamline.operators.ordering import cap_per_group, with_ordinal


def md5_mod(key: Column, modulus: int = 1000) -> Column:
    """The 128-bit MD5 of ``key`` modulo ``modulus``, word by word."""
    digest = F.md5(key.cast("string"))

    def step(rest: Column, word: Column) -> Column:
        value = F.conv(F.substr(digest, word * 8 + 1, F.lit(8)), 16, 10).cast("long")
        return (rest * F.lit(2**32 % modulus) + value) % modulus

    return F.aggregate(F.sequence(F.lit(0), F.lit(3)), F.lit(0).cast("long"), step)


def stable_split(key: Column, train_cutoff: int = 980) -> Column:
    """"train" for keys whose digest modulo 1000 is below the cutoff, else "valid"."""
    return F.when(md5_mod(key) < train_cutoff, "train").otherwise("valid")


def record_digest(df: DataFrame, columns: list[str] | None = None) -> Column:
    """MD5 of a row as JSON with sorted keys; nulls stay in it."""
    return F.md5(F.to_json(F.struct(*sorted(columns or df.columns)), {"ignoreNullFields": "false"}))


def bottom_k(df: DataFrame, digest: Column, tie: str, count: int, group: list[str] | None = None) -> DataFrame:
    """The ``count`` rows with the least digests, in all or in each group, with their rank."""
    marked = df.withColumn("digest", digest)
    if group:
        return cap_per_group(marked, group, ["digest", tie], count)
    picked = marked.orderBy("digest", tie).limit(count)
    return with_ordinal(picked, ["digest", tie], "rank").withColumn("rank", F.col("rank") + 1)


def largest_remainder(total: int, weights: list[int | float]) -> list[int]:
    """Whole shares of ``total`` by weight; what is left goes to the largest remainders, ties to the first."""
    exact = [Fraction(w) * total / sum(map(Fraction, weights)) if sum(weights) else Fraction(0) for w in weights]
    shares = [int(e) for e in exact]
    order = sorted(range(len(weights)), key=lambda i: (shares[i] - exact[i], i))
    for i in order[: (total - sum(shares)) if sum(weights) else 0]:
        shares[i] += 1
    return shares


def allocate(groups: DataFrame, weight: str, total: int, order: str) -> DataFrame:
    """``groups`` with ``share``: ``total`` dealt by largest remainder, ties to the first in ``order``.

    One row a group; the group table is small by nature.
    """
    everything = Window.partitionBy()
    exact = F.col(weight) * total
    whole = F.floor(exact / F.sum(weight).over(everything))
    g = groups.withColumn("whole", whole).withColumn("rest", exact - F.col("whole") * F.sum(weight).over(everything))
    rank = F.row_number().over(Window.orderBy(F.desc("rest"), order))
    left = F.lit(total) - F.sum("whole").over(everything)
    g = g.withColumn("rank", rank).withColumn("left", left)
    return g.withColumn("share", F.col("whole") + (F.col("rank") <= F.col("left")).cast("long")).drop("whole", "rest", "rank", "left")


def equidistant(total: int, take: int) -> list[int]:
    """``take`` spread ordinals of ``total``, rounded half to even. They are distinct, being over 1 apart."""
    if take <= 0 or total <= 0:
        return []
    if take >= total:
        return list(range(total))
    return [0] if take == 1 else [round(i * (total - 1) / (take - 1)) for i in range(take)]


def equidistant_rows(df: DataFrame, order: list[str], take: int) -> DataFrame:
    """``take`` rows evenly spread in ``order``, with their ordinal; ``take`` = 0 means all."""
    numbered = with_ordinal(df, order)
    total = df.count()
    if take <= 0 or take >= total:
        return numbered
    if take == 1:
        return numbered.where("ordinal = 0")
    # the only place whose ordinal could be a row's is known from the row; no list of ordinals is made
    place = F.round(F.col("ordinal") * (take - 1) / (total - 1))
    return numbered.where(F.col("ordinal") == F.bround(place * (total - 1) / (take - 1)))


def seeded(key: Column, seed: int) -> Column:
    """A reproducible order: MD5 of seed and key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))


def sample_rows(df: DataFrame, key: str, count: int, seed: int) -> DataFrame:
    """``count`` rows drawn without replacement, all of them if there are no more."""
    return df.orderBy(seeded(F.col(key), seed), key).limit(count)


def sample_by_view(df: DataFrame, view: str, key: str, weights: dict[str, float], total: int, seed: int) -> DataFrame:
    """``total`` rows by the views' weights; what a view lacks is filled from rows not drawn, in order of views.

    Unlike a filter by identity over copies, back-filling never repeats a row. At most ``total`` rows of
    a view are looked at, which is all that can be drawn.
    """
    shares = largest_remainder(total, list(weights.values()))
    order = {v: i for i, v in enumerate(weights)}
    ranked = cap_per_group(df.where(F.col(view).isin(*weights)).withColumn("draw", seeded(F.col(key), seed)), [view], ["draw", key], total)
    share = F.element_at(F.create_map(*[F.lit(x) for p in zip(weights, shares, strict=True) for x in p]), F.col(view))
    place = F.element_at(F.create_map(*[F.lit(x) for p in order.items() for x in p]), F.col(view))
    later = (F.col("rank") > share).cast("int")
    picked = ranked.withColumns({"later": later, "view_order": place}).orderBy("later", "view_order", "rank").limit(total)
    return picked.drop("later", "view_order", "rank", "draw")


def ratio_split(rank: Column, total: Column, ratios: dict[str, int]) -> Column:
    """Split names for 1-based ranks: contiguous shares of ``total`` by integer ratio, largest remainders first."""
    whole = {s: F.floor(total * r / sum(ratios.values())) for s, r in ratios.items()}
    rest = {s: (total * r) % sum(ratios.values()) for s, r in ratios.items()}
    left = total - sum(whole.values(), F.lit(0))
    names = list(ratios)
    out, upto = None, F.lit(0)
    for i, s in enumerate(names):
        ahead = sum((((rest[t] > rest[s]) | ((rest[t] == rest[s]) & F.lit(names.index(t) < i))).cast("int") for t in names if t != s), F.lit(0))
        upto = upto + whole[s] + (ahead < left).cast("int")
        out = F.when(rank <= upto, s) if out is None else out.when(rank <= upto, s)
    return out


def split_counts(total: int, ratios: dict[str, int]) -> dict[str, int]:
    return dict(zip(ratios, largest_remainder(total, list(ratios.values())), strict=True))


def balanced(df: DataFrame, group: str, key: str, digest: Column, ratios: dict[str, int], count: int | None = None) -> DataFrame:
    """Equally many rows of every group (the least group's size, or ``count``), each split by ratio."""
    sizes = df.groupBy(group).count()
    least = sizes.agg(F.min("count")).first()[0] or 0
    if count is not None and count > least:
        raise ValueError(f"a group has {least} rows, fewer than {count}")
    n = least if count is None else count
    picked = bottom_k(df, digest, key, n, [group])
    return picked.withColumn("split", ratio_split(F.col("rank"), F.lit(n), ratios)).drop("digest", "rank")


def mixture(primary: DataFrame, auxiliary: DataFrame, key: str, seed: int) -> DataFrame:
    """Union with ``mixture_role`` in a reproducible shuffled order (``draw``)."""
    parts = [df.withColumn("mixture_role", F.lit(role)) for df, role in ((primary, "primary"), (auxiliary, "auxiliary"))]
    both = parts[0].unionByName(parts[1], allowMissingColumns=True)
    return both.withColumn("draw", seeded(F.concat_ws(":", "mixture_role", F.col(key).cast("string")), seed))


def dedup_first(df: DataFrame, keys: list[Column], order: str) -> DataFrame:
    """One row a key, the first in ``order``, with ``copies``. Keys are compared by digest; rows move once, narrow."""
    digest = F.md5(F.concat_ws("\x1f", *[F.coalesce(k.cast("string"), F.lit("\x00")) for k in keys]))
    return df.withColumn("digest", digest).groupBy("digest").agg(F.min(order).alias(order), F.count("*").alias("copies"))


def anti_join_text(rows: DataFrame, excluded: DataFrame, rows_text: Column, excluded_text: Column) -> DataFrame:
    """Rows whose normalised text is none of the excluded ones; rows without text stay."""
    keys = excluded.select(F.md5(excluded_text).alias("text_digest")).where("text_digest is not null").distinct()
    return rows.withColumn("text_digest", F.md5(rows_text)).join(keys, "text_digest", "left_anti").drop("text_digest")
