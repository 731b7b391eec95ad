"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document is the set of its word shingles. Two documents link when their sets' Jaccard similarity
reaches ``percent``. The join never meets all documents at once:

1. Documents with equal sets, told by a 128-bit hash of the set, are one member from here on.
2. Under a rare-first order, the prefix of a member consists of shingles that no other member has, once
   it has as many of those as its prefix is long; then it links with nothing. Shingle frequencies over
   all members are counted for this, each task first merging its own shingles, packed by hash bucket.
   Buckets grow in number with the corpus; beyond ``WIDE`` of them, blocks are dealt to that many coarse
   buckets first and to fine ones in a second step, so that a block's rows stay few and full.
3. For the members left, exact frequencies among them order every set, and each puts its prefix, with
   positions, under its n-grams. Members of one prefix n-gram are first compared with one of them, drawn
   by hash per n-gram, a few times, so that a large group of near copies becomes one component in linear
   work. Then every pair under a common prefix n-gram that is still in two components is compared;
   n-grams of many members are cut into blocks, and pairs of blocks are dealt to tasks.
4. A pair must pass the length filter, the positional filter and the suffix filter (a lower bound on the
   symmetric difference from 512-bit parity sketches) and is then verified once on the whole sets.

All filters are exact: they drop only pairs that cannot reach the similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from seamline.llm.skew import fits_broadcast, salted_join
from seamline.llm.texts import WordHashes, bound_batches, word_hashes
from seamline.session import durable

#: Shingles a worker merges at a time, and documents among them.
BLOCK_SHINGLES = 1_000_000
BLOCK_DOCS = 60_000
CHARS_PER_BUCKET = 24_000_000
#: Buckets that a block is dealt to at most.
WIDE = 1_024
SEVERAL = 65_535
#: Bits of the short names of members; members that share one are told apart by the other half of their hash.
NAME_BITS = 64
#: Members of one n-gram that meet within one task.
MEMBERS_PER_BLOCK = 1_000
SKETCH_BITS = 512
#: Times that the members of a prefix n-gram are compared with one of them, drawn anew.
STAR_ROUNDS = 2
#: Edges a worker merges at a time; a graph is walked again and again only where it has more.
BLOCK_EDGES = 1_000_000
#: Edges of one node that a task takes as they come.
ROWS_PER_PART = 50_000

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def shingle_set(text: str | None, words: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's ``words``-word shingles (A-Z lower-cased).

    A shorter text is one shingle, the whole sequence; without words there is none.
    """
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(parts)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, parts), np.uint64, n)
    take = min(words, n)
    h = np.zeros(n - take + 1, np.uint64)
    for k in range(take):
        h += w[k : n - take + 1 + k] * _multiplier(k)
    if n < words:
        h += np.uint64(n)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def _multiplier(k: int) -> np.uint64:
    return np.uint64((int(_ODD[k % 5]) * (2 * (k // 5) + 1)) & (2**64 - 1))


def _sets(batches, words: int, bits: int):
    """key, set and the halves of its hash: a short name and a check."""
    hashes = word_hashes()
    for batch in batches:
        keys = batch.column(0)
        for key, text in zip(keys, batch.column(1), strict=True):
            h = shingle_set(text.as_py(), words, hashes)
            both = xxhash.xxh3_128_intdigest(h.tobytes())
            yield key.as_py(), h, (both & ((1 << bits) - 1)) - 2 ** (bits - 1), (both >> 64) - 2**63


def _pages(rows: Iterator[tuple], schema: pa.Schema, size: int, weight=lambda row: 1):
    """Rows in record batches of bounded weight."""
    held, weighs = [], 0
    for row in rows:
        held.append(row)
        weighs += weight(row)
        if weighs >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, weighs = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_FACT = [("n", pa.int64()), ("member", pa.int64()), ("check", pa.int64()), ("times", pa.int64())]
_PACKED = [("bucket", pa.int64()), ("low", pa.binary()), ("owner", pa.binary()), ("names", pa.binary())]
_FACT_DDL = "n bigint, member bigint, check bigint, times bigint"
_PACKED_DDL = "bucket bigint, low binary, owner binary, names binary"


def _runs(sorted_keys: np.ndarray):
    if not len(sorted_keys):
        return
    cuts = np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(sorted_keys)], strict=True)


def _dealt(key: np.ndarray, alone: np.ndarray, owner: np.ndarray, names: np.ndarray, wide: int):
    """Rows of a block. ``key``: fine bucket and low half of distinct shingles; ``owner``: of those ``alone``.

    A row holds the block's shingles of one of ``wide`` coarse buckets (whole keys), or of one fine bucket
    (low halves) where ``wide`` is 0.
    """
    bucket = key >> np.uint64(32)
    if wide:
        bucket %= np.uint64(wide)
        order = np.argsort(bucket, kind="stable")
        key, alone, owner, bucket = key[order], alone[order], owner[order], bucket[order]
    for at, end in _runs(bucket):
        here, local = np.unique(owner[at:end][alone[at:end]], return_inverse=True)
        owners = np.full(end - at, SEVERAL, np.uint16)
        owners[alone[at:end]] = local
        low = key[at:end] if wide else (key[at:end] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        yield int(bucket[at]), low.tobytes(), owners.tobytes(), names[here].tobytes()


def _packed_block(sets: list[np.ndarray], members: list[int], buckets: int, wide: int):
    """Rows of one block: its distinct shingles by bucket, each with its owner or the mark of several."""
    h = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets), dtype=np.uint32), [len(s) for s in sets])
    key = (((h >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
    order = np.argsort(key)
    key, owner = key[order], owner[order]
    first = np.concatenate(([True], key[1:] != key[:-1]))
    alone = first & np.concatenate((first[1:], [True]))
    return _dealt(key[first], alone[first], owner[first], np.array(members, np.int64), wide)


def _fact_name(key, member: int, check: int) -> bytes:
    return repr((key, member, check)).encode()


def _fact_bucket(name: bytes, buckets: int) -> int:
    return xxhash.xxh64_intdigest(name) % buckets


def _pack(words: int, bits: int, buckets: int, wide: int, key_type: pa.DataType):
    """Documents → facts (one row for equal ones of a block) and packed shingles, told by which half is null."""
    schema = pa.schema([("key", key_type), *_FACT, *_PACKED])

    def block(sets, members, facts):
        for key, n, member, check, times, name in facts.values():
            fine = _fact_bucket(name, buckets)
            yield key, n, member, check, times, fine % wide if wide else fine, None, None, None
        if sets:
            for row in _packed_block(sets, members, buckets, wide):
                yield None, None, None, None, None, *row

    def rows(batches):
        sets, members, seen, facts, held = [], [], set(), {}, 0
        for key, h, member, check in _sets(batches, words, bits):
            name = _fact_name(key, member, check)
            facts.setdefault(name, [key, len(h), member, check, 0, name])[4] += 1
            if len(h) and member not in seen:
                seen.add(member)
                sets.append(h)
                members.append(member)
                held += len(h)
            if held >= BLOCK_SHINGLES or len(facts) >= BLOCK_DOCS:
                yield from block(sets, members, facts)
                sets, members, seen, facts, held = [], [], set(), {}, 0
        yield from block(sets, members, facts)

    def run(batches):
        return _pages(rows(batches), schema, 4_000_000, lambda row: 200 + len(row[6] or b"") + len(row[7] or b""))

    return run


def _unpacked(low: pa.ChunkedArray, owner: pa.ChunkedArray, names: pa.ChunkedArray, kind: type):
    """Keys, owners (as places among the distinct names, -1 for several) and the distinct names of packed rows."""
    known = np.unique(np.concatenate([np.frombuffer(m.as_py(), np.int64) for m in names]))
    keys, owners = [], []
    for k, o, m in zip(low, owner, names, strict=True):
        own = np.frombuffer(o.as_py(), np.uint16)
        place = np.full(len(own), -1, np.int64)
        alone = own != SEVERAL
        place[alone] = np.searchsorted(known, np.frombuffer(m.as_py(), np.int64))[own[alone]]
        keys.append(np.frombuffer(k.as_py(), kind))
        owners.append(place)
    return np.concatenate(keys), np.concatenate(owners), known


def _repack(buckets: int, key_type: pa.DataType):
    """Rows of coarse buckets, in their order, to rows of fine ones."""
    schema = pa.schema([("key", key_type), *_FACT, *_PACKED])

    def dealt(held: list[pa.RecordBatch]):
        table = pa.Table.from_batches(held)
        key, owner, names = _unpacked(table["low"], table["owner"], table["names"], np.uint64)
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        ends = np.append(starts[1:], len(key)) - 1
        alone = (owner[starts] == owner[ends]) & (owner[starts] >= 0)
        for row in _dealt(key[starts], alone, owner[starts], names, 0):
            yield None, None, None, None, None, *row

    def rows(batches):
        held, weighs, docs, coarse = [], 0, 0, None
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                if one["low"][0].as_py() is None:
                    fact = [c[0].as_py() for c in one.columns]
                    fact[5] = _fact_bucket(_fact_name(fact[0], *fact[2:4]), buckets)
                    yield fact
                    continue
                more = len(one["names"][0].as_py()) // 8
                bucket = one["bucket"][0].as_py()
                if held and (bucket != coarse or weighs >= BLOCK_SHINGLES or docs + more > BLOCK_DOCS):
                    yield from dealt(held)
                    held, weighs, docs = [], 0, 0
                held.append(one)
                coarse, weighs, docs = bucket, weighs + len(one["low"][0].as_py()) // 8, docs + more
        if held:
            yield from dealt(held)

    def run(batches):
        return _pages(rows(batches), schema, 4_000_000, lambda row: 200 + len(row[6] or b"") + len(row[7] or b""))

    return run


def _count_singles(key_type: pa.DataType):
    """Per member: how many of its shingles in this bucket no other member has. Facts pass."""
    schema = pa.schema([("key", key_type), *_FACT, ("singles", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        packed = table.filter(pa.compute.is_valid(table["low"]))
        facts = table.filter(pa.compute.is_null(table["low"]))
        facts = facts.select(["key", *[n for n, _ in _FACT]]).append_column("singles", pa.nulls(len(facts), pa.int64())).cast(schema)
        if not len(packed):
            return facts
        low, owner, known = _unpacked(packed["low"], packed["owner"], packed["names"], np.uint32)
        several = np.uint64(2**32 - 1)
        keys = (low.astype(np.uint64) << np.uint64(32)) | (owner.astype(np.uint64) & several)
        keys.sort()
        starts = np.flatnonzero(np.concatenate(([True], (keys[1:] >> np.uint64(32)) != (keys[:-1] >> np.uint64(32)))))
        ends = np.append(starts[1:], len(keys)) - 1
        once = keys[starts][keys[starts] == keys[ends]] & several
        count = np.bincount(once[once != several].astype(np.int64), minlength=len(known))
        some = count > 0
        found = {"member": pa.array(known[some]), "singles": pa.array(count[some].astype(np.int64))}
        empty = [found[f.name] if f.name in found else pa.nulls(int(some.sum()), f.type) for f in schema]
        return pa.concat_tables([facts, pa.table(empty, schema=schema)])

    return run


def _open_sets(words: int, bits: int):
    schema = pa.schema([("member", pa.int64()), ("check", pa.int64()), ("hashes", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])

    def rows(batches):
        for _, h, member, check in _sets(batches, words, bits):
            odd = np.bincount((h & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
            sketch = np.packbits(odd.astype(np.uint8)).view(np.int64)
            yield member, check, h.view(np.int64), sketch

    def run(batches):
        return _pages(rows(batches), schema, 500_000, lambda row: 50 + len(row[2]))

    return run


def _prefix_length(n: Column, percent: int) -> Column:
    return n - F.ceil(n * percent / F.lit(100)) + 1


def _forests(batches):
    """Edges ``a``, ``b`` of a task, a block at a time → an edge from each node to the least that the block's edges lead to."""

    def forest(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        nodes, place = np.unique(np.concatenate([table["a"].to_numpy(), table["b"].to_numpy()]), return_inverse=True)
        root, x, y = np.arange(len(nodes)), place[: len(table)], place[len(table) :]
        while (root[x] != root[y]).any():
            np.minimum.at(root, np.maximum(root[x], root[y]), np.minimum(root[x], root[y]))
            while (root != root[root]).any():
                root = root[root]
        lower = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[lower]), pa.array(nodes[root[lower]])], names=["a", "b"])

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= BLOCK_EDGES:
            yield forest(held)
            held, rows = [], 0
    if held:
        yield forest(held)


def components(edges: DataFrame) -> DataFrame:
    """``a``, ``b`` → ``node``, ``root`` (the least node reachable), for nodes that are no root.

    Each task first replaces its edges by stars, a block at a time. Where there are more edges than a block holds, large and
    small stars alternate across tasks; nodes with more than ``ROWS_PER_PART`` edges are spread over tasks.
    """
    mark = None
    e = durable(edges.select("a", "b").where("a <> b").distinct())
    n = e.count()
    while True:
        e = durable(e.coalesce(-(-n // BLOCK_EDGES) or 1).mapInArrow(_forests, "a bigint, b bigint"))
        if n <= BLOCK_EDGES:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = salted_join(both, least, "a", F.col("b"), 2 * n, hot_rows=ROWS_PER_PART)
        large = durable(large.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = salted_join(large, least, "a", F.col("b"), 2 * n, hot_rows=ROWS_PER_PART)
        small = small.select("a", F.col("m").alias("b")).unionByName(
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        e = durable(small.distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark, n = now, now[0]


def jaccard_links(sets: DataFrame, percent: int) -> DataFrame:
    """``member``, ``hashes``, ``sketch`` → links that connect what all links connect, and the same components."""
    sizes = sets.select("member", F.size("hashes").cast("long").alias("n"))
    tokens = sets.select("member", F.explode("hashes").alias("gram"))
    often = tokens.groupBy("gram").agg(F.count("*").alias("often")).where("often > 1")
    shared = tokens.join(often, "gram").groupBy("member").agg(F.array_sort(F.collect_list(F.struct("often", "gram"))).alias("grams"))
    shared = shared.join(sizes, "member").withColumn("singles", F.col("n") - F.size("grams"))
    reach = F.greatest(F.lit(0), _prefix_length(F.col("n"), percent) - F.col("singles")).cast("int")
    prefix = shared.select("member", "n", "singles", F.posexplode(F.slice("grams", F.lit(1), reach)).alias("k", "g"))
    prefix = durable(prefix.select("member", "n", F.col("g.gram").alias("gram"), (F.col("singles") + F.col("k")).alias("pos")))
    grams = prefix.count()

    def possible(x: str, y: str) -> Column:
        """Length filter, then positional filter."""
        a, b, i, j = (F.col(f"{s}.{c}") for c in ("n", "pos") for s in (x, y))
        most = F.least(i, j) + F.least(a - i, b - j)
        return (F.least(a, b) * 100 >= F.greatest(a, b) * percent) & (most * (100 + percent) >= (a + b) * percent)

    def near(x: Column, y: Column, a: Column, b: Column) -> Column:
        """Suffix filter: parity sketches differ in no more bits than the sets in elements."""
        apart = sum((F.bit_count(x[k].bitwiseXOR(y[k])) for k in range(SKETCH_BITS // 64)), F.lit(0))
        return apart * (100 + percent) <= (a + b) * (100 - percent)

    def ordered(pairs: DataFrame) -> DataFrame:
        x, y = F.col("x.member"), F.col("y.member")
        return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()

    def looked_up(pairs: DataFrame, x: DataFrame, y: DataFrame) -> DataFrame:
        """What ``x`` has for ``a`` and ``y`` for ``b``. One member may stand in very many pairs."""
        rows = pairs.count()
        return salted_join(salted_join(pairs, x, "a", F.col("b"), rows), y, "b", F.col("a"), rows)

    sketches = sets.select("member", "sketch", F.size("hashes").alias("n"))

    def sifted(pairs: DataFrame) -> DataFrame:
        x, y = sketches.select(F.col("member").alias("a"), F.col("sketch").alias("xs"), F.col("n").alias("xn")), sketches.select(F.col("member").alias("b"), F.col("sketch").alias("ys"), F.col("n").alias("yn"))
        return looked_up(pairs, x, y).where(near(F.col("xs"), F.col("ys"), F.col("xn"), F.col("yn"))).select("a", "b")

    def verified(pairs: DataFrame) -> DataFrame:
        x, y = sets.select(F.col("member").alias("a"), F.col("hashes").alias("xs")), sets.select(F.col("member").alias("b"), F.col("hashes").alias("ys"))
        common = F.size(F.array_intersect("xs", "ys"))
        enough = common * (100 + percent) >= (F.size("xs") + F.size("ys")) * percent
        return looked_up(pairs, x, y).where(enough).select("a", "b")

    def with_roots(roots: DataFrame) -> DataFrame:
        joined = prefix.join(roots, prefix["member"] == roots["node"], "left")
        return durable(joined.select("member", "n", "gram", "pos", F.coalesce("root", "member").alias("root")))

    placed, tested, roots = prefix.withColumn("root", F.col("member")), None, None
    for k in range(STAR_ROUNDS):
        draw = F.xxhash64("gram", "member", F.lit(k))
        heads = placed.groupBy("gram").agg(F.min_by(F.struct("member", "n", "pos", "root"), draw).alias("head"), F.min("root").alias("lo"), F.max("root").alias("hi"))
        heads = heads.where("lo <> hi").select("gram", "head.*")
        heads = heads.select("gram", F.struct("member", "n", "pos", "root").alias("y"))
        stars = salted_join(placed.select("gram", F.struct("member", "n", "pos", "root").alias("x")), heads, "gram", F.col("x.member"), grams)
        stars = ordered(stars.where((F.col("x.root") != F.col("y.root")) & possible("x", "y")))
        stars = durable(stars if tested is None else stars.join(tested, ["a", "b"], "left_anti"))
        stars = durable(sifted(stars))
        tested = stars if tested is None else tested.unionByName(stars)
        links = verified(stars)
        if roots is not None:
            links = links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = components(links)
        placed = with_roots(roots)

    torn = placed.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("members"))
    torn = torn.where("lo <> hi").select("gram", F.ceil(F.col("members") / MEMBERS_PER_BLOCK).alias("blocks"))
    rest = salted_join(placed, torn, "gram", F.col("member"), grams).join(sketches.select("member", "sketch"), "member")
    rest = durable(rest.withColumn("own", F.pmod(F.xxhash64("member"), F.col("blocks"))))
    late = ordered(pairs_within(rest, possible, near)).join(tested, ["a", "b"], "left_anti")
    late = verified(durable(late))
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(late))


def pairs_within(rest: DataFrame, possible, near) -> DataFrame:
    """Pairs ``x``, ``y`` of one n-gram and of different roots that pass the filters, each pair once a n-gram.

    A member of block ``own`` goes to the pairs of blocks that its block is part of, one for each block;
    two members of one block meet only where that block is paired with itself.
    """
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    cut = rest.withColumn("other", other).withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    x, y = cut.alias("x"), cut.alias("y")
    spot = (F.col("x.gram") == F.col("y.gram")) & (F.col("x.lo") == F.col("y.lo")) & (F.col("x.hi") == F.col("y.hi"))
    once = (F.col("x.own") != F.col("y.own")) | (F.col("x.lo") == F.col("x.hi"))
    apart = (F.col("x.member") < F.col("y.member")) & (F.col("x.root") != F.col("y.root"))
    alike = near(F.col("x.sketch"), F.col("y.sketch"), F.col("x.n"), F.col("y.n"))
    return x.join(y, spot & once & apart & possible("x", "y") & alike)


def jaccard_components(df: DataFrame, key: str, text: str, words: int = 5, percent: int = 80) -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` of every row: the least key that links lead to.

    Rows without words (null or empty text among them) have no shingles and link with nothing, not even
    each other. Rows with equal sets link. Null keys take part; a component's id is null only if all its
    keys are. Repeated rows stay. An empty ``df`` gives no rows.
    """
    docs = bound_batches(df).select(F.col(key).alias("key"), F.col(text).alias("text"))
    key_type = docs.schema["key"].dataType.simpleString()
    arrow_key = to_arrow_type(StructType.fromDDL(f"key {key_type}")["key"].dataType)  # every part may be null
    chars = df.agg(F.sum(F.length(text))).first()[0] or 0
    counted = durable(fact_rows(docs, words, max(16, -(-chars // CHARS_PER_BUCKET)), key_type, arrow_key))

    facts = counted.where("n is not null").select("key", "n", "member", "check", "times")
    facts = facts.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("times")
    singles = counted.where("n is null").groupBy("member").agg(F.sum("singles").alias("singles"))
    members = facts.where("n > 0").groupBy("member").agg(
        F.first("n").alias("n"), F.min("key").alias("one"), F.count("*").alias("copies"), F.min("check").alias("check"), (F.min("check") != F.max("check")).alias("several")
    )
    enough = F.coalesce(F.col("singles"), F.lit(0)) >= _prefix_length(F.col("n"), percent)
    members = durable(members.join(singles, "member", "left").select("member", "one", "copies", "check", "several", enough.alias("alone")))
    # Members that share a short name are told apart from here on, and take part in all comparisons.
    several = members.where("several").select("member")
    shared = facts.join(F.broadcast(several) if fits_broadcast(several) else several, "member").groupBy("member", "check")
    shared = shared.agg(F.min("key").alias("one"), F.count("*").alias("copies"))
    twins = durable(shared.select("member", "check", "one", "copies", F.xxhash64("member", "check").alias("node")))
    open_ = members.where(~F.col("alone") & ~F.col("several")).select("member", "check", "one", F.col("member").alias("node"))
    open_ = durable(open_.unionByName(twins.select("member", "check", "one", "node")))

    few = fits_broadcast(open_)
    wanted = open_.select(F.col("one").alias("key")).distinct()
    found = docs.join(F.broadcast(wanted) if few else wanted, docs["key"].eqNullSafe(wanted["key"]), "left_semi")
    sets = found.mapInArrow(_open_sets(words, NAME_BITS), "member bigint, check bigint, hashes array<bigint>, sketch array<bigint>")
    names = open_.select("member", "check", "node")
    sets = sets.join(F.broadcast(names) if few else names, ["member", "check"]).select(F.col("node").alias("member"), "hashes", "sketch")
    roots = jaccard_links(durable(sets.dropDuplicates(["member"])), percent)

    rooted = open_.join(roots, "node", "left").select("member", "check", "one", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("one").alias("component_id"))
    rooted = durable(salted_join(rooted, least, "root", F.col("member"), open_.count()).select("member", "check", "component_id"))
    copied = members.where("copies > 1 and not several").select("member", "check", F.col("one").alias("component_id"))
    copied = copied.unionByName(twins.select("member", "check", F.col("one").alias("component_id")))
    ids = rooted.unionByName(copied.join(rooted.select("member", "check"), ["member", "check"], "left_anti"))
    ids = ids.withColumn("of_group", F.lit(True))
    placed = salted_join(facts, ids, ["member", "check"], F.col("key"), facts.count(), "left")
    mine = F.when((F.col("n") > 0) & F.col("of_group"), F.col("component_id")).otherwise(F.col("key"))
    return placed.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), mine.alias("component_id"))


def fact_rows(docs: DataFrame, words: int, buckets: int, key_type: str, arrow_key: pa.DataType, wide: int | None = None) -> DataFrame:
    """``key``, ``text`` → facts (key, n, member, check, times) and counts (member, singles), one reading of the texts."""
    wide = WIDE if wide is None else wide
    two = buckets > wide
    ddl = f"key {key_type}, {_FACT_DDL}, {_PACKED_DDL}"
    packed = docs.mapInArrow(_pack(words, NAME_BITS, buckets, wide if two else 0, arrow_key), ddl)
    if two:
        packed = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_repack(buckets, arrow_key), ddl)
    return packed.groupBy("bucket").applyInArrow(_count_singles(arrow_key), f"key {key_type}, {_FACT_DDL}, singles bigint")


def keep_one(df: DataFrame, key: str, text: str, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df`` less all but one of each component: that with the least key stays.

    Rows are told apart by key and text; of rows with both equal, one stays. Rows without key stand
    after all others.
    """
    own = F.struct(F.col(key).isNull().alias("no_key"), F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"))
    rows = df.select(F.struct("*").alias("row"), own.alias("own"), F.col(text).alias("text"))
    found = jaccard_components(rows, "own", "text", words, percent)
    least = found.groupBy("own").agg(F.min("component_id").alias("first"), F.count("*").alias("m"))
    marks = least.where("first <> own or m > 1").select(F.col("own").alias("marked"), (F.col("first") != F.col("own")).alias("goes"))
    marks = durable(marks)
    few = fits_broadcast(marks)
    marked = rows.join(F.broadcast(marks) if few else marks, F.col("own") == F.col("marked"), "left")
    single = marked.where("goes is null").select("row")
    repeated = marked.where("goes = false").dropDuplicates(["own"]).select("row")
    return single.unionByName(repeated).select("row.*")


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Components of all documents linked at a Jaccard similarity of 0.9 over 3-word shingles."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_components(docs, "doc_id", "text", words=3, percent=90)
