"""Codes and codebooks against plain integer arithmetic."""

import hashlib
import math
import random

import numpy as np
import pytest

from seamline.llm import codebooks as C

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=4, entries=256, rounds=4):
    """(vec_id, code, error, label_error) rows and the codebooks; Python integers throughout."""
    good = [(k, v, y) for k, v, y in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not good:
        return [], []
    n = len(min(good, key=lambda r: (r[0] is None, r[0] or 0))[1])
    good = [(k, [math.floor(x * 1024) for x in v] + [0] * (-n % parts), y) for k, v, y in good if len(v) == n]
    width = (n + -n % parts) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in good]
    seeds = {}
    for (k, v, _), c in zip(good, cut):
        if k is not None and (k not in seeds or v < seeds[k][0]):
            seeds[k] = (v, c)
    books = [[seeds[k][1][p] for k in sorted(seeds)[:entries]] for p in range(parts)]

    def nearest(q, book):
        return min((sum((a - b) ** 2 for a, b in zip(q, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for c in cut:
                own.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            for i, members in own.items():
                books[p][i] = [sum(x) // len(members) for x in zip(*members)]
    out = []
    for (k, _, y), c in zip(good, cut):
        found = [nearest(c[p], books[p]) for p in range(parts)]
        out.append((k, "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found), y))
    sums = {}
    for _, _, d, y in out:
        sums[y] = sums.get(y, 0) + d
    return sorted(((k, code, d, sums[y]) for k, code, d, y in out), key=str), books


def coded(spark, rows, schema=SCHEMA, **kw):
    df = C.same_length(spark.createDataFrame(rows, schema).repartition(3), "embedding", "vec_id")
    books = C.fit_codebooks(df, "embedding", "vec_id", **kw)
    if books is None:
        return [], []
    out = C.with_group_sum(C.encode(df, "embedding", books, ["vec_id", "label"]), "label", "error", "label_error")
    return sorted((tuple(r) for r in out.select("vec_id", "code", "error", "label_error").collect()), key=str), books.tolist()


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").limit(400).collect()]
    want, books = brute(rows)
    assert coded(spark, rows) == (want, books)
    got = C.op13_vector_codes(spark, SF).collect()
    assert {r.vec_id for r in got} == {r[0] for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").collect()}
    assert len({r.codebooks_sha256 for r in got}) == 1 and all(len(r.code) == 8 for r in got)
    if len(got) == len(rows):
        assert sorted((tuple(r)[:4] for r in got), key=str) == want
        assert got[0].codebooks_sha256 == hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


@pytest.mark.parametrize("seed", range(4))
def test_ties_nulls_and_odd_lengths(spark, seed):
    r = random.Random(seed)
    n = [4, 6, 1, 8][seed]
    rows = [(r.choice([None, *range(60)]), [r.randrange(-2, 3) / 2 for _ in range(n)], r.choice([None, 1, 2])) for _ in range(150)]
    rows += [(-1, None, 1), (-2, [None] * n, 1), (-3, [float("nan")] * n, 1), (-4, [math.inf] * n, None), (-5, [], 1), (3, [1.0] * (n + 4), 1), (70, [0.0] * n, None), (70, [0.0] * n, None)]
    got, books = coded(spark, rows, entries=32)
    want, theirs = brute(rows, entries=32)
    assert got == want and books == theirs


def test_many_copies_of_few_keys(spark):
    rows = [(k % 5, [float(k % 7), 0.0, 1.0, 2.0], k % 3) for k in range(300)]
    assert coded(spark, rows, entries=8) == brute(rows, entries=8)


def test_clashing_columns_and_empty_tables(spark):
    rows = [(1, [0.5] * 8, 1, "x", 3), (2, [0.25] * 8, None, "y", 4)]
    assert coded(spark, rows, SCHEMA + ", code string, error int") == brute([r[:3] for r in rows])
    assert coded(spark, [], SCHEMA) == ([], [])
    assert coded(spark, [(1, None, 2)], SCHEMA) == ([], [])


def test_large_components_stay_exact():
    r = random.Random(7)
    entries = np.array([[r.randrange(-(2**27), 2**27) for _ in range(16)] for _ in range(200)])
    queries = np.array([[r.randrange(-(2**27), 2**27) for _ in range(16)] for _ in range(50)] + entries[:20].tolist())
    index, least = C.Codebook(entries).nearest(queries)
    for q, i, d in zip(queries.tolist(), index.tolist(), least.tolist()):
        assert (d, i) == min((sum((a - b) ** 2 for a, b in zip(q, e)), k) for k, e in enumerate(entries.tolist()))


def test_only_the_annulus_is_evaluated():
    """Entries on shells: a query meets its own shell's tiles, not all entries."""
    r = np.random.default_rng(3)
    base = r.normal(size=(256, 4))
    entries = np.floor(base / np.linalg.norm(base, axis=1, keepdims=True) * (1 + np.arange(256)[:, None] * 50)).astype(np.int64)
    queries = entries[r.integers(0, 256, 2000)] + r.integers(-2, 3, (2000, 4))
    book = C.Codebook(entries)
    index, _ = book.nearest(queries)
    assert (index == ((queries[:, None] - entries) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert book.seen < 0.25 * 2000 * 256


def test_decoding_gives_the_named_entries(spark):
    rows = [(k, [k / 7, -k / 3, 1.0, 0.0, 2.0, k / 5, 0.5, 0.25], 0) for k in range(40)]
    df = C.same_length(spark.createDataFrame(rows, SCHEMA), "embedding", "vec_id")
    books = C.fit_codebooks(df, "embedding", "vec_id", entries=64)
    vectors = {k: [math.floor(np.float32(x) * 1024) for x in v] for k, v, _ in rows}
    for row in C.decode(C.encode(df, "embedding", books, ["vec_id"]), "code", books).collect():
        assert sum((a - b) ** 2 for a, b in zip(vectors[row.vec_id], row.decoded)) == row.error
