"""Components of graphs: within one block, across blocks, and in few jobs."""

import random

import pytest

from seamline.llm import jaccard


def plain(edges):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        lo, hi = sorted((top(a), top(b)))
        root[hi] = lo
    return {x: top(x) for x in root if top(x) != x}


def graph(seed):
    """A path in mixed order, a star, a cycle, random trees, loops and repeated edges; ids of either sign."""
    r = random.Random(seed)
    path = r.sample(range(-500, 500), 60)
    edges = list(zip(path, path[1:], strict=False)) + [(2_000, k) for k in range(1_960, 2_040)] + [(3_000 + k, 3_000 + (k + 1) % 9) for k in range(9)]
    edges += [(4_000 + r.randrange(80), 4_000 + r.randrange(80)) for _ in range(60)] + [(2**62, -(2**62)), (7_000, 7_000)]
    return r.sample(edges + edges[:20], len(edges) + 20)


def found(spark, edges):
    rows = jaccard.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()
    assert len(rows) == len({r.node for r in rows})
    return {r.node: r.root for r in rows}


@pytest.mark.parametrize("edges_per_task", [50_000, 40])
def test_components_of_one_block_take_few_jobs(spark, monkeypatch, edges_per_task):
    """A long path took a round of a dozen jobs for each doubling; plans, exchanges and threads of them all stay with the driver."""
    monkeypatch.setattr(jaccard, "ROWS_PER_PART", edges_per_task)
    edges = graph(1)
    spark.sparkContext.setJobGroup(f"components {edges_per_task}", "")
    got = found(spark, edges)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"components {edges_per_task}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == plain(edges)
    assert 0 < jobs <= 12


def test_components_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "ROWS_PER_PART", 40)
    monkeypatch.setattr(jaccard, "BLOCK_EDGES", 40)
    edges = graph(2)
    assert found(spark, edges) == plain(edges)


def test_no_edges(spark):
    assert found(spark, []) == {} and found(spark, [(3, 3)]) == {}
