"""Strongly connected components: long paths and cycles, and random graphs against reachability."""

import random

import pytest

from sluice.operators.kernels import strong_components


def brute(nodes, edges):
    onward = {n: {n} for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if not onward[b] <= onward[a]:
                onward[a] |= onward[b]
                changed = True
    return {n: min(m for m in onward[n] if n in onward[m]) for n in nodes}


def found(spark, nodes, edges, few):
    rows = strong_components(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, "a long, b long"), few).collect()
    assert len(rows) == len(set(nodes))
    return {r["node"]: r["root"] for r in rows}


@pytest.mark.parametrize("few", [1 << 19, 0])
def test_random_graphs(spark, few):
    rng = random.Random(few)
    nodes = range(40)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(55)] + [(3, 3), (5, 6), (5, 6)]
    assert found(spark, nodes, edges, few) == brute(nodes, edges)


def test_paths_and_cycles_of_a_thousand_nodes(spark):
    nodes = range(1000)
    path = [(i, i + 1) for i in range(999)]
    assert found(spark, nodes, path, 1 << 19) == {n: n for n in nodes}
    assert found(spark, nodes, [*path, (999, 0)], 1 << 19) == dict.fromkeys(nodes, 0)
    rings = [(i, i + 1 if i % 10 < 9 else i - 9) for i in nodes] + [(10 * k + 4, 10 * k + 13) for k in range(99)]
    assert found(spark, nodes, rings, 1 << 19) == {n: n // 10 * 10 for n in nodes}


def test_rings_without_the_last_task(spark):
    nodes = range(24)
    rings = [(i, i + 1 if i % 6 < 5 else i - 5) for i in nodes] + [(6 * k + 2, 6 * k + 7) for k in range(3)]
    assert found(spark, nodes, rings, 0) == {n: n // 6 * 6 for n in nodes}


def test_without_nodes_or_links(spark):
    assert found(spark, [], [], 0) == {}
    assert found(spark, [4, 4, 5], [], 0) == {4: 4, 5: 5}
