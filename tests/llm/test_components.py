"""Components against a union-find: paths, random graphs, nulls, self links, repeated edges, no edges."""

import random

import pytest

from quillstream.llm.components import connected_components


def brute(edges):
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    return {x: top(x) for x in up}


@pytest.mark.parametrize("nodes, links", [(30, 25), (120, 110), (1, 0)])
def test_components_equal_union_find(spark, nodes, links):
    rng = random.Random(nodes)
    edges = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(links)]
    edges += edges[:5] + [(None, 3), (4, None), (5, 5)] + [(1000 + k, 1001 + k) for k in range(20)]
    found = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r["node"]: r["root"] for r in found} == brute(edges) and len(found) == len(brute(edges))


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []
