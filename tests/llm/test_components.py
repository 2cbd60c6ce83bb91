"""Components against a plain union-find, on chains, stars, cycles and loops."""

import random

import pytest

from skerry.llm.components import components
from skerry.llm.exchange import Workspace


def plain(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("edges", [
    [], [(3, 3)], [(2, 1)], [(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 30)], [(9, 8), (8, 9), (None, 1), (9, 9)],
    [tuple(random.Random(s).sample(range(200), 2)) for s in range(150)],
])
def test_roots(spark, edges):
    got = components(spark.createDataFrame(edges, "a bigint, b bigint"), Workspace(spark, "t"), "c").collect()
    assert {r.node: r.root for r in got} == plain(edges) and len(got) == len(plain(edges))
