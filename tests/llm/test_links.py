"""Connected components against union-find."""

import random

import pytest

from cuepoint.llm._links import components


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range([10, 50, 90][seed])] + [(5, 5)]
    edges += [(1000 + i, 1001 + i) for i in range(40 * seed)] + [(2000, 2000 + i) for i in range(1, 30)]
    root: dict[int, int] = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    rows = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.root for r in rows} == {x: find(x) for x in root} and len(rows) == len(root)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
