import numpy as np
import pytest

from stratoplane.operators.graph import components


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("edges", [
    [],
    [(1, 2), (2, 3), (10, 11), (11, 3)],
    [(i, i + 1) for i in range(200)],
    [(0, i) for i in range(1, 300)] + [(i, 1000 + i) for i in range(1, 50)],
    [tuple(map(int, e)) for e in np.random.default_rng(1).integers(0, 400, (300, 2))],
])
def test_components(spark, edges):
    frame = spark.createDataFrame(edges, "a long, b long")
    found = {r["node"]: r["component"] for r in components(frame, "a", "b").collect()}
    assert found == {k: v for k, v in brute([e for e in edges if e[0] != e[1]]).items()}
