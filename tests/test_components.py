import random

from kgweave.operators.components import connected_components


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def test_components_match_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7), (5000, 5000)]
    edges += [(3000, 3001 + i) for i in range(50)] * 2
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges + [(None, 3)], "src long, dst long")).collect()}
    assert got == brute(edges)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
