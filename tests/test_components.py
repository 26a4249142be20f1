"""Components against a plain union-find."""

import random

import pytest

from quernel.operators.components import connected_components


def plain(edges):
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in root}


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range([20, 80, 120, 300][seed])]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == plain(edges)


def test_chains_stars_strings_and_nulls(spark):
    chain = list(range(300, 370))
    random.Random(1).shuffle(chain)
    edges = [*zip(chain, chain[1:], strict=False), *[(7, i) for i in range(8, 60)], (5, 5), (8, 7)]
    df = spark.createDataFrame([*edges, (None, 3), (3, None)], "src long, dst long")
    assert {r.node: r.component for r in connected_components(df).collect()} == plain(edges)
    names = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y")], "src string, dst string")
    assert {r.node: r.component for r in connected_components(names).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert connected_components(df.limit(0)).count() == 0
