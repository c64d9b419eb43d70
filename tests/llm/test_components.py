"""Connected components against union-find."""

import random

from voltledger.llm.components import components


def test_components_of_chains_stars_and_random_edges(spark):
    rnd = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 540)] + [(rnd.randrange(1000, 1060), rnd.randrange(1000, 1060)) for _ in range(35)]
    edges += [(7, 7), (3, 900), (900, 3), (3, 900), (-5, 3)]
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for x, y in edges:
        a, b = sorted((find(x), find(y)))
        root[b] = a
    linked = {n for x, y in edges if x != y for n in (x, y)}
    rnd.shuffle(edges)
    got = [tuple(r) for r in components(spark.createDataFrame(edges, "x bigint, y bigint").repartition(3)).collect()]
    assert sorted(got) == sorted((n, find(n)) for n in linked)
    assert components(spark.createDataFrame([(4, 4)], "x bigint, y bigint")).collect() == []
