import random

from millrace.llm.components import components


def plain(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in root)


def test_components_of_any_share(spark):
    """Chains in random order, stars, repeats and self-loops; partitions of a few edges, and one of all."""
    rng = random.Random(2)
    chain = list(range(300))
    rng.shuffle(chain)
    edges = [*zip(chain, chain[1:]), *[(1000, 1000 + k) for k in range(80)], *[(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(90)], (5000, 5000)]
    table = spark.createDataFrame(edges + edges[:20], "a long, b long").repartition(7)
    for share in (20, 250_000):
        assert sorted(tuple(r) for r in components(table, share=share).collect()) == plain(edges)
    assert components(table.limit(0)).count() == 0
