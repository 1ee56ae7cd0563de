import random

from memlift.llm.components import components


def brute(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return {x: top(x) for e in edges for x in e if any(a != b for a, b in edges if x in (a, b))}


def run(spark, edges):
    return {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}


def test_chain_star_and_pairs(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, x) for x in range(101, 120)] + [(205, 203), (203, 205), (300, 300)]
    assert run(spark, edges) == brute(edges)


def test_random_graph(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)]
    assert run(spark, edges) == brute(edges)


def test_no_edges(spark):
    assert run(spark, []) == {}
