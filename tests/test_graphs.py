"""Levels and closing edges of graphs that a task holds and of larger ones, against plain loops; statistics gate and bootstrap."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlift.operators import gates, graph, sampling

EDGE = "g long, src long, dst long"


def plain_levels(edges):
    level = {}
    for g, a, b in sorted(edges, key=lambda e: (e[0], e[1])):  # ids grow along edges
        level.setdefault((g, a), 0)
        level[g, b] = max(level.get((g, b), 0), level[g, a] + 1)
    return level


def ladder(n, g=1):
    """A way of n levels with side edges, so that no node has one way in and one out."""
    return [(g, i, i + s) for i in range(n) for s in (1, 3) if i + s <= n]


def got(df):
    return {(r["g"], r["node"]): r["level"] for r in df.collect()}


def test_five_thousand_levels(spark):
    edges = ladder(5000) + ladder(7, 2) + [(3, 1, 2), (3, 1, 2), (4, None, 2)]
    found = got(graph.levels(spark.createDataFrame(edges, EDGE)))
    assert found == plain_levels([e for e in edges if None not in e]) and max(found.values()) == 5000


def test_large_graphs_go_by_blocks(spark, monkeypatch):
    """The same with a task that holds few edges: levels come from rounds over blocks."""
    monkeypatch.setattr(graph, "WHOLE", 400)
    rng = random.Random(2)
    tangle = [(5, *sorted(rng.sample(range(150), 2))) for _ in range(500)]
    edges = ladder(400) + ladder(20, 2) + tangle
    assert got(graph.levels(spark.createDataFrame(edges, EDGE))) == plain_levels(set(edges))


def test_cycles_are_named(spark, monkeypatch):
    ring = ladder(30) + [(9, i, (i + 1) % 20) for i in range(20)] + [(9, 3, 50)]
    with pytest.raises(ValueError, match="graph 9"):
        graph.levels(spark.createDataFrame(ring, EDGE))
    monkeypatch.setattr(graph, "WHOLE", 15)
    with pytest.raises(ValueError, match="graph 9"):
        graph.levels(spark.createDataFrame(ring[-21:], EDGE))


def test_closing_edges_of_small_and_large_graphs(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(g, rng.randrange(30), rng.randrange(30), 10**12 + 1000 * i + g) for g in range(12) for i in range(60)]
    rows += [(20, i, i + 1, i) for i in range(50)] + [(21, 4, 4, 7), (21, 4, 4, 9)]
    want = {}
    for g in {r[0] for r in rows}:
        reach: dict = {}
        for _, a, b, seq in sorted((r for r in rows if r[0] == g), key=lambda r: r[3]):
            if a == b or a in reach.get(b, ()):
                want[g] = seq
                break
            for x in [a, *(x for x in reach if a in reach[x])]:
                reach.setdefault(x, set()).update({b, *reach.get(b, ())})
    edges = spark.createDataFrame(rows, EDGE + ", seq long")
    for whole in (graph.WHOLE, 55):
        monkeypatch.setattr(graph, "WHOLE", whole)
        assert {r["g"]: r["closing"] for r in graph.closing_edges(edges).collect()} == want


def test_strong_components_of_small_and_large_graphs(spark, monkeypatch):
    rng = random.Random(9)
    edges = [(g, rng.randrange(14), rng.randrange(14)) for g in range(3) for _ in range(16)] + [(7, i, i + 1) for i in range(5)] + [(8, 3, 3)] + [(9, i, (i + 1) % 6) for i in range(6)] + [(9, 5, 6), (9, 6, 7), (9, 7, 6)]
    want = {}
    for g in {e[0] for e in edges}:
        reach = {a: {b for x, a_, b in edges if x == g and a_ == a} for _, a, _ in edges}
        for _ in range(20):
            reach = {a: bs | {c for b in bs for c in reach.get(b, ())} for a, bs in reach.items()}
        for a in reach:
            if a in reach[a]:
                want[g, a] = min(b for b in reach[a] if a in reach.get(b, ()))
    for whole in (graph.WHOLE, 8):
        monkeypatch.setattr(graph, "WHOLE", whole)
        got_ = {(r["g"], r["node"]): r["component"] for r in graph.strong_components(spark.createDataFrame(edges, EDGE)).collect()}
        assert got_ == want


def test_no_edges(spark):
    none = spark.createDataFrame([], EDGE + ", seq long")
    assert graph.levels(none).count() == 0 and graph.closing_edges(none).count() == 0


def plain_bootstrap(means, iterations):
    n = len(means)
    draws = sampling._draws(np.arange(1, iterations * n + 1))
    at = lambda b, t: sum(means[int(draws[b * n + i] * n)][t] for i in range(n)) / n
    tiers = [[at(b, t) for b in range(iterations)] for t in range(4)]
    pick = lambda v, p: sorted(v)[int(p * (iterations - 1))]
    delta = [a - b for a, b in zip(tiers[3], tiers[0])]
    return {"T4": (pick(tiers[3], 0.025), pick(tiers[3], 0.975)), "T4-T1": (pick(delta, 0.025), pick(delta, 0.975))}


def test_bootstrap_by_blocks_of_clusters(spark, monkeypatch):
    """By groups, with blocks far smaller than the groups; a group of one has no interval."""
    rng = random.Random(3)
    rows = [(g, i, *(float(rng.random() < 0.5) for _ in range(4))) for g, n in ((0, 40), (1, 25), (2, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "kind long, seg_id long, T1 double, T2 double, T3 double, T4 double")
    for block in (sampling.CLUSTER_BLOCK, 7):
        monkeypatch.setattr(sampling, "CLUSTER_BLOCK", block)
        found = {(r["kind"], r["metric"]): (r["lower"], r["upper"]) for r in sampling.paired_bootstrap(df, 130, by="kind").collect()}
        assert {k for k, _ in found} == {0, 1}
        for g in (0, 1):
            for metric, want in plain_bootstrap([r[2:] for r in rows if r[0] == g], 130).items():
                assert found[g, metric] == pytest.approx(want, abs=1e-9)


def test_draws_are_those_of_the_columns(spark):
    k = [1, 2, 3, 1000, 10**6, 2**32 - 1, 2**32 + 5, 10**12]
    rows = spark.createDataFrame([(x,) for x in k], "k long").select("k", sampling.draw(F.col("k")).alias("u")).collect()
    assert {r["k"]: r["u"] for r in rows} == dict(zip(k, sampling._draws(np.array(k)).tolist()))


def test_statistics_gate_fails_on_a_false_interval(spark):
    rows = [("paired-cluster", 5, 5, 1.0, 1.0, 0.5, 1.5, 0.5, 1.5), ("paired-cluster", 5, 5, 1.0, 1.0, 0.5, 1.6, 0.5, 1.5), ("paired-cluster", 5, 5, 1.0, 1.0, 0.5, 1.5, None, None)]
    df = spark.createDataFrame(rows, "method string, stated long, clusters long, score double, derived double, lower double, upper double, low double, high double")
    assert {r["check"]: r["n_bad"] for r in gates.report(df, gates.statistics()).collect()} == {"method is paired": 0, "clusters agree": 0, "score is derived": 0, "interval in order": 0, "interval agrees": 2}


def test_long_walks_before_the_first_loop(spark, tmp_path):
    """the SQL looked at a graph's first forty edges only."""
    import json

    from memlift.plans import graph_plans
    from memlift.plans.registry import ORACLE_SQL
    from tests.oracle import spark_rows, sql_rows

    import duckdb

    walks = {1: [*range(60), 5, 6], 2: [1, 2, 1, 2], 3: list(range(45)), 4: [7, 7, 8, None, 7, 9, 7], 5: [3, 4, None, 4, 3, 4]}
    rows = [(100 * u + i, u, json.dumps({"k": k} if k is not None else {})) for u, walk in walks.items() for i, k in enumerate(walk)]
    spark.createDataFrame(rows, "event_id long, user_id long, props string").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = spark_rows(graph_plans.gr1_cycles_whole(spark, str(tmp_path)))
    assert got == sql_rows(con, ORACLE_SQL["gr1_cycles_whole"])
    assert ("closing", "g") == tuple(got[0]) and repr((159, 1)) in got[1] and len(got[1]) == 4
