"""Nearest vectors by cells against all compared with all."""

import numpy as np
import pytest

from memlift.operators import vectors

SCHEMA = "item_id long, v array<float>"


def plain(items, asked, k):
    out = {}
    unit = lambda v: np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64))
    sound = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
    x = [(i, unit(v)) for i, v in items if i is not None and sound(v)]
    for q, v in asked:
        if q is not None and sound(v):
            scores = sorted((-round(float(unit(v) @ w), 6), i) for i, w in x if i != q)[:k]
            out[q] = [(i, -s) for s, i in scores]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["q_id"], r["rank"])):
        out.setdefault(r["q_id"], []).append((r["item_id"], r["score"]))
    return out


@pytest.mark.parametrize("block", [vectors.BLOCK_ITEMS, 50])
def test_equals_all_compared(spark, monkeypatch, block):
    """Clusters, a third of equal vectors, vectors without a direction; with small blocks hot cells are split."""
    monkeypatch.setattr(vectors, "BLOCK_ITEMS", block)
    monkeypatch.setattr(vectors, "BLOCK_QUESTIONS", block)
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((20, 16))
    items = [(i, [float(x) for x in (centres[i % 20] + 0.2 * rng.standard_normal(16)).astype(np.float32)]) for i in range(600)]
    items += [(1000 + i, items[0][1]) for i in range(300)] + [(2000, [0.0] * 16), (2001, None), (2002, [None] * 16), (2003, [float("nan")] * 16), (None, items[1][1])]
    asked = [r for r in items if r[0] is None or r[0] % 7 == 0 or r[0] >= 1990] + [(-1, [float(x) for x in -centres[3].astype(np.float32)])]
    got = found(vectors.nearest(spark.createDataFrame(items, SCHEMA), spark.createDataFrame(asked, "q_id long, v array<float>"), 6))
    want = plain(items, asked, 6)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]])


def test_few_and_no_items(spark):
    one = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], SCHEMA)
    asked = spark.createDataFrame([(1, [1.0, 1.0]), (9, [1.0, 1.0])], "q_id long, v array<float>")
    assert found(vectors.nearest(one, asked, 5)) == {1: [(2, 0.707107)], 9: [(1, 0.707107), (2, 0.707107)]}
    assert vectors.nearest(one.limit(0), asked, 5).count() == 0
    assert vectors.nearest(one, asked.limit(0), 5).count() == 0


def test_few_rows_at_once(spark, monkeypatch):
    """a task's Python held a row for each cell of a whole batch of questions, and the scores of a whole block."""
    import numpy as np

    rng = np.random.default_rng(3)
    v = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    items, asked = spark.createDataFrame(v, "item_id long, v array<double>"), spark.createDataFrame(v[:40], "q_id long, v array<double>")
    whole = sorted(tuple(r) for r in vectors.nearest(items, asked, 4).collect())
    monkeypatch.setattr(vectors, "SCORED", 3)
    monkeypatch.setattr(vectors, "SENT_ROWS", 5)
    assert sorted(tuple(r) for r in vectors.nearest(items, asked, 4).collect()) == whole and len(whole) == 160
    parts = []
    real = vectors.np.round
    monkeypatch.setattr(vectors.np, "round", lambda x, n: parts.append(len(x)) or real(x, n))
    import pandas as pd

    frame = lambda key: pd.DataFrame({key: [i for i, _ in v], "v": [np.array(x) for _, x in v]})
    vectors._block_best(4)(frame("item_id"), frame("q_id"))
    assert max(parts) == 3
