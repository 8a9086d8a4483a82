import math
import random

import numpy as np
import pytest

from plansift.llm import knn


def brute(rows, k, every):
    fine = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and i is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in fine:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in fine if i != q and len(w) == len(v))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("n", [0, 1, 2, 4, 260])
def test_against_brute_force(spark, monkeypatch, n):
    monkeypatch.setattr(knn, "SHARD", 50)
    monkeypatch.setattr(knn, "LEAF", 4)
    monkeypatch.setattr(knn, "BLOCK", 3)
    monkeypatch.setattr(knn, "PACK", 2)
    monkeypatch.setattr(knn, "SAMPLE", 64)
    rng = random.Random(n)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.1, rng.gauss(0, 1)]) for _ in range(6)]) for i in range(n)]
    if n > 100:
        rows += [(300 + i, rows[10][1]) for i in range(30)]  # ties
        rows += [(1000, None), (1010, [float("nan")] * 6), (1020, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1030, [float("inf")] + [0.0] * 5), (None, rows[0][1]), (1040, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' as key", "1 as shard")
    found = sorted(tuple(r) for r in knn.top_k(df, k=5, every=10).collect())
    assert found == brute(rows, 5, 10)


def test_empty_vectors_and_a_vector_that_many_rows_share(spark, monkeypatch):
    monkeypatch.setattr(knn, "SHARD", 32)
    monkeypatch.setattr(knn, "SAMPLE", 300)
    rng = random.Random(9)
    rows = [(i, []) for i in range(100)] + [(100 + i, [0.5, -0.25, 0.125]) for i in range(150)] + [(300 + i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(150)]
    found = sorted(tuple(r) for r in knn.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert found == brute(rows, 5, 50)


def test_no_join_meets_on_one_key(spark, monkeypatch):
    monkeypatch.setattr(knn, "SHARD", 20)
    monkeypatch.setattr(knn, "SAMPLE", 64)
    rng = random.Random(1)
    df = spark.createDataFrame([(i, [rng.gauss(3 * (i % 2), 1), 1.0]) for i in range(400)], "vec_id long, embedding array<float>")
    plan = knn.top_k(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_tree_prunes_but_finds_all():
    rng = np.random.default_rng(0)
    vectors = rng.integers(-100, 100, (1000, 5)).astype(float)
    tree = knn.Tree(np.arange(1000), vectors.copy())
    for q, found in zip(vectors[:20], tree.search(vectors[:20], np.arange(20), 3, np.full(20, -np.inf)), strict=True):
        scores = vectors @ q
        own = int(np.flatnonzero((vectors == q).all(axis=1))[0])
        want = sorted(((-s, i) for i, s in enumerate(scores.tolist()) if i != own))[:3]
        assert found == [(-s, i) for s, i in want]
    assert tree.seen < 20 * 1000
