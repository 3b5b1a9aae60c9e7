"""Hard negatives against plain integer products; bounds never leave a row out."""

import numpy as np
from lyceum.llm import hard_negatives as hn
from pyspark.sql import functions as F


def plain(rows, positives=5, negatives=10, low=30, high=90, every=100):
    seen = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        whole = [int(np.floor(256 * float(x))) for x in v]
        seen[i] = min(seen.get(i, (label, whole)), (label, whole))
    out = []
    for a, (label, q) in seen.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(q, w)) for i, (_, w) in seen.items() if i != a and len(w) == len(q)}
        near = sorted((-s, i) for i, s in score.items() if seen[i][0] == label)[:positives]
        for minus, p in near:
            inside = sorted((-s, i) for i, s in score.items() if seen[i][0] != label and -low * minus <= 100 * s <= -high * minus)[:negatives]
            out += [(a, p, k, i, -minus, -s) for k, (s, i) in enumerate(inside, 1)]
    return sorted(out)


def ours(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, score int, v string")
    return sorted(tuple(r) for r in hn.mine(df, F.col("vec_id") % 100 == 0, **more).collect())


def made(n, dim, seed, spread=0.5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    return [(int(i), (centres[i % 8] + spread * rng.normal(size=dim)).astype(np.float32).tolist(), int(rng.integers(0, 3))) for i in range(n)]


def test_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(hn, "LEAST_SHARD", 128)
    monkeypatch.setattr(hn, "BLOCK", 4)
    rows = made(1500, 16, 1)
    assert ours(spark, rows) == plain(rows)


def test_other_windows_and_numbers(spark):
    rows = made(700, 7, 2, spread=2.0)
    assert ours(spark, rows, positives=2, negatives=3, low=-50, high=60) == [r for r in plain(rows, 2, 3, -50, 60) if r[4] >= 0]


def test_edges(spark):
    v = [1.0, 0.5]
    rows = [(0, v, 1), (100, v, 1), (100, v, 2), (1, v, 1), (2, [0.4, 0.2], 2), (3, [0.4, 0.2], 2), (4, None, 2), (5, v, None), (6, [1.0, None], 2), (7, [float("nan"), 1.0], 2), (8, [float("inf"), 1.0], 2)]
    rows += [(9, [], 2), (None, v, 2), (10, [1.0], 2), (11, [0.0, 0.0], 2), (200, [0.0, 0.0], 2), (12, [0.4, 0.2], 2), (300, [-1.0, -1.0], 3), (13, [1.0, 1.0], 3)]
    assert ours(spark, rows) == plain(rows)
    assert ours(spark, []) == []


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**20 + 3 * i), float(2**19 + i)], i % 2) for i in range(0, 202, 2)] + [(1, [2.0**18, 1.0], 1)]
    assert ours(spark, rows) == plain(rows)


def test_bounds_hold():
    rng = np.random.default_rng(4)
    x = np.floor(256 * rng.normal(size=(3000, 24)))
    codes = hn.Codes(x[:500])
    q = x[:50]
    low, high = codes.bounds(q, *codes.encode(x), np.full(50, 1e-6))
    exact = q @ x.T
    assert (low <= exact).all() and (exact <= high).all()
    assert (high - low).mean() < 2 * np.sqrt((q**2).sum(1)).mean() * np.sqrt((x**2).sum(1)).mean() * 0.7  # and say something
