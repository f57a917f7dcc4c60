import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxoweave.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, n=1500, dim=24, seed=0, step=1):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((12, dim))
    x = (centers[rng.integers(0, 12, n)] + 0.6 * rng.standard_normal((n, dim))).astype(np.float32)
    x /= np.sqrt((x * x).sum(1))[:, None]
    x[3] = x[4]  # ties
    return [(i * step, r.tolist(), 0) for i, r in enumerate(x)]


ODD = [(None, [1.0] * 24, 1), (10_000, None, 1), (10_050, [float("nan")] * 24, 1), (10_100, [float("inf")] + [0.0] * 23, 1), (10_150, [0.0] * 24, 1), (10_200, [0.5, None], 1), (10_250, [0.5] * 4, 1), (10_300, [], 1), (0, [9.0] * 24, 1)]


def usable(rows):
    best = {}
    for i, v, _ in rows:
        if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v):
            v = np.array(v, np.float32).astype(float).tolist()
            best[i] = min(best.get(i, v), v)
    ids = sorted(best)
    width = max(map(len, best.values()), default=0)
    return ids, np.array([best[i] + [0.0] * (width - len(best[i])) for i in ids])


def test_exact_top_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 64)  # many rings, blocks and batches
    monkeypatch.setattr(vectors, "TOGETHER", 16)
    rows = table(spark) + ODD
    ids, x = usable(rows)
    x = np.floor(256 * x).astype(int)
    want = []
    for i, q in zip(ids, x, strict=True):
        if i % 50 == 0:
            scored = sorted((-int(q @ c), j) for j, c in zip(ids, x, strict=True) if j != i)[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scored)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit("clash"))
    assert sorted(map(tuple, vectors.exact_top(df).select("query_id", "rank", "vec_id", "score").collect())) == sorted(want)


def test_bounds_hold():
    rng = np.random.default_rng(2)
    import pandas as pd

    pivots, x, q = np.floor(256 * rng.standard_normal((4, 8))), np.floor(256 * rng.standard_normal((500, 8))), np.floor(256 * rng.standard_normal((20, 8)))
    d = np.sqrt(((x[:, None] - pivots[None]) ** 2).sum(2))
    near = d.argmin(1)
    cells = pd.DataFrame([{"pivot": p, "lo": d[near == p, p].min(), "hi": d[near == p, p].max(), "norm": (x[near == p] ** 2).sum(1).max()} for p in range(4)])
    bound = vectors._bounds(q, pivots, cells)
    for p in range(4):
        assert ((q @ x[near == p].T).max(1) <= bound[:, p]).all()


def test_few_rows(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 0), (50, [1.0, 0.0], 0), (7, [0.0, 1.0], 0)], SCHEMA)
    assert sorted(map(tuple, vectors.exact_top(few).collect())) == [(0, 1, 50, 65536), (0, 2, 7, 0), (50, 1, 0, 65536), (50, 2, 7, 0)]
    got = sorted(map(tuple, vectors.nearest(few).collect()))
    assert [g[:3] for g in got] == [(0, 1, 50), (0, 2, 7), (50, 1, 0), (50, 2, 7)] and got[0][3] == pytest.approx(1)
    for f in (vectors.exact_top, vectors.nearest):
        assert f(few.limit(0)).count() == 0
    empty = spark.createDataFrame([(0, [], 0), (1, [], 0)], SCHEMA)
    assert [tuple(r) for r in vectors.exact_top(empty).collect()] == [(0, 1, 1, 0)] and vectors.nearest(empty).count() == 0


def test_recall_of_the_forest(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD", 400)
    rows = table(spark, 1500) + ODD
    ids, x = usable(rows)
    keep = (x != 0).any(axis=1)
    ids, x = np.array(ids)[keep], x[keep]
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    got = {}
    for r in vectors.nearest(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for i in ids[ids % 50 == 0]:
        cos = unit @ unit[np.flatnonzero(ids == i)[0]]
        cos[ids == i] = -9
        floor = np.sort(cos)[-5]
        found = sorted(got[i])
        assert [f[2] for f in found] == sorted((f[2] for f in found), reverse=True) and all(f[2] == pytest.approx(cos[np.flatnonzero(ids == f[1])[0]]) for f in found)
        hits += sum(f[2] >= floor - 1e-9 for f in found)
        total += 5
    assert hits / total >= 0.9
