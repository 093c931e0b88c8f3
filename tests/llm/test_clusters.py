"""Centroid clustering against a plain version with whole numbers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import clusters

VECTORS = "vec_id long, embedding array<float>, label int, cluster string, n string"


def plain(rows, k, rounds, dim):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    c = [v for _, v in sorted(kept, key=key)[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min(range(len(c)), key=lambda j: (dist(v, c[j]), j))
    for _ in range(rounds):
        own = [near(v) for _, v in kept]
        c = [[sum(col) // len(mine) for col in zip(*mine)] if (mine := [v for (_, v), o in zip(kept, own) if o == j]) else c[j] for j in range(len(c))]
    out = [(i, near(v), dist(v, c[near(v)])) for i, v in kept]
    by = {j: sum(d for _, o, d in out if o == j) for j in range(len(c))}
    return sorted(((i, o, d, by[o], sum(by.values()), hashlib.sha256(",".join(map(str, c[o])).encode()).hexdigest()) for i, o, d in out), key=str)


def found(spark, rows, k, rounds, dim, **more):
    df = spark.createDataFrame([(i, v, 0, "clash", "clash") for i, v in rows], VECTORS).repartition(3)
    return sorted(map(tuple, clusters.centroid_clusters(df, clusters=k, rounds=rounds, dimensions=dim, **more).drop("centroid").collect()), key=str)


def test_clusters_against_plain(spark):
    rng = np.random.default_rng(5)
    for dim, k, spread in ((2, 4, 0.05), (5, 8, 0.4), (3, 1, 1.0)):
        middle = rng.normal(size=(6, dim))
        rows = [(i, (middle[i % 6] + spread * rng.normal(size=dim)).astype(np.float32).tolist()) for i in range(400)]
        rows += [(1000 + i, rows[7][1]) for i in range(60)]  # one vector many times
        assert found(spark, rows, k, 6, dim, most=50, leaf=4) == plain(rows, k, 6, dim)


def test_clusters_ties(spark):
    grid = [(i, [float(i % 4) / 2, float(i // 4 % 4) / 2]) for i in range(48)]
    assert found(spark, grid, 8, 5, 2, most=16, leaf=2) == plain(grid, 8, 5, 2)


def test_clusters_odd(spark):
    v = [0.5, -0.25, 1.0]
    rows = [(1, v), (1, v), (None, v), (None, [9.0, 9.0, 9.0]), (2, None), (3, []), (4, [1.0, 2.0]), (5, [1.0, None, 2.0]), (6, [1.0, float("nan"), 2.0]), (7, [1.0, float("inf"), 2.0]), (8, [0.0, 0.0, 0.0])]
    assert found(spark, rows, 3, 4, 3) == plain(rows, 3, 4, 3)
    assert found(spark, rows[:2], 8, 4, 3) == plain(rows[:2], 8, 4, 3)  # fewer vectors than clusters
    assert found(spark, rows[4:10], 8, 4, 3) == []
    with pytest.raises(Exception, match="beyond"):
        found(spark, [(1, [1e30, 0.0, 0.0])], 1, 1, 3)


def test_filtering_prunes(spark):
    """Of well parted vectors few are compared one by one: nodes are assigned whole."""
    rng = np.random.default_rng(1)
    c = np.array([[0, 0], [10_000, 0], [0, 10_000]])
    x = (c[rng.integers(0, 3, 3000)] + rng.integers(-50, 50, (3000, 2))).astype(np.int64)
    order, t = clusters.tree(x)

    class Seen(np.ndarray):
        read = 0

        def __getitem__(self, i):
            Seen.read += len(i)
            return np.asarray(self)[i]

    t["points"] = x[order].view(Seen)
    count, sums, _ = clusters.filtered(t, c)
    near = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
    assert count.tolist() == np.bincount(near, minlength=3).tolist() and sums.tolist() == [x[near == j].sum(0).tolist() for j in range(3)]
    assert Seen.read < 100


def test_bound_holds():
    a = np.full((1, 64), clusters.BOUND, np.int64)
    off = 2 * a + 2 * a
    assert (off.astype(object) ** 2).sum() < 1 << 63


def test_whole_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 0, "a", "b")], VECTORS)
    assert clusters._whole(df, "vec_id", "embedding", 2).where(F.col("vec_id") == 1).count() == 1
