import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import centroids


def brute(rows, k, rounds, dim, scale, seed):
    """Every vector against every centroid, in plain whole numbers."""
    fine = lambda v: v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)
    some = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if fine(v)]
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    now = [x for _, _, x in sorted((name(i), n, x) for n, (i, x) in enumerate(sorted(some, key=lambda r: r[1])))][:k]
    for r in range(rounds + 1):
        at = [min((sum((p - q) ** 2 for p, q in zip(x, c)), n) for n, c in enumerate(now)) for _, x in some]
        if r < rounds:
            for n in range(len(now)):
                own = [x for (_, x), (_, m) in zip(some, at) if m == n]
                now[n] = [sum(col) // len(own) for col in zip(*own)] if own else now[n]
    inertia = {}
    for d, n in at:
        inertia[n] = inertia.get(n, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return [(i, n, d, inertia[n], sum(inertia.values()), digest[n]) for (i, _), (d, n) in zip(some, at)]


def key(r):
    return tuple((x is None, x or 0) for x in r)


def check(spark, rows, **s):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("x")).withColumn("x", F.lit(1))
    got = [tuple(r) for r in centroids.report(df, **s).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, **s), key=key)
    return df


def test_ties_repeats_and_odd_rows(spark):
    r = random.Random(3)
    grid = [(i, [float(r.randrange(4)), float(r.randrange(4))]) for i in range(300)]  # many equal distances
    odd = [(1000, None), (1001, []), (1002, [1.0]), (1003, [None, 1.0]), (1004, [math.nan, 0.0]), (1005, [math.inf, 0.0]), (1006, [1.0, 2.0, 3.0]), (None, [1.0, 2.0]), (None, [2.0, 1.0]), (7, [0.5, -0.25]), (7, [0.5, -0.25])]
    check(spark, grid + odd + [(5000, [1.0, 1.0])] * 400, k=7, rounds=3, dim=2, scale=2, seed=1)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_rows(spark, n):
    df = check(spark, [(i, [float(i), -1.0]) for i in range(n)], k=16, rounds=3, dim=2, scale=64, seed=1)
    assert centroids.report(df, dim=2).count() == n


def test_bounds_prune_and_stay_exact(spark):
    r = np.random.default_rng(0)
    heart = r.normal(size=(40, 8)) * 20
    rows = [(i, (heart[i % 40] + r.normal(size=8)).tolist()) for i in range(6000)]
    s = dict(k=40, rounds=4, dim=8, scale=64, seed=2)
    df = check(spark, rows, **s)
    _, _, scanned = centroids.cluster(df, **s)
    assert scanned < 0.35 * 5 * 6000 * 40


def test_search_equals_all_distances():
    r = np.random.default_rng(1)
    for dim, top in ((1, 3), (2, 5), (16, 300), (64, 1 << 27)):
        x, now = r.integers(-top, top, (500, dim)), r.integers(-top, top, (12, dim))
        now[5] = now[2]
        a, u, low = np.zeros(500, np.int64), np.full(500, np.inf), np.zeros(500)
        before = None
        for _ in range(5):
            a, u, low, _ = centroids.search(x, a, u, low, centroids.Ball(now, before))
            d = centroids.squares(x[:, None], now[None])
            assert (a == d.argmin(1)).all() and (u**2 >= d.min(1)).all()
            before, now = now, np.array([x[a == c].sum(0) // max(1, (a == c).sum()) if (a == c).any() else now[c] for c in range(12)])


def test_too_large_components_take_no_part(spark):
    rows = [(1, [1e30, 0.0]), (2, [1.0, 2.0]), (3, [-3e18, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [x.vec_id for x in centroids.report(df, dim=2).collect()] == [2]
