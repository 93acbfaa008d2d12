"""Centroid clustering against plain Lloyd rounds in Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from passagemill.llm import centroids


def slow_clusters(rows, count=40, rounds=5):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    means = [v for _, v in first[:count]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(means))

    for _ in range(rounds):
        found = [near(v)[1] for _, v in kept]
        for n in range(len(means)):
            some = [v for (_, v), f in zip(kept, found) if f == n]
            if some:
                means[n] = [sum(x) // len(some) for x in zip(*some)]
    out = [(i, *near(v)) for i, v in kept]
    total = sum(d for _, d, _ in out)
    inertia = {c: sum(d for _, d, k in out if k == c) for _, _, c in out}
    return [(i, c, d, inertia[c], total, hashlib.sha256(",".join(map(str, means[c])).encode()).hexdigest()) for i, d, c in out]


def vectors(rng, n, spread=0.2):
    return [[rng.gauss(0, spread) for _ in range(64)] for _ in range(n)]


SCHEMA = "vec_id long, embedding array<double>, cluster string, distance int, label int"


@pytest.mark.parametrize("scale", [1.0, 3e5])
def test_clusters_are_brute_force(spark, scale):
    rng = random.Random(11)
    rows = list(enumerate([[scale * x for x in v] for v in vectors(rng, 150)]))
    # Ties, copies, a hot vector, ids that repeat or are missing, and vectors that are left out.
    rows += [(200 + n, [scale * (n % 3)] * 64) for n in range(60)] + [(300 + n, rows[0][1]) for n in range(80)]
    rows += [(5, rows[7][1]), (5, rows[8][1]), (None, rows[9][1]), (None, rows[9][1]), rows[3], rows[3]]
    bad = [None, [], [1.0] * 63, [1.0] * 65, [1.0] * 63 + [None], [1.0] * 63 + [math.nan], [1.0] * 63 + [math.inf]]
    rows += [(400 + n, v) for n, v in enumerate(bad)]
    df = spark.createDataFrame([(*r, "x", 1, None) for r in rows], SCHEMA).repartition(7)
    got = centroids.cluster(df)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(slow_clusters(rows), key=key)


def test_few_and_no_vectors(spark):
    rows = [(n, v) for n, v in enumerate(vectors(random.Random(2), 3))] + [(None, [0.5] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    exact = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, centroids.cluster(df).collect()), key=key) == sorted(slow_clusters(exact), key=key)
    assert centroids.cluster(df.limit(0)).collect() == []


def test_an_overflow_is_no_wrong_answer(spark):
    rows = [(n, [10.0 ** 9 * (n + 1)] * 64) for n in range(2)] + [(9, [0.0] * 64)]
    with pytest.raises(Exception, match="(?i)overflow|too large|too big"):
        centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), count=1, rounds=0).collect()


def test_transform_is_exact_and_orthogonal():
    h = centroids.transform(np.eye(64, dtype=np.int64))
    assert (h @ h.T == 64 * np.eye(64, dtype=np.int64)).all()
    # Dyadic order: the first coefficients are signed sums over runs of 64, 32, 16 components.
    for k, run in ((0, 64), (1, 32), (2, 16), (3, 16), (7, 8), (63, 1)):
        assert all((h[at:at + run, k] == h[at, k]).all() for at in range(0, 64, run))


def test_search_eliminates_and_keeps_ties():
    rng = np.random.default_rng(3)
    steps = np.repeat(rng.integers(-250, 250, (200, 4)), 16, axis=1)
    means = np.r_[steps[:20], steps[:3]]
    found, distance, compared = centroids.nearest(centroids.transform(steps), centroids.transform(means))
    want = ((steps[:, None] - means[None]) ** 2).sum(axis=2)
    assert (found == want.argmin(axis=1)).all() and (distance == want.min(axis=1)).all()
    assert compared < want.size * 64 / 4
