import hashlib
import math
import random

import numpy as np

from boxmill.llm import bit_planes


def exact(x):
    top, bottom = float(x).as_integer_ratio()
    return top * 1024 // bottom


def slow(rows, clusters=8, rounds=10, seed=3):
    """``vec_id, cluster, distance`` by plain integer arithmetic, and the centroids."""
    kept = [(i, [exact(x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    drawn = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest()))
    centroids = [v for _, v in drawn[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))

    for _ in range(rounds if centroids else 0):
        own = {}
        for _, v in kept:
            own.setdefault(nearest(v)[1], []).append(v)
        for k, vectors in own.items():
            centroids[k] = [sum(x) // len(vectors) for x in zip(*vectors)]
    return [(i, nearest(v)[1], min(nearest(v)[0], (1 << 63) - 1)) for i, v in kept], centroids


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)


def ours(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def check(spark, rows, kind="float", **more):
    found, centroids = bit_planes.clustered(frame(spark, rows, kind), **more)
    expected, own = slow(rows, **more)
    assert centroids == own
    assert found.columns == ["vec_id", "cluster", "distance"]
    assert ours(found) == sorted(expected, key=repr)
    inertia = bit_planes.with_inertia(found, centroids).collect()
    sums = {}
    for _, k, d in expected:
        sums[k] = sums.get(k, 0) + d
    for r in inertia:
        assert r["cluster_inertia"] == min(sums[r["cluster"]], (1 << 63) - 1)
        assert r["inertia"] == min(sum(sums.values()), (1 << 63) - 1)
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, own[r["cluster"]])).encode()).hexdigest()


def singles(rng, n, size=0.3):
    return [(i, [float(np.float32(rng.gauss(0, size))) for _ in range(64)]) for i in range(n)]


def test_dot_products_by_popcount():
    rng = np.random.default_rng(1)
    for size in (1, 2, 700, 1 << 26):
        left, right = rng.integers(-size, size, (50, 64)), rng.integers(-size, size, (9, 64))
        planes = [bit_planes.planes_of(v, int(bit_planes.plane_count(v).max())) for v in (left, right)]
        assert (bit_planes.dot_products(*planes) == left @ right.T).all()
        assert bit_planes.vectors_of(planes[0]) == left.tolist()


def test_equals_brute_force_with_a_hot_vector(spark):
    rng = random.Random(4)
    rows = singles(rng, 200) + [(1000 + i, singles(random.Random(9), 1)[0][1]) for i in range(100)]
    check(spark, rows)


def test_more_clusters_than_vectors_and_one_cluster(spark):
    rows = singles(random.Random(5), 5)
    check(spark, rows)
    check(spark, rows, clusters=1, rounds=2)


def test_large_components_stay_exact(spark):
    """Components beyond 64 bits, and distances beyond a long."""
    rng = random.Random(6)
    rows = singles(rng, 12)
    rows += [(100, [1e6] * 64), (101, [-3e9] * 63 + [0.5]), (102, [1e300] + [0.1] * 63), (103, [-1e308] * 64), (104, [131071.9] * 64)]
    check(spark, rows, "double", rounds=3)


def test_ties_and_empty_centroids(spark):
    """Equal vectors: all go to the first of the equal centroids, the others keep their place."""
    check(spark, [(i, [0.25] * 64) for i in range(20)])
    check(spark, [(i, [0.25 * (i % 2)] * 64) for i in range(20)])


def test_awkward_rows(spark):
    good = singles(random.Random(7), 30)
    nan, inf = float("nan"), float("inf")
    odd = [(40, None), (41, []), (42, [0.5] * 63), (43, [0.5] * 65), (44, [None] + [0.5] * 63), (45, [nan] * 64), (46, [inf] + [0.0] * 63), (47, [-inf] * 64)]
    check(spark, good + odd + [(None, [0.5] * 64), (None, [0.5] * 64)] + good[:3])
    empty, centroids = bit_planes.clustered(frame(spark, []))
    assert centroids == [] and bit_planes.with_inertia(empty, centroids).count() == 0
    assert bit_planes.with_inertia(*bit_planes.clustered(frame(spark, odd))).count() == 0
    from pyspark.sql import functions as F

    df = frame(spark, good).select("*", *(F.lit("own").alias(c) for c in "cluster distance planes norm n ones label".split()))
    assert ours(bit_planes.clustered(df)[0]) == sorted(slow(good)[0], key=repr)
