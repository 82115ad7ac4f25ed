import hashlib
import math
import random

import numpy as np

from prismrank.llm import kmeans

SCHEMA = "vec_id long, embedding array<float>, cluster int, distance string, q int"
HUGE = float(np.float32(3e38))


def expected(rows, k=16, rounds=3, width=64):
    """Plain clustering with Python's integers."""
    kept = [(i, [math.floor(64 * int(x)) if abs(x) > 1e9 else math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [q for _, q in sorted(kept, key=key)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda q: min((far(q, c), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        of = [near(q)[1] for _, q in kept]
        for c in range(len(centroids)):
            if own := [q for (_, q), o in zip(kept, of) if o == c]:
                centroids[c] = [sum(x) // len(own) for x in zip(*own)]
    best = [(i, *near(q)) for i, q in kept]
    clip = lambda x: min(x, (1 << 63) - 1)
    total = lambda c=None: clip(sum(clip(d) for _, d, o in best if c in (None, o)))
    name = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    return sorted(((i, o, clip(d), total(o), total(), name(o)) for i, d, o in best), key=repr)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 9, "clash", 1) for i, v in rows], SCHEMA).repartition(parts)


def cases(seed):
    rng = random.Random(seed)
    middle = [[rng.gauss(0, 0.4) for _ in range(64)] for _ in range(9)]
    rows = [(i, [float(np.float32(m + rng.gauss(0, 0.15))) for m in middle[i % 9]]) for i in range(240)]
    rows += [(500, None), (501, [None] + [0.1] * 63), (502, [float("nan")] * 64), (503, [float("-inf")] * 64), (504, [0.5] * 63), (505, []), (None, [0.25] * 64), (None, [-0.25] * 64)]
    return rows + [rows[3]] * 40 + [rows[11], (3, [-0.0] * 64), (600, [0.0] * 64), (601, [0.0] * 64)]


def test_digest_equals_brute_force(spark):
    rows = cases(1)
    got = kmeans.embeddings_digest(frame(spark, rows))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)


def test_huge_components_are_exact_and_clipped(spark):
    rows = [(i, [float(np.float32(1e6 * (i % 7) + i))] * 64) for i in range(30)] + [(90, [HUGE] * 64), (91, [-HUGE] * 64), (92, [HUGE] * 63 + [1.0])]
    got = kmeans.embeddings_digest(frame(spark, rows))
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)


def test_few_vectors_equal_vectors_and_none(spark):
    for rows in ([(1, [0.5] * 64)], [(i, [0.125] * 64) for i in range(40)], [(1, None), (2, [1.0])], []):
        got = kmeans.embeddings_digest(frame(spark, rows, 1))
        assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)


def test_bounds_hold_and_spare_scans():
    rng = np.random.default_rng(5)
    middle = rng.integers(-60, 60, (16, 64))
    x = middle[rng.integers(0, 16, 4000)] + rng.integers(-9, 10, (4000, 64))
    before = middle.tolist()
    now = (middle + rng.integers(-1, 2, middle.shape)).tolist()
    cluster, upper, lower = kmeans.Centroids(before).scan(x)
    cluster, upper, lower, scanned = kmeans.Centroids(now, before).reassign(x, cluster, upper, lower)
    d = np.sqrt(((x[:, None] - np.array(now)[None]) ** 2).sum(2))
    rest = d.copy()
    rest[np.arange(len(x)), cluster] = np.inf
    assert (cluster == d.argmin(1)).all() and (upper >= d.min(1)).all() and (lower <= rest.min(1)).all()
    assert scanned < 400


def test_ties_take_the_smaller_number():
    x = np.array([[0, 0], [2, 0], [1, 5]])
    cluster, upper, lower = kmeans.Centroids([[1, 0], [-1, 0], [3, 0]]).scan(x)
    assert cluster.tolist() == [0, 0, 0]
    moved = kmeans.Centroids([[-1, 0], [1, 0], [3, 0]], [[1, 0], [-1, 0], [3, 0]])
    assert moved.reassign(x, cluster, upper, lower)[0].tolist() == [0, 1, 1]
