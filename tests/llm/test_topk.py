import math
import random

import numpy as np

from prismrank.llm import topk

SCHEMA = "vec_id long, embedding array<float>, q int, shard string"


def expected(rows, k, every):
    fine = [(i, [math.floor(64 * float(x)) for x in np.array(v, np.float32)]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for own, a in {(i, tuple(v)) for i, v in fine if i % every == 0}:
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in fine if i != own)[:k]
        out += [(own, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def rows(rng, n, width):
    return [(i, [rng.gauss(0, 0.125) for _ in range(width)]) for i in range(n)]


def test_digest_equals_brute_force(spark):
    rng = random.Random(2)
    data = rows(rng, 130, 12) + [(200, None), (220, [1.0, None]), (240, [float("nan")] * 12), (260, [float("inf")] * 12), (None, [1.0] * 12), (280, []), (300, [0.5] * 5), (320, [-0.0] * 12), (340, [-1e-20] * 12)]
    data += [(7, [0.1] * 12)] * 3 + [(40, data[40][1])] + [(60, [0.25] * 12)]
    frame = spark.createDataFrame([(i, v, 1, "clash") for i, v in data], SCHEMA).repartition(3)
    assert sorted(map(tuple, topk.embeddings_digest(frame).collect())) == expected(data, 20, 20)
    small = topk.top_k(frame, 4, 7, shard_rows=16, block_rows=5)
    assert sorted(map(tuple, small.collect())) == expected(data, 4, 7)


def test_huge_components_are_exact():
    import pyarrow as pa

    q = pa.table({"vec_id": [0], "query_key": [1], "q": [[2.0**40, -1.0]]})
    r = pa.table({"vec_id": [1, 2, 3, 4], "q": [[2.0**20, 5.0], [2.0**20, 4.0], [2.0**60, 0.0], [-(2.0**60), 0.0]]})
    got = topk._search(q, r, 2)
    assert got["vec_id"].to_pylist() == [3, 2] and got["score"].to_pylist() == [(1 << 63) - 1, 2**60 - 4]
    assert topk._search(q, r, 4)["score"].to_pylist()[-1] == -(1 << 63)


def test_rows_that_are_repeated_very_often(spark):
    rng = random.Random(4)
    data = rows(rng, 40, 6) + [(41, [0.3] * 6)] * 300 + [(60, [0.2] * 6)] * 50
    frame = spark.createDataFrame([(i, v, 1, "clash") for i, v in data], SCHEMA).repartition(3)
    assert sorted(map(tuple, topk.top_k(frame, 5, 20, shard_rows=16, block_rows=2).collect())) == expected(data, 5, 20)


def test_large_numbers_keep_their_width(spark):
    data = [(i, [600.0 * i, -700.0, 0.5]) for i in range(25)]
    frame = spark.createDataFrame([(i, v, 1, "clash") for i, v in data], SCHEMA)
    assert sorted(map(tuple, topk.top_k(frame, 5, 20).collect())) == expected(data, 5, 20)


def test_bounds_prune_and_stay_exact():
    rng = np.random.default_rng(0)
    rows = np.floor(rng.normal(0, 8, (3000, 24)) * np.r_[np.full(4, 6), np.full(20, 0.4)])
    shard = topk.Shard(np.arange(3000), rows)
    for i in range(40):
        ids, score = shard.top(rows[i], i, 5)
        full = rows @ rows[i]
        full[i] = -np.inf
        best = np.lexsort((np.arange(3000), -full))[:5]
        assert ids.tolist() == best.tolist() and score.tolist() == full[best].tolist()


def test_empty(spark):
    assert topk.embeddings_digest(spark.createDataFrame([], SCHEMA)).count() == 0
