import hashlib
import math
import random

import numpy as np

from prismrank.llm import codebooks

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string"
HUGE = float(np.float32(3e38))


def expected(rows, parts=16, entries=64, rounds=2):
    kept = [(i, label, [math.floor(256 * int(x)) if abs(x) > 1e9 else math.floor(256 * float(x)) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = -(-max(len(q) for *_, q in kept) // parts)
    kept = [(i, label, q + [0] * (width * parts - len(q))) for i, label, q in kept]
    first = {}
    for i, _, q in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2])):
        first.setdefault(i, q)
    first = list(first.values())[:entries]
    cut = lambda q, p: q[p * width : (p + 1) * width]
    books = [[cut(q, p) for q in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            of = [near(cut(q, p), books[p])[1] for *_, q in kept]
            for e in range(len(first)):
                if own := [cut(q, p) for (*_, q), o in zip(kept, of) if o == e]:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)] if width else []
    clip = lambda x: min(x, (1 << 63) - 1)
    best = [(i, label, [near(cut(q, p), books[p]) for p in range(parts)]) for i, label, q in kept]
    done = [(i, label, "".join(f"{k:02x}" for _, k in b), clip(sum(d for d, _ in b))) for i, label, b in best]
    name = hashlib.sha256(",".join(str(v) for book in books for e in book for v in e).encode()).hexdigest()
    return sorted(((i, c, d, clip(sum(y for _, k, _, y in done if k == label)), name) for i, label, c, d in done), key=repr)


def check(spark, rows, parts=3):
    frame = spark.createDataFrame([(i, v, label, "clash", "clash") for i, v, label in rows], SCHEMA).repartition(parts)
    got = codebooks.embeddings_digest(frame)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)


def test_digest_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [float(np.float32(rng.gauss(0, 0.3))) for _ in range(32)], rng.choice([0, 1, 1, 1, None])) for i in range(150, 0, -1)]
    rows += [(300, None, 1), (301, [None] * 32, 1), (302, [float("nan")] + [0.0] * 31, 0), (303, [float("inf")] * 32, None), (304, [0.5] * 32, 7), (None, [0.1] * 32, None)]
    check(spark, rows + [rows[149]] * 30 + [(2, [-1.0] * 32, 2), (2, [-2.0] * 32, 2)])


def test_lengths_differ_and_are_padded(spark):
    check(spark, [(i, [0.01 * ((i * k) % 7) for k in range(n)], 0) for i, n in enumerate([64, 20, 0, 33, 64, 1])])


def test_huge_components_are_exact_and_clipped(spark):
    check(spark, [(i, [float(np.float32(1e5 * (i % 3) + i))] * 16, i % 2) for i in range(70)] + [(90, [HUGE] * 16, 0), (91, [-HUGE] * 16, 1)])


def test_one_vector_empty_vectors_and_none(spark):
    check(spark, [(5, [0.25] * 16, None)], 1)
    check(spark, [(5, [], 1), (6, [], 1)], 1)
    check(spark, [(5, None, 1)], 1)
    check(spark, [], 1)
