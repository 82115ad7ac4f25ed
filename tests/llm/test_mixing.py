import hashlib
import re
from fractions import Fraction

import pytest

from prismrank.llm import mixing

SCHEMA = "doc_id long, text string, source string, size long, target string, h int"


def rows():
    out = [(i, " ".join(["w"] * (i % 37)), ["b", "a", None, "é", "tiny"][i % 5] if i % 3 else "hot") for i in range(600) if i % 5 != 4 or i < 20]
    return out + [(None, "x y", "a"), (None, None, None), (7, "same\tid", "hot"), (7, "same\tid", "hot"), (5000, "", "zero")]


def targets(sizes, weights, most):
    """Rounds of clamping and proportional redistribution, in fractions."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    clamped = set()
    while True:
        free = [s for s in names if s not in clamped]
        left = sum(sizes.values()) - sum(most * sizes[s] for s in clamped)
        share = {s: Fraction(left * w[s], sum(w[x] for x in free)) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return share | {s: Fraction(most * sizes[s]) for s in clamped}
        clamped |= over


def expected(data, bits=None):
    docs = [(i, s, len(re.findall(mixing.WORD, t or "")), int(hashlib.md5(f"17:{'null' if i is None else i}".encode()).hexdigest()[:15], 16)) for i, t, s in data]
    sizes = {}
    for _, s, n, _ in docs:
        sizes[s] = sizes.get(s, 0) + n
    goal = targets(sizes, mixing.WEIGHTS, mixing.MAX_EPOCHS)
    out, used = [], dict.fromkeys(sizes, 0)
    for i, s, n, h in sorted(docs, key=lambda d: (d[3], d[0] is not None, d[0], d[2])):
        whole = goal[s] // sizes[s] if sizes[s] else 0
        left = int(goal[s] - whole * sizes[s])
        out.append((i, n, sizes[s], pytest.approx(float(goal[s])), whole * n + max(0, min(n, left - used[s]))))
        used[s] += n
    return sorted(out, key=lambda r: (str(r[0]), r[1], r[2], r[4]))


def test_digest_equals_brute_force(spark):
    data = rows()
    docs = spark.createDataFrame([(i, t, s, 1, "clash", 2) for i, t, s in data], SCHEMA)
    want = expected(data)
    for k in (1, 5):
        got = sorted(map(tuple, mixing.documents_digest(docs.repartition(k)).collect()), key=lambda r: (str(r[0]), r[1], r[2], r[4]))
        assert got == want
    assert all(r[4] <= 3 * r[1] for r in want)
    taken = {}
    for r in want:
        taken[r[2]] = taken.get(r[2], 0) + r[4]
    assert {k: v for k, v in taken.items()} == {r[2]: int(r[3].expected) for r in want}


def test_repeated_documents_keep_their_columns(spark):
    data = rows()
    docs = spark.createDataFrame([(i, t, s, 1, "clash", 2) for i, t, s in data], SCHEMA)
    out = mixing.repeat_documents(docs)
    assert out.columns == docs.columns
    plan = {}
    for r in mixing.mix(docs).collect():
        n = r.epochs + (r.extra > 0 and 2 * r.extra >= r["size"])
        plan[r.doc_id, r.source] = plan.get((r.doc_id, r.source), 0) + n
    got = {}
    for r in out.collect():
        got[r.doc_id, r.source] = got.get((r.doc_id, r.source), 0) + 1
    assert got == {k: n for k, n in plan.items() if n}


def test_empty_and_all_zero(spark):
    assert mixing.documents_digest(spark.createDataFrame([], SCHEMA)).count() == 0
    zero = spark.createDataFrame([(1, "", "a", 1, "", 1), (2, None, "b", 1, "", 1)], SCHEMA)
    assert sorted(map(tuple, mixing.documents_digest(zero).collect())) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
