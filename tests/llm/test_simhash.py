import random
from itertools import combinations

import numpy as np
import xxhash

from prismrank.llm import simhash
from prismrank.llm.components import components

SCHEMA = "doc_id long, text string, fp string, component_id int"


def slow_fingerprint(text, width=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({i: 32 for i in range(9, 14)}).split(" ")
    words = [w for w in words if w]
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows, bits=4):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if (rows[a][1] ^ rows[b][1]).bit_count() <= bits:
            parent[find(a)] = find(b)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return [low.get(find(i)) for i in range(len(rows))]


def test_any_four_positions_contain_a_set():
    sets = [set(t) for t in simhash.position_sets(4)]
    assert len(sets) == 20
    for four in combinations(range(8), 4):
        assert any(s <= set(four) for s in sets)
    for bits in (1, 2, 3, 5, 6, 7):
        for least in combinations(range(8), 8 - bits):
            assert any(set(s) <= set(least) for s in simhash.position_sets(bits))


def test_digest_equals_brute_force(spark):
    rng = random.Random(5)
    words = ["w%d" % i for i in range(300)]
    texts = [None, "", "  \n", "One", "one", "One two", "É a b c d", "x" * 100_000, "a b c d " * 20_000]
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        texts += [" ".join(base)]
        for _ in range(rng.randint(0, 3)):
            base = base[:]
            base[rng.randrange(len(base))] = rng.choice(words)
            texts += ["\t".join(base).upper()]
    rows = [(i if i % 11 else None, t) for i, t in enumerate(texts)] + [(3, "One"), (1000, "other words here at all")] * 2
    docs = spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], SCHEMA).repartition(5)
    fps = [(i, slow_fingerprint(t)) for i, t in rows]
    want = sorted(((i, "%016x" % f, c) for (i, f), c in zip(fps, slow_components(fps))), key=str)
    assert sorted(map(tuple, simhash.documents_digest(docs).collect()), key=str) == want


def test_forest_keeps_reachability_in_large_and_dense_postings():
    rng = np.random.default_rng(1)
    for n, limit in ((300, 16), (900, 64)):
        base = rng.integers(0, 2**63, 6, dtype=np.uint64)
        fps = base[rng.integers(0, 6, n)]
        for _ in range(4):
            fps = fps ^ (np.uint64(1) << rng.integers(0, 40, n).astype(np.uint64))
        fps = np.unique(fps & np.uint64(0xFFFFFFFFFF) | np.uint64(0xAB << 40))
        want = slow_components([(i, int(f)) for i, f in enumerate(fps)])
        roots, members = [], []
        simhash.forest(fps, 4, roots, members, limit)
        at = {int(f): i for i, f in enumerate(fps)}
        parent = list(range(len(fps)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for u, v in zip(np.concatenate(roots), np.concatenate(members)):
            a, b = find(at[int(u)]), find(at[int(v)])
            parent[max(a, b)] = min(a, b)
        assert [find(i) for i in range(len(fps))] == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(200)}


def test_empty(spark):
    assert simhash.documents_digest(spark.createDataFrame([], SCHEMA)).count() == 0
