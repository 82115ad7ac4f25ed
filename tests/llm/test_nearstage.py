import random

import numpy as np
import pytest

from prismrank.llm import nearstage
from prismrank.llm.exactdedup import fold

SCHEMA = "doc_id long, text string, uid string, u int"


def shingles(text, width=5):
    w = fold(text).split()
    return {b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, words, n):
    out = words[:]
    for k in rng.sample(range(len(out)), n):
        out[k] = "new%d" % rng.randrange(10**6)
    return out


def test_planted_copies_are_caught_and_clean_documents_stay(spark):
    rng = random.Random(6)
    vocabulary = ["w%d" % i for i in range(2000)]
    rows, groups = [], []
    for i in range(150):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 400))]
        copies = [base] + [edited(rng, base, max(1, len(base) // 60)) for _ in range(i % 4)]
        groups.append([len(rows) + k for k in range(len(copies))])
        rows += [(len(rows) + k, " ".join(c)) for k, c in enumerate(copies)]
    far = [rng.choice(vocabulary) for _ in range(300)]
    rows += [(9000, " ".join(far)), (9001, " ".join(edited(rng, far, 40)))]
    assert jaccard(rows[-1][1], rows[-2][1]) < 0.6
    assert all(jaccard(rows[g[0]][1], rows[k][1]) >= 0.8 for g in groups for k in g)
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA).repartition(5)
    kept = nearstage.keep_representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted([g[0] for g in groups] + [9000, 9001])


def test_large_groups_emit_a_forest():
    rng = np.random.default_rng(2)
    n = 700
    a = rng.integers(0, 2**63, n, dtype=np.uint64) & np.uint64(1023)
    a ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    out = []
    nearstage.near_forest(np.arange(n), np.stack([a, np.full(n, 100, np.uint64)], 1), 12, out)
    u, v = np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])
    assert len(u) == n - 1 and len(set(v.tolist())) == n - 1
    assert (np.bitwise_count(a[u] ^ a[v]) <= 12).all()


def test_share_of_pairs_found_at_the_threshold():
    rng = np.random.default_rng(3)
    bits = nearstage.most_differing(0.8, errors=2 * nearstage.CLEAR)
    near = far = 0
    for _ in range(200):
        common = rng.integers(0, 2**63, 320, dtype=np.uint64)
        x, y = (np.r_[common, rng.integers(0, 2**63, 40, dtype=np.uint64)] for _ in range(2))  # 320 / 400
        fx, fy = (np.frombuffer(nearstage.wide_fingerprint(z), np.uint8) for z in (x, y))
        near += np.bitwise_count(fx ^ fy).sum() <= bits
        z = np.r_[common[:270], rng.integers(0, 2**63, 90, dtype=np.uint64)]  # 270 / 450
        far += np.bitwise_count(fx ^ np.frombuffer(nearstage.wide_fingerprint(z), np.uint8)).sum() <= bits
    assert near >= 198 and far <= 20


def test_cases(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (None, "a b"), (4, "a c"), (5, "x" * 100_000), (6, "a b"), (6, "a b"), (None, "only here")]
    docs = spark.createDataFrame([(i, t, "", 1) for i, t in rows], SCHEMA)
    assert sorted((r.doc_id for r in nearstage.keep_representatives(docs).collect()), key=str) == sorted([1, 3, 4, 5, None], key=str)
    assert nearstage.keep_representatives(docs.limit(0)).count() == 0
    assert nearstage.most_differing(0.8) == pytest.approx(155, abs=1)


def brute_force(texts, least=0.8):
    """Ids (places) that stay: the smallest of each component."""
    root = list(range(len(texts)))
    sets = [shingles(t) for t in texts]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if 5 * both >= 4 * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [i for i in range(len(texts)) if find(i) == i]


def test_near_copies_inside_a_templated_family(spark):
    rng = random.Random(11)
    words = ["w%d" % i for i in range(5000)]
    template = [rng.choice(words) for _ in range(250)]
    texts = []
    for i in range(600):  # all at about 0.7 of one another, every third with a near copy
        base = template + [rng.choice(words) for _ in range(50)]
        texts.append(" ".join(base))
        if i % 3 == 0:
            texts.append(" ".join(edited(rng, base, 5)))
    rng.shuffle(texts)
    left = brute_force(texts)
    assert 0.6 < jaccard(texts[left[0]], texts[left[1]]) < 0.75 and len(left) < len(texts) - 150
    docs = spark.createDataFrame([(i, t, "", 1) for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r.doc_id for r in nearstage.keep_representatives(docs).collect()) == left


def test_short_texts_equal_brute_force(spark):
    rng = random.Random(12)
    words = ["w%d" % i for i in range(3000)]
    texts = []
    for i in range(700):
        base = [rng.choice(words) for _ in range(rng.randint(6, 60) if i % 2 else rng.choice((8, 9, 12, 13)))]
        last = base[:-1] + ["other"]  # 12 words: 7 of 9 shingles in common, not near
        texts += [" ".join(x) for x in (base, last, [*base, "more"], edited(rng, base, 1))[: rng.randint(1, 4)]]
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, t, "", 1) for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r.doc_id for r in nearstage.keep_representatives(docs).collect()) == brute_force(texts)


def test_short_texts_with_a_common_opening_do_not_meet_by_it():
    """20,000 unlike short texts that share an opening: postings stay small."""
    import pyarrow as pa

    rng = random.Random(14)
    opening = ["open%d" % i for i in range(9)]
    sets = [nearstage.shingle_hashes([w.encode() for w in opening + ["w%d" % rng.randrange(10**7) for _ in range(rng.randint(8, 20))]], 5) for _ in range(20_000)]
    n = pa.array([len(h) for h in sets], pa.int32())
    batch = pa.RecordBatch.from_arrays([*[pa.array(range(len(sets)), pa.int64())] * 2, pa.array([1] * len(sets), pa.int64()), n, pa.array([h.tobytes() for h in sets], pa.binary())], names=["uid", "label", "size", "n", "short"])
    hashes, count = np.unique(np.concatenate(sets), return_counts=True)
    often = hashes[count >= nearstage.OFTEN]
    assert len(often) == 5

    def largest(frequent):
        keys = np.concatenate([b["posting"].to_numpy() for b in nearstage._short_postings(iter([batch]), 0.8, None, nearstage.RareFirst(frequent))])
        return np.unique(keys, return_counts=True)[1].max()

    assert largest(np.zeros(0, np.uint64)) > 5000 and largest(often) <= 3


def test_frequent_hashes_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(nearstage, "OFTEN", 6)
    rng = random.Random(15)
    words = ["w%d" % i for i in range(3000)]
    texts = []
    for i in range(300):
        base = ["the", "same", "words", "open", "all", "of", "these"] + [rng.choice(words) for _ in range(rng.randint(2, 40))]
        texts += [" ".join(x) for x in (base, [*base, "more"], edited(rng, base, 1))[: rng.randint(1, 3)]]
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, t, "", 1) for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r.doc_id for r in nearstage.keep_representatives(docs).collect()) == brute_force(texts)


@pytest.mark.parametrize("shared", [0, 150])
def test_recall_at_the_threshold(spark, shared):
    """Pairs of texts of more than 64 shingles at 0.80 to 0.82, alone and with a
    passage that all texts share."""
    rng = random.Random(13 + shared)
    words = ["w%d" % i for i in range(20_000)]
    boilerplate = [rng.choice(words) for _ in range(shared)]
    texts = []
    while len(texts) < 800:
        base = boilerplate + [rng.choice(words) for _ in range(rng.randint(150, 500))]
        copy = base[:]
        while jaccard(" ".join(base), " ".join(copy)) > 0.82:
            copy[rng.randrange(shared, len(copy))] = rng.choice(words)
        if jaccard(" ".join(base), " ".join(copy)) >= 0.8:
            texts += [" ".join(base), " ".join(copy)]
    docs = spark.createDataFrame([(i, t, "", 1) for i, t in enumerate(texts)], SCHEMA).repartition(4)
    kept = {r.doc_id for r in nearstage.keep_representatives(docs).collect()}
    assert {i for i in range(0, 800, 2)} <= kept
    assert sum(i not in kept for i in range(1, 800, 2)) >= 0.99 * 400


def test_columns_with_the_names_that_operators_use(spark):
    rows = [(1, "a b c", "x", 7, "p", "q"), (2, "a b c", "y", 8, "r", "s"), (3, "d", None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, uid string, mark int, own_0 string, __doc string")
    got = nearstage.keep_representatives(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [rows[0], rows[2]]
