import random
import re

import numpy as np
import pyarrow as pa
import pytest

from prismrank.llm import setjoin

SCHEMA = "doc_id long, text string, uid long, key string, n int"


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def expected(rows, percent=80):
    """Components by comparing all pairs; a row's place stands for it."""
    sets = [shingles(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                top[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low.setdefault(find(i), []).append(d)
    lowest = lambda x: min([d for d in low[find(x)] if d is not None], default=None)
    return sorted(((d, len(sets[i]), lowest(i)) for i, (d, _) in enumerate(rows)), key=repr)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(d, t, 7, "clash", 1) for d, t in rows], SCHEMA).repartition(parts)


def got(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted(map(tuple, df.collect()), key=repr)


def words(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def changed(rng, text, times):
    w = text.split()
    for _ in range(times):
        at = rng.randrange(len(w))
        rng.choice([lambda: w.insert(at, "new"), lambda: w.__setitem__(at, f"x{rng.random()}"), lambda: len(w) > 1 and w.pop(at)])()
    return " ".join(w)


def corpus(seed):
    """Families around 0.8 of many sizes, a common passage, a template, short
    texts with a common opening, copies, and odd rows."""
    rng = random.Random(seed)
    rows, passage, template = [], " ".join(words(rng, 40)), words(rng, 120)
    for n in (1, 2, 4, 5, 6, 7, 8, 9, 10, 12, 14, 20, 30, 50, 52, 60, 75, 90, 120, 200, 400):
        base = " ".join(words(rng, n))
        rows += [base, base + " tail", "head " + base, base.upper()] + [changed(rng, base, rng.randrange(1, 2 + n // 25)) for _ in range(4)]
    rows += [f"{' '.join(words(rng, 60))} {passage} {' '.join(words(rng, 30))}" for _ in range(25)]
    for _ in range(25):  # alike, but not near: each differs from the template
        w = list(template)
        for at in rng.sample(range(120), 4):
            w[at] = f"y{rng.random()}"
        rows.append(" ".join(w))
    rows += [f"the same short opening of all {' '.join(words(rng, 4))}" for _ in range(30)]
    rows += [None, "", "  \n\t ", "One", "one", "ONE two", None, "a b c d e", "A\nB  c\x0bd\x0ce", " ".join(words(rng, 6000))]
    numbered = [(i * 3 + 1, t) for i, t in enumerate(rows)]
    rng.shuffle(numbered)
    return numbered + [numbered[0]] * 3 + [(None, rows[20]), (None, "nothing like it at all in here"), (None, None), (2, rows[100] + " again")] + [(5000 + i, rows[40]) for i in range(20)]


def test_digest_equals_brute_force(spark):
    rows = corpus(1)
    assert got(setjoin.documents_digest(frame(spark, rows))) == expected(rows)


@pytest.mark.parametrize("hot", [0, 2])
def test_one_deletion_index_loses_nothing(spark, monkeypatch, hot):
    """With hot postings from ``hot`` groups on, segments of several tokens
    already for sets of ten, and postings that are passed on in parts."""
    monkeypatch.setattr(setjoin, "PENDING", 8)
    rows = corpus(3)
    assert got(setjoin.Join(frame(spark, rows), tokenwise=10).components(hot)) == expected(rows)


def test_other_similarities(spark):
    rows = [r for r in corpus(4) if r[1] is None or len(r[1]) < 3000]
    assert got(setjoin.Join(frame(spark, rows), 5, 60).components()) == expected(rows, 60)


def test_empty_table(spark):
    assert got(setjoin.documents_digest(frame(spark, [], 1))) == []
    assert got(setjoin.documents_digest(frame(spark, [(4, None), (2, " ")], 1))) == [(2, 0, 2), (4, 0, 4)]


def test_a_common_passage_is_left_out(spark):
    """Texts that share a passage but are not near ask for nothing: what the
    passage fills is what they may leave out."""
    rng = random.Random(6)
    passage = " ".join(words(rng, 30))
    rows = [(i, f"{' '.join(words(rng, 150))} {passage}") for i in range(150)]
    join = setjoin.Join(frame(spark, rows))
    assert join.shared.count() > 0
    assert join.probed().filter("asks").count() < 150


def test_postings_keep_every_row():
    """Any cut into batches gives whole postings, or parts that cover them."""
    rng = random.Random(8)
    keys = sorted([rng.randrange(30) for _ in range(300)] + [7] * 200)
    for size in (1, 3, 50, 500):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[a : a + size]), pa.array(range(a, min(a + size, len(keys))))], names=["key", "row"]) for a in range(0, len(keys), size)]
        for pending in (4, 60, 1000):
            setjoin.PENDING, held = pending, setjoin.PENDING
            try:
                parts = [(k, r, part) for (k, r), part in setjoin._postings(iter(batches))]
            finally:
                setjoin.PENDING = held
            assert {x for _, r, _ in parts for x in r.tolist()} == set(range(len(keys)))
            whole = [x for k, r, part in parts if not part for x in np.unique(k).tolist()]
            assert len(whole) == len(set(whole))
            assert all(len(set(k.tolist())) == 1 for k, _, part in parts if part)
            assert not set(whole) & {int(k[0]) for k, _, part in parts if part}
