import hashlib
import random

import numpy as np

from prismrank.llm import repeats

SCHEMA = "doc_id long, text string, part string, payload int"


def expected(rows, length=50):
    texts = [(i, (t or "").encode()) for i, t in rows]
    low = {}
    for i, t in texts:
        i = repeats.LAST if i is None else i
        for k in range(len(t) - length + 1):
            w = t[k : k + length]
            low[w] = min(low.get(w, i), i)
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - length + 1):
            if low[t[k : k + length]] < (repeats.LAST if i is None else i):
                gone[k : k + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        left = bytes(c for c, g in zip(t, gone) if not g)
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def rows():
    rng = random.Random(3)
    words = ["alpha", "beta", "gämma", "delta", "of", "the", "x"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(n))
    shared = [text(20) for _ in range(4)]
    out = [(None, shared[0]), (None, shared[0] + "!"), (0, None), (1, ""), (2, "x" * 49), (3, "x" * 50), (4, "x" * 51), (5, "ab" * 3000), (9, "ab" * 700)]
    for i in range(20, 70):
        out.append((i, text(rng.randint(0, 40)) + rng.choice(shared)[rng.randrange(30) :] + text(rng.randint(0, 30)) + rng.choice(shared)))
    out += [(i + 200, t) for i, t in out[9:20]] + out[12:15] + [(70, shared[1]), (70, shared[1] + " and"), (8, out[30][1][:-1])]
    return out


def test_digest_equals_brute_force(spark, monkeypatch):
    data = rows()
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in data], SCHEMA).repartition(3)
    assert sorted(map(tuple, repeats.documents_digest(docs).collect()), key=str) == expected(data)


def test_result_does_not_depend_on_parts(spark):
    data = rows() + [(None, r[1]) for r in rows()[40:50]]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in data], SCHEMA).repartition(3)
    want = expected(data)
    for parts, buckets in ((1, 1), (5, 3), (40, 17)):
        got = repeats.repeated_passages(docs, parts=parts, buckets=buckets).collect()
        assert sorted(((r.id, r.n_bytes, r.n_removed, len(r.starts), r.kept_sha256) for r in got), key=str) == want


def test_a_line_of_all_documents_costs_a_record_per_part():
    import pyarrow as pa

    line = "a line that stands in every document of the table: " + " ".join(map(str, range(100, 200)))
    texts = [f"{i} {line} {i * 7}" for i in range(400)]
    t = pa.table({"part": pa.array([0] * 400, pa.int32()), "id": pa.array(range(400)), "h": pa.array(range(400)), "text": texts})
    anchors = repeats._anchors(t, 1, 50)
    batch = lambda table: table.combine_chunks().to_batches()[0]
    shared = pa.Table.from_batches(repeats._shared(iter([batch(anchors)])))
    rows = repeats._contexts(t, shared, 50)
    kinds = repeats.unpack([p for b, p in zip(rows["bucket"].to_pylist(), rows["payload"]) if b >= 0][0].as_py())
    runs = repeats.unpack([p for b, p in zip(rows["bucket"].to_pylist(), rows["payload"]) if b < 0][0].as_py())
    assert len(runs[0]) >= 400 and (kinds[2].view(np.int64).min(), kinds[3].view(np.int64).max()) == (0, 399)
    whole = [k for k, (low, high) in enumerate(zip(kinds[2].tolist(), kinds[3].tolist())) if low == 0 and high == 399]
    assert whole and len(kinds[0]) < len(runs[0])


def test_long_texts_are_cut_into_overlapping_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(repeats, "PIECE", 97)
    t = pa.table({"part": pa.array([0, 0], pa.int32()), "id": pa.array([1, 2]), "h": pa.array([0, 0]), "text": ["q" * 30 + "".join(map(str, range(500))), "".join(map(str, range(400)))]})
    got = repeats._anchors(t, 3, 50)
    windows = set()
    for p in got["payload"]:
        _, _, d, s, n = repeats.unpack(p.as_py())
        for doc, at, k in zip(repeats.undelta(d), repeats.undelta(s), n):
            for w in range(at, at + k):
                assert (doc, w) not in windows
                windows.add((doc, w))
    assert windows == {(i, w) for i in (0, 1) for w in range(len(t["text"][i].as_py()) - 49)}


def test_empty(spark):
    assert repeats.documents_digest(spark.createDataFrame([], SCHEMA)).count() == 0
