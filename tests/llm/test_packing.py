import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from prismrank.llm import packing

ENCODER = packing.encoder(None)
WHOLE = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
SCHEMA = "doc_id long, text string, length string, class int"


def ids_of(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]


def rows():
    rng = random.Random(4)
    words = ["alpha", "beta", "Gamma,", "it's", "x1y22", "ΟΔΟΣ.", "é", "don't.", "<|endoftext|>", "日本", "..."]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out = [(i, text(rng.choice([0, 3, 50, 400, 900]))) for i in range(150)]
    return out + [(None, "null id"), (None, None), (200, None), (201, "  \n"), (202, "q" * 30_000), (203, text(9000)), (204, "same"), (204, "same"), (205, "a\x1cb\x85c d")]


def check(data, got, window):
    """Pieces cover every document once, digests hold, sequences are gapless."""
    docs = {}
    for i, t in data:
        docs.setdefault(i, []).append(ids_of(t))
    want, have = [], []
    for i, many in docs.items():
        want += [(i, n) for d in many for n in d]
    for r in got:
        mine = [d for d in docs[r.doc_id] if len(d) == r.doc_tokens and zlib.crc32(np.array(d[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32]
        assert mine and 0 < r.length <= window
        have += [(r.doc_id, n) for n in mine[0][r.start : r.start + r.length]]
    assert sorted(have, key=str) == sorted(want, key=str)
    total = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == total.get(r.sequence_id, 0)
        total[r.sequence_id] = r.offset + r.length
    assert max(total.values()) <= window and sorted(total) == list(range(len(total)))
    return total


def test_every_id_lies_in_one_piece(spark):
    data = rows()
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in data], SCHEMA).repartition(4)
    check(data, packing.documents_digest(docs).collect(), 4096)
    check(data, packing.pack_documents(docs, window=512).collect(), 512)


def test_reruns_and_partitions_give_the_same_rows(spark):
    data = [r for r in rows() if r[0] is not None]
    docs = spark.createDataFrame([(i, t, "", 1) for i, t in data], SCHEMA)
    a, b = (sorted(map(tuple, packing.documents_digest(docs.repartition(k)).collect())) for k in (1, 6))
    assert a == b


def test_plan_uses_every_piece_with_little_padding():
    rng = np.random.default_rng(3)
    edges = packing.class_edges()
    length = np.clip(rng.lognormal(6.4, 1.0, 30_000).astype(int), 1, 4096)
    counts = np.bincount(np.searchsorted(edges, length), minlength=len(edges))
    plan = packing.make_plan(counts, edges, 4096)
    used = np.zeros(len(edges), int)
    for pattern, n in plan:
        assert sum(edges[c] * m for c, m in pattern.items()) <= 4096
        for c, m in pattern.items():
            used[c] += n * m
    assert (used == counts).all()
    assert length.sum() / (4096 * sum(n for _, n in plan)) > 0.985


def test_nnls_solves_small_problems():
    columns = np.array([[0, 1, -1, -1], [0, 0, -1, -1], [1, 1, 1, -1]])
    used, x = packing.nnls(columns, np.array([5.0, 4.0]))
    a = np.zeros((2, 3))
    for j, c in enumerate(columns):
        for k in c[c >= 0]:
            a[k, j] += 1
    full = np.zeros(3)
    full[used] = x
    assert np.allclose(a @ full, [5, 4], atol=1e-4) and (full >= 0).all()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet="aAzÉéßÅİıÿŒœ'.,;:!?12<|>&\x1c\x85\xa0\u0307\t\n ", max_size=40)), max_size=5))
def test_units_give_the_ids_of_the_whole_text(texts):
    got = ENCODER.encode(texts)
    assert [g.tolist() + [packing.END_ID] for g in got] == [ids_of(t) for t in texts]


def test_contractions_marks_and_special_tokens():
    texts = ["it's 'stuff' ('s", "don't.'ll", "A\u030a H\u0331 I\u0307 \u0130", "<|endoftext|>x<|ENDOFTEXT|>", "\xab.,\xbb \xd7.\xf7", "\u03a3\u03c2 \u039f\u0394\u039f\u03a3.", "", " \n\t", "\u023a\u017f\ufb01"]
    assert [g.tolist() + [packing.END_ID] for g in ENCODER.encode(texts)] == [ids_of(t) for t in texts]


def test_empty(spark):
    assert packing.documents_digest(spark.createDataFrame([], SCHEMA)).count() == 0
