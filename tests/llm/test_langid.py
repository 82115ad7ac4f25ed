import itertools
import random

import numpy as np
import pytest

from prismrank.llm import langid

SCHEMA = "doc_id long, text string, lang string, score string, firsts int"
SYLLABLES = {"en": ["the", "th", "ing", "er", "and"], "fr": ["eau", "eux", "lle", "é", "ou"], "ru": ["ов", "ни", "ст", "ка", "при"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, lang, 40), lang, "", 0) for i, lang in enumerate(["en", "fr", "ru"] * 30)]
    rows += [(1000, None, "en", "", 0), (1001, "zzz", None, "", 0), (None, "qqq", "en", "", 0)]
    return langid.fit(spark.createDataFrame(rows, SCHEMA))


def test_spans_of_mixed_text(spark, model):
    rng = random.Random(9)
    parts = [text(rng, lang, 25) for lang in ("en", "fr", "en")]
    mixed = parts[0] + ". " + parts[1] + "!\n" + parts[2]
    rows = [(1, mixed), (2, None), (3, ""), (4, "12 -- 34"), (5, "ПРИов no"), (6, text(rng, "fr", 5) * 4000), (None, parts[1]), (7, "İ" + parts[1])]
    docs = spark.createDataFrame([(i, t, "xx", "clash", 1) for i, t in rows], SCHEMA)
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    a, b = len(parts[0]) + 2, len(parts[0]) + 2 + len(parts[1])
    assert [tuple(s) for s in got[1].spans] == [(0, a - 2, "en"), (a, b, "fr"), (b + 2, len(mixed), "en")]
    assert got[1].lang_pred == "en" and 0.5 < got[1].score < 1
    for i in (2, 3, 4):
        assert (got[i].lang_pred, got[i].score, got[i].spans) == ("und", 0.0, [])
    assert got[5].lang_pred == "ru" and got[6].lang_pred == got[None].lang_pred == got[7].lang_pred == "fr"
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 5, 6, 7, None}


def best_path(s, penalty):
    value = lambda p: sum(s[i, k] for i, k in enumerate(p)) - penalty * sum(x != y for x, y in zip(p, p[1:]))
    return max(map(value, itertools.product(range(s.shape[1]), repeat=len(s)))), value


def test_labels_are_the_best_path():
    rng = np.random.default_rng(0)
    for _ in range(300):
        s = rng.normal(0, 2, (rng.integers(1, 7), rng.integers(1, 4)))
        penalty = rng.uniform(0, 5)
        best, value = best_path(s, penalty)
        assert value(langid.viterbi(s, penalty).tolist()) == pytest.approx(best)
        assert value(langid.label(s, penalty).tolist()) == pytest.approx(best)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.documents_digest(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").toPandas()
    assert len(got) > 250 and (got.lang_pred == got.lang).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert langid.documents_digest(empty).count() == 0
    unlabelled = spark.createDataFrame([(1, "words", None, "", 1)], SCHEMA)
    assert [r.lang_pred for r in langid.documents_digest(unlabelled).collect()] == ["und"]


def test_rare_language_of_a_shared_script(spark):
    rng = random.Random(5)
    rows = [(i, text(rng, lang, 80), lang, "", 0) for i, lang in enumerate(["en", "fr"] * 500)]
    rare = ["kwyjibo zorgul wexxik tazdoq yukkov pluzzik " * 2, "zorgul yukkov kwyjibo qaddoz wexxik tazdoq " * 2]
    rows += [(2000 + i, t, "xx", "", 0) for i, t in enumerate(rare)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, langid.fit(docs)).filter("doc_id >= 2000").collect()}
    assert got == {2000: "xx", 2001: "xx"}
