"""Operator 2: language identification of mixed-language text.

Words are runs of letters.  The script of a word, by ranges of code points,
narrows its candidates to the languages that use the script in the training
rows.  A word's score for a candidate is the sum of the log-probabilities of
its hashed character trigrams (with the word's bounds).  Viterbi over the words
of a text, with a penalty for every switch of language, labels spans.

The result is the maximal spans and, per text, the language with most letters.
One language for a whole text is recognised without the recursion: if no run
of words gains more than one penalty by all its best other languages, no path
with a switch can be better (each excursion pays one penalty at least).

Training counts trigrams in a bounded number of documents per language (those
with small id hashes) of a bounded number of languages (the most frequent
labels), in the map tasks; the model has one row per bucket and language, and its
size does not depend on the data.

Defined results: a null text, and a text without letters, has the language
``und``, score 0 and no spans; without training rows so have all texts; rows
with a null label or a null id are not learned from, a null id is not held
out; repeated rows have equal results; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismrank.llm._shared import only, release_memory, renamed

#: Documents per language that a model is fitted on (see ``fit``).
TRAIN_DOCUMENTS = 2000
#: Languages that a model is fitted on: the most frequent labels, ties by name.
LANGUAGES = 200
RANGE = 1 << 40
BUCKETS = 1 << 17
SMOOTHING = 0.05
#: In nats of trigram log-probability.
SWITCH_PENALTY = 14.0
#: Share of a language's training letters from which it is a candidate in a script.
LEAST_SHARE = 0.001
UND = "und"
#: Characters that are scored at once, and rows that are held as strings.
CHUNK = 1 << 18
ROWS = 1000

# First and last code point of the ranges of scripts (Unicode).
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("ipa", 0x0250, 0x02FF), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F),
    ("gujarati", 0x0A80, 0x0AFF), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F), ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F),
    ("sinhala", 0x0D80, 0x0DFF), ("thai", 0x0E00, 0x0E7F), ("lao", 0x0E80, 0x0EFF), ("tibetan", 0x0F00, 0x0FFF), ("myanmar", 0x1000, 0x109F),
    ("georgian", 0x10A0, 0x10FF), ("hangul jamo", 0x1100, 0x11FF), ("ethiopic", 0x1200, 0x139F), ("khmer", 0x1780, 0x17FF), ("mongolian", 0x1800, 0x18AF),
    ("latin additional", 0x1E00, 0x1EFF), ("greek extended", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF), ("bopomofo", 0x3100, 0x312F),
    ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han supplement", 0x20000, 0x3FFFF),
)
_FIRST = np.array([s[1] for s in SCRIPTS])
_LAST = np.array([s[2] for s in SCRIPTS])
_LETTER = np.array([chr(c).isalpha() for c in range(1 << 16)])


def is_letter(code: np.ndarray) -> np.ndarray:
    out = _LETTER[np.minimum(code, 0xFFFF)]
    for c in np.unique(code[code > 0xFFFF]).tolist():
        out[code == c] = chr(c).isalpha()
    return out


def script_of(code: np.ndarray) -> np.ndarray:
    """Place in SCRIPTS, or len(SCRIPTS) for letters outside of all ranges."""
    k = np.searchsorted(_FIRST, code, "right") - 1
    return np.where((k >= 0) & (code <= _LAST[k]), k, len(SCRIPTS))


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower()[0] for c in text)


class Words:
    """The words of some texts: letters' trigram buckets, and per word the
    first letter's place, the end, the script and the text."""

    def __init__(self, texts: list[str]) -> None:
        joined = "\0" + "\0".join(map(_lower, texts)) + "\0"
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.at = np.cumsum(size + 1) - size  # of each text in ``joined``
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        letter = is_letter(code)
        kept = np.where(letter, code, 0).astype(np.uint64)
        where = np.flatnonzero(letter)
        x = kept[where - 1] * np.uint64(0x9E3779B97F4A7C15) + kept[where] * np.uint64(0xC2B2AE3D27D4EB4F) + kept[where + 1] * np.uint64(0x165667B19E3779F9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        self.bucket = (x >> np.uint64(40)).astype(np.int64) % BUCKETS
        opens = np.flatnonzero(np.diff(where, prepend=-2) != 1)  # in letters
        self.opens, self.count = opens, np.diff(np.r_[opens, len(where)])
        self.first = where[opens]
        self.script = script_of(code[self.first])
        self.text = np.searchsorted(self.at, self.first, "right") - 1

    def first_of(self, n: int) -> np.ndarray:
        """Where each text's words begin, and the end."""
        return np.searchsorted(self.text, np.arange(n + 1))


# ---- training ---------------------------------------------------------------


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) <= CHUNK):
            size += len(texts[b])
            b += 1
        yield a, texts[a:b]
        a = b


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width = len(SCRIPTS) + 1
    held: dict[str, np.ndarray] = {}
    for batch in _slices(batches):
        of: dict[str, list[str]] = {}
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
            of.setdefault(lang, []).append(text)
        for lang, texts in of.items():
            mine = held.setdefault(lang, np.zeros(BUCKETS + width, np.int64))
            for _, some in _chunks(texts):
                w = Words(some)
                mine[:BUCKETS] += np.bincount(w.bucket, minlength=BUCKETS)
                mine[BUCKETS:] += np.bincount(w.script, weights=w.count, minlength=width).astype(np.int64)
    for lang, mine in held.items():
        k = np.flatnonzero(mine)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.astype(np.int32)), pa.array(mine[k])], names=["lang", "k", "n"])
    release_memory()


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray) -> None:
        """``counts``: per language, of buckets and then of script letters."""
        self.langs = langs
        grams, scripts = counts[:, :BUCKETS], counts[:, BUCKETS:]
        total = grams.sum(1, keepdims=True)
        self.log = np.ascontiguousarray(np.log((grams + SMOOTHING) / (total + SMOOTHING * BUCKETS)).T.astype(np.float32))
        allowed = scripts >= LEAST_SHARE * np.maximum(scripts.sum(1, keepdims=True), 1)
        allowed &= scripts > 0
        allowed[:, ~allowed.any(0)] = True  # a script that was never seen, or only strayed into
        self.barred = np.where(allowed.T, 0.0, -1e4)

    def scores(self, w: Words) -> np.ndarray:
        """Per word and language, relative to the best of its candidates."""
        if not len(w.opens):
            return np.zeros((0, len(self.langs)))
        s = np.add.reduceat(self.log[w.bucket], w.opens, axis=0, dtype=np.float64) + self.barred[w.script]
        return s - s.max(1, keepdims=True)


def fit(docs: DataFrame, documents: int = TRAIN_DOCUMENTS, languages: int = LANGUAGES) -> Model:
    """Fit on rows of ``docs`` (doc_id, text, lang) with no nulls: all of a
    language with up to ``documents`` of them, else a share by the hash of the
    id that holds ``documents`` on average (so within a few of its roots)."""
    rows = only(docs, "doc_id", "text", "lang").filter("doc_id is not null and text is not null and lang is not null")
    have = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    langs = sorted(have)
    if not langs:
        return Model([], np.zeros((0, BUCKETS + len(SCRIPTS) + 1)))
    # the share of the hashes' range below which a language's documents are
    shares = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(int(min(1.0, documents / have[lang]) * RANGE)))])
    below = F.pmod(F.xxhash64("doc_id"), F.lit(RANGE)) < F.try_element_at(shares, F.col("lang"))
    counted = rows.filter(below).select("lang", "text").mapInArrow(_count, "lang string, k int, n long")
    counts = np.zeros((len(langs), BUCKETS + len(SCRIPTS) + 1))
    for r in counted.groupBy("lang", "k").agg(F.sum("n").alias("n")).toPandas().itertuples():
        counts[langs.index(r.lang), r.k] = r.n
    return Model(langs, counts)


# ---- prediction ---------------------------------------------------------------


def viterbi(s: np.ndarray, penalty: float) -> np.ndarray:
    """The best path over words (rows) and languages; stays on ties."""
    value, back = s[0].tolist(), []
    width = range(len(value))
    for row in s[1:].tolist():
        best = max(width, key=value.__getitem__)
        switched = value[best] - penalty
        back.append([k if value[k] >= switched else best for k in width])
        value = [max(value[k], switched) + row[k] for k in width]
    k = max(width, key=value.__getitem__)
    path = [k]
    for step in reversed(back):
        k = step[k]
        path.append(k)
    return np.array(path[::-1])


def label(s: np.ndarray, penalty: float) -> np.ndarray:
    """``viterbi``, but for texts in which no excursion can pay."""
    main = int(s.sum(0).argmax())
    if s.shape[1] == 1:
        return np.zeros(len(s), np.int64)
    gain = np.delete(s, main, axis=1).max(1) - s[:, main]
    run = np.r_[0.0, np.cumsum(gain)]
    if (run - np.minimum.accumulate(run)).max() <= penalty:
        return np.full(len(s), main)
    return viterbi(s, penalty)


def _predict(batches: Iterator[pa.RecordBatch], model: Model, penalty: float) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        texts = [t or "" for t in batch["text"].to_pylist()]
        lang, score, firsts, lasts, named = [], [], [], [], []
        for _, some in _chunks(texts):
            w = Words(some)
            s = model.scores(w) if model.langs else np.zeros((len(w.opens), 0))
            cuts = w.first_of(len(some))
            for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
                if a == b or not model.langs:
                    lang.append(UND)
                    score.append(0.0)
                    for x in (firsts, lasts, named):
                        x.append([])
                    continue
                path = label(s[a:b], penalty)
                letters = np.bincount(path, weights=w.count[a:b], minlength=len(model.langs))
                k = int(letters.argmax())
                lang.append(model.langs[k])
                score.append(float(letters[k] / letters.sum()))
                opens = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
                ends = np.r_[opens[1:], b - a] - 1 + a
                firsts.append((w.first[a + opens] - w.at[i]).tolist())
                lasts.append((w.first[ends] + w.count[ends] - w.at[i]).tolist())
                named.append([model.langs[p] for p in path[opens].tolist()])
        kinds = (pa.string(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()))
        values = (lang, score, firsts, lasts, named)
        rest = [batch.column(i) for i in range(batch.num_columns)]
        yield pa.RecordBatch.from_arrays([*rest, *(pa.array(v, t) for v, t in zip(values, kinds))], names=[*batch.schema.names, "lang_pred", "score", "firsts", "lasts", "langs"])
    release_memory()


def identify(docs: DataFrame, model: Model, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """doc_id, lang_pred, score (share of the letters) and spans (array of
    first, last, lang; code points, end exclusive) of each row."""
    found = only(docs, "doc_id", "text").mapInArrow(lambda it: _predict(it, model, penalty), _schema(docs, "doc_id", "text"))
    spans = F.arrays_zip(F.col("firsts").alias("first"), F.col("lasts").alias("last"), F.col("langs").alias("lang"))
    return found.select("doc_id", "lang_pred", "score", spans.alias("spans"))


def _schema(docs: DataFrame, *cols: str) -> str:
    have = {f.name: f.dataType.simpleString() for f in docs.schema}
    return ", ".join(f"`{c}` {have[c]}" for c in cols) + ", lang_pred string, score double, firsts array<long>, lasts array<long>, langs array<string>"


def keep_identified(docs: DataFrame, model: Model, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """``docs``, with all its columns, without texts that have no language: null
    texts, texts without letters, and all texts if there is no training row.
    Repeated rows, null ids and null labels stay as they are; an empty table
    gives an empty table."""
    inner, own = renamed(docs, "text")
    found = inner.mapInArrow(lambda it: _predict(it, model, penalty), _schema(inner, *inner.columns))
    return found.filter(F.col("lang_pred") != UND).select(*own).toDF(*docs.columns)


def documents_digest(docs: DataFrame) -> DataFrame:
    """The columns that ``op2_language_id`` returns: fitted on the rows whose
    id's CRC-32 leaves no remainder of 1 by 3, applied to all."""
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    model = fit(docs.filter(~held))
    return identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
