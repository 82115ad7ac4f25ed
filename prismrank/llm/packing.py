"""Operator 1: packing token sequences by non-negative least squares.

A document's ids are cut at multiples of the window (4096); the pieces, full
windows and one remainder per document, are counted in a histogram of at most
a few hundred length classes, whatever the size of the corpus.  On the driver,
over that histogram alone:

1. combinations of up to four classes that fill a window are enumerated;
2. their repeat counts are fitted to the histogram by non-negative least
   squares (active set, so few combinations are used);
3. counts are rounded, never beyond what a class still has;
4. what is left is packed greedily, largest first, again by classes: one step
   packs a pattern as often as the counts allow, so steps do not grow with
   the number of pieces.

The plan says, for each class, which of its pieces (by rank) go to which
sequence and slot.  Ranks are made without gathering a class: pieces are
numbered inside (class, salt) groups, and the groups' offsets are added.

Sequences are padded to the window by whoever writes them; the result has no
row for padding.  A sequence never exceeds the window.

Defined results: a null text is empty, an empty text is the end id alone; null
ids and repeated rows are documents like any other; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismrank.llm._shared import materialize, only, ranges, release_memory

WINDOW = 4096
END_ID = 2
#: Characters of text from which no further text is encoded together.
TOGETHER = 3_000_000
DEPTH = 4
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int"


# ---- ids -----------------------------------------------------------------

#: Kinds of bytes: white space, a-z, ASCII punctuation but apostrophes (which
#: may begin a contraction), all others.
_SPACE, _LETTER, _MARK, _REST = range(4)
_KIND = np.full(256, _REST, np.uint8)
_KIND[list(b"\t\n\x0b\x0c\r ")] = _SPACE
_KIND[list(b"abcdefghijklmnopqrstuvwxyz")] = _LETTER
_KIND[list(b"!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~")] = _MARK


def unit_starts(data: bytes, latin: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes stand in a unit, and which begin one.  Units are parted by
    white space and, in lower-cased Latin texts, before punctuation that follows
    a letter (a-z, or U+00DF to U+00FF); the tokenizer parts them there too."""
    x = np.frombuffer(data, np.uint8)
    kind = _KIND[x]
    inside = kind != _SPACE
    new = inside.copy()
    new[1:] &= ~inside[:-1]
    if latin:
        letter = kind == _LETTER
        letter[1:] |= (x[:-1] == 0xC3) & (x[1:] != 0x97) & (x[1:] != 0xB7)
        new[1:] |= (kind[1:] == _MARK) & letter[:-1]
    return inside, new


class Encoder:
    """Ids of texts.  The texts of a call are cut into units that the tokenizer
    treats alone; every distinct unit is encoded once, and the ids of all units
    are gathered from there.  Nothing is kept between calls but the tokenizer."""

    general = staticmethod(re.compile("[\u0250-\U0010ffff]").search)

    def __init__(self, path: str) -> None:
        # a worker has one core; a pool of threads of its own would only wait
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.steps = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        # of lower-case letters: nothing to normalize, and white space separates
        self.plain_steps = normalizers.Sequence([]), pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def _ids(self, texts: list[str], together: int, steps: tuple) -> Iterator[np.ndarray]:
        """So many at once, as what the tokenizer returns is much larger than ids."""
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = steps
        for a in range(0, len(texts), together):
            for e in self.tokenizer.encode_batch_fast(texts[a : a + together], add_special_tokens=False):
                yield np.array(e.ids, "<u4")

    def _encode_units(self, units: list[str], latin: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units, one after the other, and how many each has."""
        plain = np.fromiter((latin and u.isalpha() for u in units), bool, len(units))
        words = [u for u, p in zip(units, plain.tolist()) if p]
        odd = [u for u, p in zip(units, plain.tolist()) if not p]
        # each word ends with a token that ends a word, so many make one text
        texts = [" ".join(words[a : a + 1000]) for a in range(0, len(words), 1000)]
        found, rest = list(self._ids(texts, 16, self.plain_steps)), list(self._ids(odd, 4096, self.steps))
        ids = np.concatenate([*found, *rest, np.zeros(0, "<u4")])
        of_words = sum(map(len, found))
        ends = np.flatnonzero(self.ends[ids[:of_words]]) + 1
        if len(ends) != len(words) or (of_words and ends[-1] != of_words):
            raise RuntimeError("a word does not end with a token that ends a word")
        size = np.empty(len(units), np.int64)
        size[plain] = np.diff(ends, prepend=0)
        size[~plain] = np.fromiter(map(len, rest), np.int64, len(rest))
        begin = np.empty(len(units), np.int64)
        begin[plain] = ends - size[plain]
        begin[~plain] = of_words + np.cumsum(size[~plain]) - size[~plain]
        return ids[ranges(begin, size)], size

    def _encode_group(self, texts: list[str], latin: bool) -> list[np.ndarray]:
        """``latin``: of texts of Latin letters without a special token's "<".
        There the tokenizer lower-cases; elsewhere marks may combine, and what
        stands between white space is left to it as it is."""
        held = [(t.lower() if latin else t).encode("utf-8", "surrogatepass") for t in texts]
        size = np.fromiter(map(len, held), np.int64, len(held))
        data = b"\n".join(held)
        inside, new = unit_starts(data, latin)
        if not inside.any():
            return [np.zeros(0, "<u4")] * len(texts)
        where = np.flatnonzero(new)
        cuts = np.searchsorted(where, np.r_[np.cumsum(size + 1) - size - 1, len(data)])
        offsets = np.append(np.flatnonzero(new[inside]), inside.sum()).astype(np.int64)
        body = np.frombuffer(data, np.uint8)[inside]
        units = pa.Array.from_buffers(pa.large_string(), len(where), [None, pa.py_buffer(offsets), pa.py_buffer(body)]).dictionary_encode()
        ids, n = self._encode_units(units.dictionary.to_pylist(), latin)
        at = units.indices.to_numpy(zero_copy_only=False)
        every = ids[ranges((np.cumsum(n) - n)[at], n[at])]
        ends = np.r_[0, np.cumsum(n[at])][cuts].tolist()
        return [every[a:b] for a, b in zip(ends, ends[1:])]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        latin = ["<" not in t and (t.isascii() or not self.general(t)) for t in texts]
        out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(texts)
        for kind in (True, False):
            at = [i for i, k in enumerate(latin) if k == kind]
            for i, ids in zip(at, self._encode_group([texts[i] for i in at], kind) if at else ()):
                out[i] = ids
        return out


def encoder(path: str | None) -> Encoder:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return Encoder(path)


# ---- length classes and the plan ---------------------------------------------


def class_edges(window: int = WINDOW) -> np.ndarray:
    """Upper edges of the length classes: exact up to 64, then steps of 4 up
    to 256 and of 16 beyond; the last is the window."""
    return np.array(sorted({*range(1, min(64, window) + 1), *range(64, min(256, window) + 1, 4), *range(256, window + 1, 16), window}))


def combinations(edges: np.ndarray, window: int, depth: int = DEPTH) -> np.ndarray:
    """All multisets of at most ``depth`` of the edges that fill the window
    exactly, of edges on its grid of sixteenths; unused places hold -1."""
    grid = 16 if window % 16 == 0 else 1
    units = np.flatnonzero(edges % grid == 0)
    at = {int(edges[i]) // grid: int(i) for i in units}
    sizes, total = sorted(at, reverse=True), window // grid
    found: list[list[int]] = []

    def extend(left: int, first: int, held: list[int]) -> None:
        room = depth - len(held)
        for k in range(first, len(sizes)):
            s = sizes[k]
            if s > left:
                continue
            if s * room < left:
                return
            if s == left:
                found.append([*held, at[s]] + [-1] * (room - 1))
            elif room > 1:
                extend(left - s, k, [*held, at[s]])

    extend(total, 0, [])
    return np.array(found, np.int64).reshape(-1, depth)


def nnls(columns: np.ndarray, goal: np.ndarray, rounds: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Active-set non-negative least squares for a matrix whose column j counts
    the classes columns[j].  Returns the columns in use and their values.  After
    ``rounds`` columns (more than the 348 classes could use) it stops with what it
    has: a plan a little worse; what it leaves is packed greedily, like any rest."""
    n = len(goal)
    padded = np.where(columns < 0, n, columns)

    def dense(j: np.ndarray) -> np.ndarray:
        out = np.zeros((n + 1, len(j)))
        np.add.at(out, (padded[j].T, np.arange(len(j))), 1.0)
        return out[:n]

    passive: list[int] = []
    x = np.zeros(0)
    left = goal.astype(float)
    for _ in range(rounds):
        dual = np.append(left, 0.0)[padded].sum(1)
        dual[passive] = -np.inf
        if not len(dual) or dual.max() <= 1e-6 * max(1.0, goal.max()):
            break
        passive.append(int(dual.argmax()))
        x = np.append(x, 0.0)
        while True:
            a = dense(np.array(passive))
            s = np.linalg.solve(a.T @ a + 1e-9 * np.eye(len(passive)), a.T @ goal)
            if (s > 0).all():
                x = s
                break
            low = s <= 0
            step = np.min(x[low] / np.maximum(x[low] - s[low], 1e-12))
            x = x + step * (s - x)
            stay = x > 1e-9
            if stay.all():
                stay[np.flatnonzero(low)[0]] = False
            passive = [p for p, k in zip(passive, stay) if k]
            x = x[stay]
            if not passive:
                break
        left = goal - (dense(np.array(passive)) @ x if passive else 0.0)
    return np.array(passive, np.int64), x


def make_plan(counts: np.ndarray, edges: np.ndarray, window: int, depth: int = DEPTH) -> list[tuple[dict[int, int], int]]:
    """Patterns (class -> number of pieces) and how often each is packed; they
    use every piece that ``counts`` has exactly once."""
    have = np.flatnonzero(counts)
    combos = combinations(edges[have], window, depth)
    combos = np.where(combos < 0, -1, have[combos]) if len(combos) else combos
    used, x = nnls(combos, counts.astype(float)) if len(combos) else (np.zeros(0, np.int64), np.zeros(0))
    left = counts.astype(np.int64).copy()
    plan = []
    for k in np.argsort(-x, kind="stable"):
        pattern: dict[int, int] = {}
        for c in combos[used[k]]:
            if c >= 0:
                pattern[int(c)] = pattern.get(int(c), 0) + 1
        n = min(int(round(x[k])), min(int(left[c]) // m for c, m in pattern.items()))
        if n > 0:
            plan.append((pattern, n))
            for c, m in pattern.items():
                left[c] -= n * m
    while left.any():
        pattern, room = {}, window
        for c in np.flatnonzero(left)[::-1].tolist():
            m = min(room // int(edges[c]), int(left[c]))
            if m:
                pattern[c] = m
                room -= m * int(edges[c])
        n = min(int(left[c]) // m for c, m in pattern.items())
        plan.append((pattern, n))
        for c, m in pattern.items():
            left[c] -= n * m
    return plan


def slots(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """Per class rows (first rank, pieces per sequence, first sequence, first
    slot), in order of rank."""
    out: dict[int, list] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for pattern, n in plan:
        slot = 0
        for c, m in sorted(pattern.items(), reverse=True):
            out.setdefault(c, []).append((taken.get(c, 0), m, sequence, slot))
            taken[c] = taken.get(c, 0) + n * m
            slot += m
        sequence += n
    return {c: np.array(rows, np.int64) for c, rows in out.items()}


# ---- the tables -----------------------------------------------------------------


def _pieces(batches: Iterator[pa.RecordBatch], path: str | None, window: int, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
    enc, end = encoder(path), np.array([END_ID], "<u4")
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        a = 0
        while a < len(ids):
            some, size, b = [], 0, a
            while b < len(ids) and size < TOGETHER:
                some.append(texts[b].as_py() or "")
                size += len(some[-1])
                b += 1
            out: list[tuple] = []
            for i, data in zip(ids[a:b], enc.encode(some)):
                n = len(data) + 1
                for s in range(0, n, window):
                    m = min(window, n - s)
                    crc = zlib.crc32(data[s : s + m])
                    out.append((i, s, m, crc if s + m < n else zlib.crc32(end, crc), n))
            cols = list(zip(*out))
            length = np.array(cols[2], np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in cols), pa.array(np.searchsorted(edges, length).astype(np.int32))],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class"],
            )
            a = b
    del enc
    release_memory()


def _place(batches: Iterator[pa.RecordBatch], table: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kind = batch["class"].to_numpy(zero_copy_only=False)
        rank = batch["rank"].to_numpy(zero_copy_only=False)
        sequence, slot = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        for c in np.unique(kind).tolist():
            at = np.flatnonzero(kind == c)
            rows = table[c]
            k = np.searchsorted(rows[:, 0], rank[at], "right") - 1
            inside = rank[at] - rows[k, 0]
            sequence[at] = rows[k, 2] + inside // rows[k, 1]
            slot[at] = rows[k, 3] + inside % rows[k, 1]
        keep = [batch[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(slot)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"])


def pack_documents(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None, depth: int = DEPTH) -> DataFrame:
    """Pieces of all rows of ``docs`` (doc_id, text): doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, slot (place in the sequence), offset.
    ``vocabulary``: path of a tokenizers file."""
    spark, edges = docs.sparkSession, class_edges(window)
    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = materialize(rows.mapInArrow(lambda it: _pieces(it, vocabulary, window, edges), PIECES), "pieces")
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)).cast("int"))
    per = materialize(pieces.groupBy("class", "salt").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = np.zeros(len(edges), np.int64)
    for r in per.groupBy("class").agg(F.sum("n").alias("n")).collect():
        counts[r["class"]] = r["n"]
    table = slots(make_plan(counts, edges, window, depth))
    # of equally many groups per class: what the groups with smaller salts hold
    before = Window.partitionBy("class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    first = per.select("class", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("class", "salt").orderBy("doc_id", "start", "doc_tokens", "ids_crc32")
    ranked = pieces.withColumn("inside", F.row_number().over(inside) - 1).join(first, ["class", "salt"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", (F.col("first") + F.col("inside")).cast("long").alias("rank"))
    placed = ranked.mapInArrow(lambda it: _place(it, table), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long")
    ahead = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0)).cast("long"))


def documents_digest(docs: DataFrame) -> DataFrame:
    """The columns that ``op1_nnls_packing`` returns."""
    return pack_documents(docs).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
