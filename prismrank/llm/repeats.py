"""Operator 9: repeated passages by a depth-limited radix sort of suffixes.

A passage is a string of ``length`` bytes (50) that also starts in a document
with a smaller id; every byte that it covers is removed.  Suffixes are ordered
by most-significant-digit passes over 8-byte digits and only through the
threshold length: after the last pass the groups of equal suffixes are exactly
the repeated windows, and suffixes that have become unique leave after every
pass.

So that not every suffix has to travel, suffixes are first grouped by the
minimizer of their window (the 24-gram with the smallest hash), which is the
same wherever the window occurs.  Neighbouring windows share it, so one short
record stands for about fourteen of them:

1. ``_anchors``: per part of the documents, the runs of windows with one
   minimizer; 40 bits of its hash go to the bucket of that hash.
2. ``_shared``: per bucket, the runs whose minimizer occurs in at least two
   documents (all others have no repeated window and are done).
3. ``_contexts``: per part, runs of identical bytes become one kind; a kind's
   bytes, and the least and greatest id that have it, go to the bucket, so a line
   that very many documents share costs a record per part.
4. ``_radix``: per bucket, the radix passes over the windows of its kinds, then
   for each kind of a part the stretches of windows that a smaller id than its
   greatest has.
5. ``_finish``: these stretches, of the runs of each kind with a greater id, are
   united per document.

The texts are dealt out once by the hash of their id (and, where that is null, of
the text); the later steps reuse that exchange.  Between the steps only packed,
compressed arrays travel.  A part, and a bucket, is processed by one task; their
number follows from the bytes of all texts.

Defined results: a null text is empty; texts under ``length`` bytes lose
nothing; a null id ranks above all others and equals every other null id; rows
that have the same id never remove from one another; repeated rows have the
same result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismrank.llm._shared import ranges, release_memory

GRAM = 24
#: Windows of one document that are hashed at once.
PIECE = 1 << 20
LAST = (1 << 63) - 1
#: Bytes of text in a part, on average, and at least as many parts.
PART_BYTES = 8 << 20
LEAST_PARTS = 8


# ---- packed arrays -------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, compressed.  Their lengths and types come first."""
    head = [len(arrays)]
    body = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head += [len(a), a.itemsize]
        body.append(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() if len(a) else b"")
    return zstandard.ZstdCompressor(level=1).compress(np.array(head, "<i8").tobytes() + b"".join(body))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head = np.frombuffer(raw, "<i8", 2 * n, 8)
    at, out = 8 + 16 * n, []
    for k in range(n):
        size, width = int(head[2 * k]), int(head[2 * k + 1])
        planes = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(-1))
        at += size * width
    return out


def delta(a: np.ndarray) -> np.ndarray:
    return np.diff(a.astype(np.uint32), prepend=np.uint32(0)).astype(np.uint32)


def undelta(a: np.ndarray) -> np.ndarray:
    return np.cumsum(a, dtype=np.uint32)


def by(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value of ``key`` with the places where it stands, in order."""
    order = np.argsort(key, kind="stable")
    if not len(order):
        return
    held = key[order]
    for place in np.split(order, np.flatnonzero(held[1:] != held[:-1]) + 1):
        yield int(key[place[0]]), place


# ---- the documents of a part ---------------------------------------------


class Part:
    """The distinct documents of a part in a fixed order.  A document whose
    text also belongs to a smaller id of the part is a follower: it has no
    suffixes of its own, as it is repeated as a whole."""

    def __init__(self, t: pa.Table) -> None:
        self.rows = list(zip(t["id"].to_pylist(), t["h"].to_pylist()))
        texts = t["text"]
        first: dict[tuple[int, int], bytes] = {}
        for i, key in enumerate(self.rows):
            if key not in first:
                first[key] = (texts[i].as_py() or "").encode("utf-8", "surrogatepass")
        self.texts = first
        owner: dict[bytes, tuple[int, int]] = {}
        for key in sorted(first):
            owner.setdefault(hashlib.blake2b(first[key], digest_size=24).digest(), key)
        self.leaders = sorted(owner.values())
        self.place = {key: i for i, key in enumerate(self.leaders)}

    def follower(self, key: tuple[int, int]) -> bool:
        return key not in self.place


# ---- 1: runs of windows with one minimizer ---------------------------------


def minimizer_runs(buf: np.ndarray, valid: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows that are valid: start, number of windows and minimizer
    hash of each maximal run with one minimizer."""
    x = np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,))
    n = len(buf) - GRAM + 1
    h = np.zeros(n, np.uint64)
    for at in range(0, GRAM, 8):
        h += x[at : at + n] * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    span, have = length - GRAM + 1, 1
    while 2 * have <= span:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    if span > have:
        h = np.minimum(h[: len(h) - (span - have)], h[span - have :])
    new = valid.copy()
    new[1:] &= (h[1:] != h[:-1]) | ~valid[:-1]
    starts = np.flatnonzero(new)
    seen = np.cumsum(valid)
    before = seen[starts] - 1
    return starts, np.diff(np.r_[before, seen[-1] if len(seen) else 0]), h[starts]


def _pieces(part: Part, length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    held, size = [], 0
    for i, key in enumerate(part.leaders):
        t = part.texts[key]
        for at in range(0, len(t) - length + 1, PIECE):
            held.append((i, at, t[at : at + PIECE + length - 1]))
            size += len(held[-1][2])
            if size >= 2 * PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


def _anchors(t: pa.Table, buckets: int, length: int) -> pa.Table:
    part = Part(t)
    docs, starts, counts, hashes = [], [], [], []
    for pieces in _pieces(part, length):
        buf = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
        size = np.array([len(p[2]) for p in pieces])
        ends = np.cumsum(size)
        valid = np.ones(len(buf) - length + 1, bool)
        for e in ends[:-1].tolist():
            valid[e - length + 1 : e] = False
        s, n, h = minimizer_runs(buf, valid, length)
        k = np.searchsorted(ends, s, "right")
        docs.append(np.array([p[0] for p in pieces])[k])
        starts.append(s - (ends - size)[k] + np.array([p[1] for p in pieces])[k])
        counts.append(n)
        hashes.append(h)
    out_b, out_p = [], []
    if docs:
        d, s, n, h = map(np.concatenate, (docs, starts, counts, hashes))
        rest = h // np.uint64(buckets)
        for b, at in by((h % np.uint64(buckets)).astype(np.int64)):
            out_b.append(b)
            out_p.append(pack((rest[at] & np.uint64(0xFFFFFFFF)).astype("<u4"), (rest[at] >> np.uint64(32) & np.uint64(255)).astype("<u1"), delta(d[at]), delta(s[at]), n[at].astype("<u4")))
    return pa.table({"bucket": pa.array(out_b, pa.int32()), "part": pa.array([t["part"][0].as_py()] * len(out_b), pa.int32()), "payload": pa.array(out_p, pa.binary())})


# ---- 2: minimizers of at least two documents ------------------------------


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """Buckets, one after the other, of batches that are sorted by bucket."""
    now, held = None, []
    for batch in batches:
        for b, p, data in zip(batch["bucket"].to_pylist(), batch["part"].to_pylist(), batch["payload"]):
            if b != now and held:
                yield now, held
                held = []
            now = b
            held.append((p, data.as_py()))
    if held:
        yield now, held


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bucket, blobs in _grouped(batches):
        low, high, doc, start, count, part = [], [], [], [], [], []
        for p, data in blobs:
            a, b, d, s, n = unpack(data)
            low.append(a.astype(np.uint64))
            high.append(b.astype(np.uint64))
            doc.append(undelta(d))
            start.append(undelta(s))
            count.append(n)
            part.append(np.full(len(a), p, np.int64))
        key = np.concatenate(low) | np.concatenate(high) << np.uint64(32)
        doc, start, count, part = map(np.concatenate, (doc, start, count, part))
        who = part.astype(np.uint64) << np.uint64(32) | doc.astype(np.uint64)
        order = np.argsort(key, kind="stable")
        held = key[order]
        cuts = np.flatnonzero(np.r_[True, held[1:] != held[:-1]])
        two = np.minimum.reduceat(who[order], cuts) != np.maximum.reduceat(who[order], cuts)
        group = np.empty(len(key), np.uint32)
        group[order] = np.repeat(np.where(two, np.cumsum(two) - 1, 0).astype(np.uint32), np.diff(np.r_[cuts, len(key)]))
        taken = np.empty(len(key), bool)
        taken[order] = np.repeat(two, np.diff(np.r_[cuts, len(key)]))
        parts, data = [], []
        chosen = np.flatnonzero(taken)
        for p, at in by(part[chosen]):
            at = chosen[at]
            parts.append(p)
            data.append(pack(delta(doc[at]), delta(start[at]), count[at].astype("<u4"), group[at]))
        yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(parts), pa.int32()), pa.array(parts, pa.int32()), pa.array(data, pa.binary())], names=["bucket", "part", "payload"])


# ---- 3: their bytes ---------------------------------------------------------


def _contexts(texts: pa.Table, runs: pa.Table, length: int) -> pa.Table:
    """Rows for the buckets: of each kind its windows, group, least and greatest
    id, and bytes.  And one row for the part itself, with the bucket -1 - part:
    of each run its bucket, document, start and kind."""
    buckets, data, own = [], [], []
    p = texts["part"][0].as_py() if texts.num_rows else 0
    if runs.num_rows and texts.num_rows:
        part = Part(texts)
        whole = np.frombuffer(b"".join(part.texts[k] for k in part.leaders), np.uint8)
        size = np.array([len(part.texts[k]) for k in part.leaders])
        at = np.cumsum(size) - size
        ids = np.array([k[0] for k in part.leaders], np.int64)
        raw = whole.tobytes()
        for b, payload in zip(runs["bucket"].to_pylist(), runs["payload"]):
            d, s, n, g = unpack(payload.as_py())
            d, s, n = undelta(d), undelta(s), n.astype(np.int64)
            first = at[d] + s
            known: dict[tuple[int, bytes], int] = {}
            kind = np.empty(len(d), np.int64)
            of: list[int] = []
            for r, (k, x, m) in enumerate(zip(g.tolist(), first.tolist(), n.tolist())):
                kind[r] = found = known.setdefault((k, raw[x : x + m + length - 1]), len(of))
                if found == len(of):
                    of.append(r)
            low, high = np.full(len(of), LAST, np.int64), np.full(len(of), -(1 << 63), np.int64)
            np.minimum.at(low, kind, ids[d])
            np.maximum.at(high, kind, ids[d])
            buckets.append(b)
            data.append(pack(n[of].astype("<u4"), g[of], low.view("<u8"), high.view("<u8"), whole[ranges(first[of], n[of] + length - 1)]))
            own.append((np.full(len(d), b, np.uint32), d, s, kind.astype("<u4")))
        buckets.append(-1 - p)
        data.append(pack(*map(np.concatenate, zip(*own))))
    return pa.table({"bucket": pa.array(buckets, pa.int32()), "part": pa.array([p] * len(buckets), pa.int32()), "payload": pa.array(data, pa.binary())})


# ---- 4: the radix sort --------------------------------------------------------


def equal_suffixes(buf: np.ndarray, places: np.ndarray, label: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Most-significant-digit passes over the suffixes at ``places``, through
    ``length`` bytes; only suffixes with the same label are compared.  Returns
    the indexes of the suffixes that have an equal one, in order, and the
    number of each one's group."""
    active = np.arange(len(places))
    label = label.astype(np.int64)
    # the last digit overlaps the one before, so that none reads past the end
    for at in [*range(0, length - 8, 8), length - 8]:
        digit = np.ndarray((len(buf) - 7,), ">u8", buf, 0, (1,))[places[active] + at].astype(np.uint64)
        order = np.lexsort((digit, label))
        digit, label, active = digit[order], label[order], active[order]
        new = np.r_[True, (digit[1:] != digit[:-1]) | (label[1:] != label[:-1])] if len(active) else np.zeros(0, bool)
        label = np.cumsum(new)
        several = np.bincount(label)[label] > 1 if len(label) else np.zeros(0, bool)
        active, label = active[several], label[several]
    return active, label


def window_lows(count: np.ndarray, group: np.ndarray, low: np.ndarray, buf: np.ndarray, length: int) -> np.ndarray:
    """Of kinds with these numbers of windows, groups and least ids, and their
    bytes: the least id that has each window, kind by kind."""
    size = count + length - 1
    ends = np.cumsum(size)
    raw = buf.tobytes()
    known: dict[tuple[int, bytes], int] = {}
    same = np.empty(len(count), np.int64)
    of: list[int] = []
    for r, (g, a, e) in enumerate(zip(group.tolist(), (ends - size).tolist(), ends.tolist())):
        same[r] = k = known.setdefault((g, raw[a:e]), len(of))
        if k == len(of):
            of.append(r)
    del known
    of = np.array(of, np.int64)
    lowest = np.full(len(of), LAST, np.int64)
    np.minimum.at(lowest, same, low)
    windows = count[of]
    found = np.repeat(lowest, windows)
    active, label = equal_suffixes(buf, ranges((ends - size)[of], windows), np.repeat(group[of], windows), length)
    if len(active):
        cuts = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
        found[active] = np.repeat(np.minimum.reduceat(found[active], cuts), np.diff(np.r_[cuts, len(active)]))
    return found[ranges((np.cumsum(windows) - windows)[same], count)]


def stretches(count: np.ndarray, high: np.ndarray, lows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """kind, first window, windows and id of the maximal stretches of windows
    with one least id that is below the kind's greatest."""
    kind = np.repeat(np.arange(len(count)), count)
    new = np.r_[True, (kind[1:] != kind[:-1]) | (lows[1:] != lows[:-1])]
    opens = np.flatnonzero(new)
    sizes = np.diff(np.r_[opens, len(kind)])
    below = lows[opens] < high[kind[opens]]
    opens, sizes = opens[below], sizes[below]
    return kind[opens], opens - (np.cumsum(count) - count)[kind[opens]], sizes, lows[opens]


def _radix(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows of parts pass; rows of buckets become bucket, and of each kind of the
    part its stretches."""

    def split() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pc.greater_equal(batch["bucket"], 0))
            passed.append(batch.filter(pc.less(batch["bucket"], 0)))

    passed: list[pa.RecordBatch] = []
    for bucket, blobs in _grouped(split()):
        yield from passed
        passed.clear()
        cols = []
        for _, data in blobs:
            n, g, low, high, cut = unpack(data)
            cols.append((n.astype(np.int64), g, low.view(np.int64), high.view(np.int64), cut))
        count, group, low, high, buf = (np.concatenate(c) for c in zip(*cols))
        lows = window_lows(count, group, low, buf, length)
        parts, data, end = [], [], 0
        for (p, _), c in zip(blobs, cols):
            windows = int(c[0].sum())
            kind, first, size, least = stretches(c[0], c[3], lows[end : end + windows])
            end += windows
            if len(kind):
                parts.append(p)
                data.append(pack(kind.astype("<u4"), first.astype("<u4"), size.astype("<u4"), least.view("<u8")))
        yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(parts), pa.int32()), pa.array(parts, pa.int32()), pa.array(data, pa.binary())], names=["bucket", "part", "payload"])
    yield from passed
    release_memory()


# ---- 5: what is left -----------------------------------------------------------


def _removed(part: Part, rows: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first and end byte of what goes: the stretches that the buckets
    found, on every run of their kind that has a greater id."""
    own, found = [], []
    for bucket, payload in zip(rows["bucket"].to_pylist(), rows["payload"]):
        x = unpack(payload.as_py())
        if bucket < 0:
            own.append(x)
        else:
            found.append((np.full(len(x[0]), bucket, np.int64), *(c.astype(np.int64) for c in x[:3]), x[3].view(np.int64)))
    if not own or not found:
        return (np.zeros(0, np.int64),) * 3
    where, doc, start, kind = (np.concatenate(c).astype(np.int64) for c in zip(*own))
    bucket, of, first, size, least = (np.concatenate(c) for c in zip(*found))
    key, ask = bucket << 32 | of, where << 32 | kind
    order = np.argsort(key, kind="stable")
    key, first, size, least = key[order], first[order], size[order], least[order]
    low, high = np.searchsorted(key, ask, "left"), np.searchsorted(key, ask, "right")
    run, at = np.repeat(np.arange(len(ask)), high - low), ranges(low, high - low)
    ids = np.array([k[0] for k in part.leaders], np.int64)
    gone = ids[doc[run]] > least[at]
    run, at = run[gone], at[gone]
    begin = start[run] + first[at]
    return doc[run], begin, begin + size[at] + length - 1


def _finish(texts: pa.Table, spans: pa.Table, length: int) -> pa.Table:
    out: dict[str, list] = {"id": [], "n_bytes": [], "n_removed": [], "starts": [], "ends": [], "kept_sha256": []}
    if texts.num_rows:
        part = Part(texts)
        docs, begin, end = _removed(part, spans, length)
        order = np.lexsort((begin, docs))
        docs, begin, end = docs[order], begin[order], end[order]
        merged: dict[int, list[list[int]]] = {}
        for d, s, e in zip(docs.tolist(), begin.tolist(), end.tolist()):
            mine = merged.setdefault(d, [])
            if mine and s <= mine[-1][1]:
                mine[-1][1] = max(mine[-1][1], e)
            else:
                mine.append([s, e])
        done: dict[tuple[int, int], tuple] = {}
        for key in part.rows:
            if key not in done:
                t = part.texts[key]
                if part.follower(key):
                    cut = [[0, len(t)]] if len(t) >= length else []
                else:
                    cut = merged.get(part.place[key], [])
                left, at = hashlib.sha256(), 0
                for s, e in cut:
                    left.update(t[at:s])
                    at = e
                left.update(t[at:])
                done[key] = (len(t), sum(e - s for s, e in cut), [s for s, _ in cut], [e for _, e in cut], left.hexdigest())
            for name, v in zip(out, (None if key[0] == LAST else key[0], *done[key])):
                out[name].append(v)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string())
    return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds)})


def repeated_passages(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, buckets: int | None = None) -> DataFrame:
    """Per row of ``docs``: id, n_bytes, n_removed, starts and ends (bytes) of
    the maximal removed runs, kept_sha256.  See the module for the cases."""
    if length < GRAM + 8:
        raise ValueError(f"length must be {GRAM + 8} at least")
    if parts is None:
        total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
        parts = max(LEAST_PARTS, -(-total // PART_BYTES))
    buckets = buckets or parts
    given, number = F.col(id_col).cast("long"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    dealt = F.when(given.isNull(), F.xxhash64(F.lit(1), text_col)).otherwise(F.xxhash64(given))
    texts = docs.select(F.pmod(dealt, F.lit(parts)).cast("int").alias("part"), number.alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    packed = "bucket int, part int, payload binary"
    runs = texts.groupBy("part").applyInArrow(lambda t: _anchors(t, buckets, length), packed)
    shared = runs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_shared, packed)
    contexts = texts.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(lambda a, b: _contexts(a, b, length), packed)
    spans = contexts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: _radix(it, length), packed)
    return texts.groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(lambda a, b: _finish(a, b, length), "id long, n_bytes long, n_removed long, starts array<long>, ends array<long>, kept_sha256 string")


def documents_digest(docs: DataFrame) -> DataFrame:
    """The columns that ``op9_repeated_passages`` returns."""
    found = repeated_passages(docs)
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), "kept_sha256")


#: The same over all windows; a window stands for itself by 128 bits of hashes.
SQL = """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, encode(coalesce(text, '')) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT rid, k, p, hash(s) AS h, hash(s, 1) AS g
      FROM (SELECT rid, coalesce(doc_id, 9223372036854775807) AS k, p, array_slice(x, p + 1, p + 50) AS s FROM (SELECT *, unnest(range(n - 49)) AS p FROM d))),
m AS (SELECT h, g, min(k) AS low FROM w GROUP BY h, g HAVING min(k) < max(k)),
r AS (SELECT w.rid, w.p FROM w JOIN m ON w.h = m.h AND w.g = m.g AND w.k > m.low),
o AS (SELECT rid, p, sum(fresh) OVER (PARTITION BY rid ORDER BY p) AS run
      FROM (SELECT rid, p, coalesce(p > lag(p) OVER (PARTITION BY rid ORDER BY p) + 50, true)::INT AS fresh FROM r)),
u AS (SELECT rid, run, min(p) AS a, max(p) + 50 AS b FROM o GROUP BY rid, run),
c AS (SELECT rid, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, max(b) AS last,
             string_agg(CASE WHEN a > before THEN hex(array_slice(x, before + 1, a)) ELSE '' END, '' ORDER BY a) AS kept
      FROM (SELECT u.*, d.x, coalesce(lag(b) OVER (PARTITION BY u.rid ORDER BY a), 0) AS before FROM u JOIN d USING (rid)) GROUP BY rid)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(CASE WHEN last IS NULL THEN x ELSE unhex(kept || CASE WHEN last < n THEN hex(array_slice(x, last + 1, n)) ELSE '' END) END) AS kept_sha256
FROM d LEFT JOIN c USING (rid)
"""
