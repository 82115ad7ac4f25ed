"""Operator 11: exact Jaccard join of n-gram sets by a partition of the universe.

A document's set holds the distinct shingles of its words.  Two sets of a and b
members with a similarity of t or more differ in at most
H = floor((a + b)(1 - t) / (1 + t)) members.  Tokens are hashed into segments, as
many as the size band of the smaller set needs for more than H segments to hold
something; so two near sets agree in some segment that is not empty (pigeonhole).

1. Signatures.  A set is indexed in its own band by the subset that it holds in
   each segment, and asks there for sets that are not larger; if sets of the next
   smaller band can be near, it asks there too.  Small sets have one segment per
   token.  A set is named by a hash of its members, so that equal sets are one
   member of the index; tasks send each of theirs once.
2. Costs.  The postings are counted.  What no other set holds costs nothing, and
   goes here: most signatures do.
3. Allocation.  A set with e segments in use needs only H + 1 of them; it leaves
   out the e - H - 1 with the longest postings and asks for the others.  So a
   set that shares no more segments than it may leave out has no partner, and
   common openings, passages and lines are not looked up by those who hold more
   than these.
4. Families.  In each posting, those who ask are compared with one member of
   it; sets that are near form groups.  Then those who ask meet every other
   group of the posting: a row per set and group, however large it is.  Sets are
   compared with small groups pair by pair, with large ones in blocks.
5. One-deletion neighbourhoods.  Where more than ``HOT`` groups hold a subset, a
   set does not look it up but allows one difference in a segment that it shares
   with no one instead: such a segment counts twice, and its subset with each
   one token left out is looked up.  Only the holders of the posting need to be
   indexed by their neighbourhoods, for a partner that no other segment reveals
   is one of them.  Sets without enough such segments look up the posting.  What
   is hot here too (a template, of which many texts change a little) is compared
   in blocks: those who ask, and the holders, of postings that have a set in
   common which asks.
6. Every comparison counts the members that both sets hold.  Components come from
   alternating stars.

Sets are compared by 64-bit hashes of their members (an error needs a collision
within the two sets, below 10^-12 even for sets of a million).  Two unlike sets
with one name, and sets that leave too many segments empty (both below 10^-9 in
all for 10^9 documents), are noticed, and the join starts again with other hashes.

Work on texts that share most of their words without being near (a template) is
not linear: they ask for each other, and their groups are compared in blocks.

Defined results: a null or empty text, and one without words, has an empty set
and is its own component; null ids take part but never name a component unless
all its ids are null; equal sets are one class with all their rows; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismrank.llm._shared import broadcast_if_small, materialize, only, release_memory
from prismrank.llm.components import components
from prismrank.llm.exactdedup import fold
from prismrank.llm.nearstage import verified, verified_families

WIDTH = 5
PERCENT = 80
#: Sets below this size have one segment per token.
TOKENWISE = 48
#: Ratio of the bounds of size bands, at least.
GROWTH = 1.6
#: Segments beyond those that the pigeonhole needs: their share, and a number.
SPARE, EXTRA = 1.15, 28
#: Groups that hold a subset from which on it is not looked up.
HOT = 8
#: Members of groups that are listed.
LISTED = 8
#: Rows that a task holds of one posting before it passes them on.
PENDING = 1 << 18
NEVER = 1 << 30
IRREGULAR = -(1 << 31)
ROWS = "doc_id long, text_id long, uid long, other long, n int"
SIGNATURES = "key long, uid long, slack int"
SHARED = "key long, uid long, slack int, cost long"
PROBED = "key long, uid long, asks boolean, indexed boolean, root long"
MET = "uid long, label long, key long, asks boolean, indexed boolean"

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x87C37B91114253D5, 0x4CF5AD432745937F], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _ODD[3])
_FACTOR, _INVERSE = (np.uint64(x) for x in (0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)))
#: Bytes of a word above which it is hashed by itself: sums of powers can be made
#: to collide for words of a thousand bytes.
LONG_WORD = 64
_powers: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """Powers of the factor and of its inverse, as many as the longest block of
    texts had bytes."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(n, f)]) for f in (_FACTOR, _INVERSE)]
    return _powers


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of folded texts, and how many each text has.  A word's
    hash is a sum over its bytes, taken from sums over the whole block."""
    block = b" ".join([b"", *texts, b""])
    x = np.frombuffer(block, np.uint8)
    space = _SPACE[x]
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:]) + 1
    up, down = powers(len(x))
    sums = np.cumsum(_BYTES[x] * up[: len(x)])
    w = mix((sums[ends - 1] - sums[starts - 1]) * down[starts])
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        w[i] = xxhash.xxh64_intdigest(block[starts[i] : ends[i]])
    upto = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
    return w, np.diff(np.r_[0, upto])


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def token_sets(texts: list[str | None], width: int, salt: int) -> list[np.ndarray]:
    """Of each text the distinct 64-bit hashes, in order, of its shingles (of all
    words, if there are fewer).  Shingles of all texts are hashed at once, and
    those that reach from one text into the next are left out."""
    w, n = word_hashes([fold(t) for t in texts])

    def hashed(w: np.ndarray, k: int) -> np.ndarray:
        h = np.full(max(0, len(w) - k + 1), np.uint64(salt * 0x2545F4914F6CDD1D + k & (1 << 64) - 1))
        for t in range(k):
            h = h * _ODD[0] + w[t : len(w) - k + 1 + t]
        return mix(h)

    whole, out, at = hashed(w, width), [], 0
    for m in n.tolist():
        few = hashed(w[at : at + m], m) if 0 < m < width else whole[at : at + max(0, m - width + 1)]
        out.append(distinct(few))
        at += m
    return out


def named(x: np.ndarray, salt: int) -> tuple[int, int]:
    """Two signed names of a set."""
    data = x.tobytes()
    a, b = xxhash.xxh64_intdigest(data, salt), xxhash.xxh64_intdigest(data, salt + 1000)
    return a - (a >> 63 << 64), b - (b >> 63 << 64)


class Bands:
    """Size bands, and the segments of each."""

    def __init__(self, percent: int = PERCENT, tokenwise: int = TOKENWISE) -> None:
        self.percent = percent
        growth, bounds = max(GROWTH, 1.28 * 100 / percent), [1, tokenwise]
        while bounds[-1] < 1 << 40:
            bounds.append(int(bounds[-1] * growth) + 1)
        self.bounds = np.array(bounds, np.int64)
        tops = (100 * (self.bounds[1:] - 1) // percent + self.bounds[1:] - 1).tolist()
        self.segments = [0] + [int(SPARE * (self.differing(t) + 1)) + EXTRA for t in tops[1:]]

    def differing(self, both: int) -> int:
        """Members in which near sets of so many members together may differ."""
        return both * (100 - self.percent) // (100 + self.percent)

    def views(self, n: int) -> list[tuple[int, int, bool]]:
        """Bands in which a set of n members takes part: band, segments that it
        needs to ask for (0: none), whether it is indexed there."""
        k = int(np.searchsorted(self.bounds, n, "right")) - 1
        most = self.differing(2 * n)
        found = [(k, most + 1 if most else 0, True)]
        low = int(self.bounds[k])
        if k and self.percent * n <= 100 * (low - 1):
            found.append((k - 1, self.differing(n + low - 1) + 1, False))
        return found

    def subsets(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the segments in use: number, sum of the members, first place and
        size; ``x`` is in the order of ``self.order``."""
        if not self.segments[k]:
            return np.zeros(len(x), np.uint64), x, np.arange(len(x)), np.ones(len(x), np.int64)
        segment = self.segment(x, k)
        first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        return segment[first], np.add.reduceat(x, first), first, np.diff(np.r_[first, len(x)])

    def segment(self, x: np.ndarray, k: int) -> np.ndarray:
        return ((x * _ODD[1]) >> np.uint64(33)) % np.uint64(self.segments[k])

    def order(self, x: np.ndarray, k: int) -> np.ndarray:
        return x[np.argsort(self.segment(x, k), kind="stable")] if self.segments[k] else x


def _keyed(k: int | np.ndarray, segment: np.ndarray, value: np.ndarray, kind: int = 0) -> np.ndarray:
    band = np.asarray(k, np.uint64) * np.uint64(4) + np.uint64(kind) << np.uint64(40)
    return mix(value + (segment + band) * _ODD[2])


def _slices(batches: Iterator[pa.RecordBatch], size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of some bytes of text together, or one row."""
    for batch in batches:
        at, ends = 0, np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
            yield batch.slice(at, to - at)
            at = to


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _named(batches: Iterator[pa.RecordBatch], width: int, salt: int) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        sets = token_sets(batch["text"].to_pylist(), width, salt)
        names = [named(x, salt) for x in sets]
        columns = [pa.array([a for a, _ in names], pa.int64()), pa.array([b for _, b in names], pa.int64()), pa.array([len(x) for x in sets], pa.int32())]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_id"], *columns], names=["doc_id", "text_id", "uid", "other", "n"])
    release_memory()


def signatures(sets: list[np.ndarray], entries: list[tuple[int, int]], bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the subsets that sets hold in the segments of a band (entries: set
    and band, none of them tokenwise), and how many each entry has: those of all
    entries at once."""
    k = np.array([b for _, b in entries], np.int64)
    size, m = np.array([len(sets[i]) for i, _ in entries], np.int64), np.array(bands.segments, np.int64)[k]
    x, base = np.concatenate([sets[i] for i, _ in entries]), np.cumsum(m) - m
    segment = ((x * _ODD[1]) >> np.uint64(33)) % np.repeat(m, size).astype(np.uint64)
    at = segment.astype(np.int64) + np.repeat(base, size)
    value = np.zeros(int(m.sum()), np.uint64)
    np.add.at(value, at, x)
    used = np.flatnonzero(np.bincount(at, minlength=len(value)))
    entry = np.repeat(np.arange(len(k)), m)[used]
    return _keyed(k[entry], (used - base[entry]).astype(np.uint64), value[used]), np.bincount(entry, minlength=len(k))


def _signatures(batches: Iterator[pa.RecordBatch], width: int, salt: int, bands: Bands) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in _slices(batches):
        sets, uids = [], []
        for x in token_sets(batch["text"].to_pylist(), width, salt):
            uid = named(x, salt)[0] if len(x) else None
            if uid is not None and uid not in seen:
                sets.append(x)
                uids.append(uid)
                if len(seen) < 1 << 20:
                    seen.add(uid)
        views = [(i, *v) for i, x in enumerate(sets) for v in bands.views(len(x))]
        parts = [(v, _keyed(0, np.zeros(1, np.uint64), sets[v[0]])) for v in views if not v[1]]
        wide = [v for v in views if v[1]]
        if wide:
            key, count = signatures(sets, [v[:2] for v in wide], bands)
            parts += zip(wide, np.split(key, np.cumsum(count)[:-1]))
        keys, uid, slack, times = [np.zeros(0, np.uint64)], [], [], []
        for (i, _, need, indexed), key in parts:
            spare = len(key) - need if need else NEVER
            keys.append(key if spare >= 0 else np.zeros(1, np.uint64))
            uid.append(uids[i])
            slack.append(IRREGULAR if spare < 0 else spare if indexed else -1 - spare)
            times.append(len(keys[-1]))
        columns = [np.repeat(np.array(c, np.int64), np.array(times, np.int64)) for c in (uid, slack)]
        yield pa.RecordBatch.from_arrays([_long(np.concatenate(keys)), pa.array(columns[0]), pa.array(columns[1], pa.int32())], names=["key", "uid", "slack"])
    release_memory()


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], bool]]:
    """Batches in the order of ``key``, their first column: columns of whole
    postings; or, of a very long one, a part, and whether it is one."""
    wait: list[list[np.ndarray]] = []
    going = False
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        key = columns[0]
        if wait and wait[0][0][0] != key[0] and going:
            yield [np.concatenate(c) for c in zip(*wait)], True
            wait, going = [], False
        last = int(np.searchsorted(key, key[-1]))
        if last:
            if going:
                first = int(np.searchsorted(key, key[0], "right"))
                yield [np.concatenate(c) for c in zip(*wait, [c[:first] for c in columns])], True
                going, wait = False, []
                columns, last = [c[first:] for c in columns], last - first
            if last or wait:
                yield [np.concatenate(c) for c in zip(*wait, [c[:last] for c in columns])], False
            wait = []
        elif wait and wait[0][0][0] != key[0]:
            yield [np.concatenate(c) for c in zip(*wait)], False
            wait = []
        wait.append([c[last:] for c in columns])
        if sum(len(c[0]) for c in wait) > PENDING:
            yield [np.concatenate(c) for c in zip(*wait)], True
            wait, going = [[c[-1:] for c in wait[-1]]], True  # the last row stays, to tell the posting
    if wait:
        yield [np.concatenate(c) for c in zip(*wait)], going
    release_memory()


def _starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


def _costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by key and uid: those of postings that others share, with the number
    of others that are indexed there."""
    for (key, uid, slack), part in _postings(batches):
        new = np.r_[True, (key[1:] != key[:-1]) | (uid[1:] != uid[:-1])]
        key, uid, slack = key[new], uid[new], slack[new]
        at = _starts(key)
        sizes = np.diff(np.r_[at, len(key)])
        indexed = (slack >= 0).astype(np.int64)
        held = np.repeat(np.add.reduceat(indexed, at), sizes)
        if part:  # at least so many
            held = np.full(len(key), PENDING)
        keep = (np.repeat(sizes, sizes) > 1) & (held > 0) | part | (slack == IRREGULAR)
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (key, uid, slack, held - indexed)], names=["key", "uid", "slack", "cost"])


def _probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by key, those that are indexed first: those of postings that some
    set asks for, and the first member that is indexed."""
    root = None
    for (key, _, uid, asks, indexed), part in _postings(batches):
        at = _starts(key)
        sizes = np.diff(np.r_[at, len(key)])
        first = uid[at]
        if part:
            root = (key[0], first[0]) if root is None or root[0] != key[0] else root
            first = np.array([root[1]])
        wanted = np.repeat(np.logical_or.reduceat(asks, at), sizes) | part
        root_of = np.repeat(first, sizes)
        yield pa.RecordBatch.from_arrays([pa.array(c[wanted]) for c in (key, uid, asks, indexed, root_of)], names=["key", "uid", "asks", "indexed", "root"])


def _met(batches: Iterator[pa.RecordBatch], hot: int) -> Iterator[pa.RecordBatch]:
    """Rows by key and label: every set that asks with every other group that is
    indexed (uid, label); of postings of more than ``hot`` such groups the rows
    themselves (label null)."""

    def out(uid, label, key, asks, indexed) -> pa.RecordBatch:
        none = pa.nulls(len(uid), pa.int64()) if label is None else pa.array(label)
        return pa.RecordBatch.from_arrays([pa.array(uid), none, pa.array(key), pa.array(asks), pa.array(indexed)], names=["uid", "label", "key", "asks", "indexed"])

    for (key, label, uid, asks, indexed), part in _postings(batches):
        at = _starts(key)
        ends = np.r_[at[1:], len(key)]
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in zip(at.tolist(), ends.tolist()):
            x = slice(a, b)
            groups = np.unique(label[x][indexed[x]])
            if not part and not asks[x].any():
                continue
            if len(groups) > hot or part:
                yield out(uid[x], None, key[x], asks[x], indexed[x])
                continue
            who, own = uid[x][asks[x]], label[x][asks[x]]
            step = max(1, PENDING // max(1, len(groups)))
            for s in range(0, len(who), step):
                i, j = np.nonzero(own[s : s + step, None] != groups[None])
                left.append(who[s : s + step][i])
                right.append(groups[j])
                if sum(map(len, left)) > PENDING:
                    yield _asked(left, right, out)
                    left, right = [], []
        if left and sum(map(len, left)):
            yield _asked(left, right, out)


def _asked(left: list[np.ndarray], right: list[np.ndarray], out) -> pa.RecordBatch:
    both = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], 1), axis=0)
    none = np.zeros(len(both), np.int64)
    return out(both[:, 0], both[:, 1], none, none == 0, none == 0)


def _neighbourhoods(batches: Iterator[pa.RecordBatch], width: int, salt: int, bands: Bands) -> Iterator[pa.RecordBatch]:
    """Texts with the postings that their sets gave up (``dropped``), all that
    others share (``shared``) and those in which they are indexed (``held``):
    rows key, uid, asks, indexed of the one-deletion index.  A subset and another
    that differs from it by one token meet as a subset of the one and a subset
    less a token of the other; kinds 1 and 2 tell which of them asks."""
    for batch in _slices(batches, 1 << 18):
        keys, flags = [np.zeros(0, np.uint64)], []
        for x, dropped, shared, held in zip(token_sets(batch["text"].to_pylist(), width, salt), batch["dropped"], batch["shared"], batch["held"]):
            uid, _ = named(x, salt)
            dropped, shared, held = (np.array(c.as_py() or [], np.int64).view(np.uint64) for c in (dropped, shared, held))
            if len(held):
                keys.append(held)
                flags.append((len(held), uid, False, True))
            for k, _, indexed in bands.views(len(x)):
                y = bands.order(x, k)
                segment, value, first, size = bands.subsets(y, k)
                key = _keyed(k, segment, value)
                whose = np.repeat(np.arange(len(value)), size)
                less = value[whose] - y  # each subset with one token left out
                if indexed and len(held) and bands.segments[k]:
                    keys += [_keyed(k, segment[whose], less, 1), _keyed(k, segment, value, 2)]
                    flags += [(len(less), uid, False, True), (len(value), uid, False, True)]
                gone = key[np.isin(key, dropped)]
                free = np.flatnonzero((size > 1) & ~np.isin(key, shared))[: len(gone)] if bands.segments[k] else []
                if len(free):
                    near = np.isin(whose, free)
                    keys += [_keyed(k, segment[free], value[free], 1), _keyed(k, segment[whose[near]], less[near], 2)]
                    flags += [(len(free), uid, True, False), (int(near.sum()), uid, True, False)]
                keys.append(gone[len(free) :])
                flags.append((len(keys[-1]), uid, True, False))
        n = [f[0] for f in flags]
        uids, asks, indexed = (np.repeat(np.array([f[i] for f in flags], kind), n) for i, kind in ((1, np.int64), (2, bool), (3, bool)))
        yield pa.RecordBatch.from_arrays([_long(np.concatenate(keys)), *map(pa.array, (uids, asks, indexed))], names=["key", "uid", "asks", "indexed"])
    release_memory()


def _sets(batches: Iterator[pa.RecordBatch], width: int, salt: int) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        sets = token_sets(batch["text"].to_pylist(), width, salt)
        yield pa.RecordBatch.from_arrays([pa.array([named(x, salt)[0] for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["uid", "shingles"])
    release_memory()


class Join:
    """The sets of ``docs`` and what they share."""

    def __init__(self, docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, tokenwise: int = TOKENWISE) -> None:
        self.width, self.similarity, self.bands = width, percent / 100, Bands(percent, tokenwise)
        self.texts = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_id"))
        bands, salt = self.bands, 0
        while True:
            self.salt = salt
            self.rows = materialize(self.texts.mapInArrow(lambda it, s=salt: _named(it, width, s), ROWS), "named")
            unlike = self.rows.groupBy("uid").agg(F.min("other").alias("x"), F.max("other").alias("y")).filter("x <> y")
            if unlike.isEmpty():
                signatures = self.texts.select("text").mapInArrow(lambda it, s=salt: _signatures(it, width, s, bands), SIGNATURES)
                dealt = signatures.repartition("key").sortWithinPartitions("key", "uid")
                self.shared = materialize(dealt.mapInArrow(_costs, SHARED), "shared")
                if self.shared.filter(F.col("slack") == IRREGULAR).isEmpty():
                    break
            salt += 1

    def of(self, asked: DataFrame) -> DataFrame:
        """One text of each set of ``asked`` (uid and others): text, and these."""
        one = self.rows.groupBy("uid").agg(F.min("text_id").alias("text_id"))
        asked = broadcast_if_small(materialize(asked.join(one, "uid"), "asked"))
        return self.texts.select("text_id", "text").join(asked, "text_id")

    def sets(self, uids: DataFrame) -> DataFrame:
        texts = self.of(uids.distinct()).select("text")
        found = texts.mapInArrow(lambda it, w=self.width, s=self.salt: _sets(it, w, s), "uid long, shingles binary")
        return materialize(found.dropDuplicates(["uid"]), "shingles")

    def probed(self) -> DataFrame:
        """Rows of the postings that are asked for, after allocation."""
        spare = F.when(F.col("slack") < 0, -1 - F.col("slack")).otherwise(F.col("slack"))
        longest = Window.partitionBy("uid", "slack").orderBy(F.col("cost").desc(), "key")
        asks = (F.row_number().over(longest) > spare) & (F.col("cost") > 0)
        rows = self.shared.select("key", "uid", asks.alias("asks"), (F.col("slack") >= 0).alias("indexed"))
        dealt = rows.select("key", (~F.col("indexed")).cast("int").alias("later"), "uid", "asks", "indexed").repartition("key").sortWithinPartitions("key", "later", "uid")
        return materialize(dealt.mapInArrow(_probed, PROBED), "probed")

    def met(self, rows: DataFrame, label: DataFrame, hot: int) -> DataFrame:
        known = rows.join(label, "uid", "left").select("key", F.coalesce("label", "uid").alias("label"), "uid", "asks", "indexed")
        dealt = known.repartition("key").sortWithinPartitions("key", "label")
        return materialize(dealt.mapInArrow(lambda it: _met(it, hot), MET), "met")

    def neighbourhoods(self, hot: DataFrame) -> DataFrame:
        """The one-deletion index of the holders of hot postings."""
        of = hot.groupBy("uid").agg(F.collect_set(F.when(F.col("asks"), F.col("key"))).alias("dropped"), F.collect_set(F.when(F.col("indexed"), F.col("key"))).alias("held"))
        asking = hot.filter("asks").select("uid").distinct()
        shared = self.shared.join(broadcast_if_small(materialize(asking, "asking")), "uid", "left_semi").groupBy("uid").agg(F.collect_set("key").alias("shared"))
        texts = self.of(of.join(shared, "uid", "left")).select("text", "dropped", "shared", "held")
        args = self.width, self.salt, self.bands
        return materialize(texts.mapInArrow(lambda it: _neighbourhoods(it, *args), "key long, uid long, asks boolean, indexed boolean"), "deletions")

    def links(self, hot: int = HOT) -> DataFrame:
        """Links u, v of sets; they connect all that near sets connect."""
        probed = self.probed()
        stars = materialize(probed.filter("asks AND uid <> root").select(F.col("uid").alias("u"), F.col("root").alias("v")).distinct(), "stars")
        ends = lambda df: df.select(F.col("u").alias("uid")).union(df.select("v"))
        first = materialize(verified(stars, self.sets(ends(stars)), self.similarity), "verified")
        group = materialize(components(first).toDF("uid", "label"), "groups")
        label = broadcast_if_small(group)

        met = self.met(probed.select("key", "uid", "asks", "indexed"), label, hot)
        asked, left = met.filter("label is not null").select("uid", "label"), met.filter("label is null").select("key", "uid", "asks", "indexed")
        asks = members = None
        if not left.isEmpty():
            again = self.met(self.neighbourhoods(left), label, hot)
            asked = asked.union(again.filter("label is not null").select("uid", "label"))
            asks, members = clouds(again.filter("label is null").drop("label"))

        # those asked for: small groups member by member, large ones as a whole
        size = broadcast_if_small(materialize(group.groupBy("label").agg(F.count(F.lit(1)).alias("size")), "sizes"))
        asked = materialize(asked.distinct().join(size, "label", "left").withColumn("size", F.coalesce("size", F.lit(1))), "asks")
        few = group.join(size, "label").filter(F.col("size") <= LISTED).select("label", F.col("uid").alias("member"))
        pairs = asked.filter(F.col("size") <= LISTED).join(few, "label", "left").select(F.col("uid").alias("x"), F.coalesce("member", "label").alias("y"))
        pairs = materialize(pairs.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "pairs")
        large = asked.filter(F.col("size") > LISTED).select("uid", "label", "size")
        within = group.join(size, "label").join(large.select("label").distinct(), "label", "left_semi").select("uid", "label", "size")
        asks, members = (large, within) if asks is None else (asks.union(large), members.union(within))
        sets = self.sets(ends(pairs).union(asks.select("uid")).union(members.select("uid")))
        named_sets = sets.join(label.withColumnRenamed("label", "kind"), "uid", "left").withColumn("kind", F.coalesce("kind", "uid"))
        return first.union(verified(pairs, sets, self.similarity)).union(verified_families(asks, members, named_sets, self.similarity))

    def components(self, hot: int = HOT) -> DataFrame:
        """doc_id, n_shingles and component_id of every row."""
        roots = components(self.links(hot)).toDF("uid", "root")
        classes = self.rows.filter("n > 0").groupBy("uid").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("rows"))
        classes = classes.join(roots, "uid", "left").filter("rows > 1 OR root IS NOT NULL").select("uid", "low", F.coalesce("root", "uid").alias("root"))
        classes = materialize(classes, "classes")
        lowest = classes.groupBy("root").agg(F.min("low").alias("component_id"))
        known = broadcast_if_small(materialize(classes.join(lowest, "root").select("uid", "component_id"), "known"))
        found = F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
        return self.rows.join(known, "uid", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), found.alias("component_id"))


def clouds(hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Who asks, and who is asked, where postings are hot still: postings that
    have a set in common that asks are one cloud (uid, label, size).  What is
    made is a row per set and cloud, not one per pair."""
    edges = materialize(hot.filter("asks").select(F.col("uid").alias("u"), F.col("key").alias("v")).distinct(), "edges")
    of = materialize(components(edges).select("node", F.xxhash64(F.lit("cloud"), "root").alias("label")), "clouds")
    held = hot.filter("indexed").join(of.withColumnRenamed("node", "key"), "key").select("uid", "label").distinct()
    size = held.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    size = broadcast_if_small(materialize(size, "sizes"))
    asks = edges.select(F.col("u").alias("node")).distinct().join(of, "node").select(F.col("node").alias("uid"), "label").join(size, "label")
    return (materialize(x.select("uid", "label", "size"), tag) for x, tag in ((asks, "asking"), (held.join(size, "label"), "asked")))


def documents_digest(docs: DataFrame) -> DataFrame:
    """The columns that ``op11_ngram_jaccard_join`` returns."""
    return Join(docs, WIDTH, PERCENT).components()


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_ FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT x, y FROM i JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * both_ >= 80 * (a.n + b.n - both_)),
c(x, y) AS (SELECT x, y FROM e UNION SELECT c.x, e.y FROM c JOIN e ON c.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x, min(y) AS low FROM c GROUP BY x) m ON m.x = d.doc_id
"""
