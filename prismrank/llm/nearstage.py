"""Near-duplicate stage: wide SimHash over a byte-position inverted index, and
an exact search for short texts.

Documents are near duplicates at a Jaccard similarity of 0.8 or more of their
five-word shingles.  Of 64 bits, pairs at that similarity differ in about ten,
so the narrow fingerprint of operator 4 would miss most of them; here a
fingerprint has 1024 bits, 128 positional bytes:

1. the inverted index has one posting per pair of neighbouring byte positions
   (128 postings of 16 bits per document); a pair at 0.8 shares any one of
   them with probability 0.07, and at least one with 0.999;
2. inside a posting, members meet by their first 256 bits and their numbers of
   shingles, which may not differ by more than the similarity allows.  Of every
   eighth posting, large ones emit a spanning forest of the members that meet
   (small ones all pairs);
3. per distinct link, the shared positional bytes are tallied over all 128
   positions; links that reach the minimum and do not differ in clearly more
   bits than pairs at 0.8 do form families.  They are verified: the shingles
   themselves are compared (texts of these are read again); links that hold form
   first groups inside the families;
4. every member of a family that is not in its largest group is compared with the
   whole family, in blocks of bounded size, by counting its shingles in an index
   of the block's;
5. every posting emits, for all pairs that meet across families, the member of
   the smaller family and the larger family, and these are compared likewise.
   Pairs that share a posting among the first 32 positions are emitted there
   alone.  Texts that have nothing in common do not meet (a probability below
   10^-16 a comparison);
6. components come from alternating stars; the smallest id of each stays.

The bits of few shingles say little, so pairs with a set of up to ``SHORT``
shingles are not searched by bits: sets have a posting for each of the first
hashes of which near sets must share one (the prefix filter; hashes that many
sets hold come last, so that texts with a common opening do not meet by it), and meet unless
bitmaps of their hashes prove that they differ in too many.  Both are lossless.

What travels grows with the number of documents: a group of equal or very near
copies costs a few links per member, and members of a family that are near to
none (a shared template) some blocks each.  Their comparisons, of 256 shingle
sets at a time, grow with the square of the family.
With many more documents than 10^8, use three bytes per posting (``key_bytes``)
and more words.

Defined results: a null text is empty; texts without words are equal to one
another; null ids rank above all others, so such a row stays only if its group
has no other; of rows with equal id and text one stays; an empty table gives
an empty result; all columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismrank.llm._shared import broadcast_if_small, materialize, ranges, release_memory, renamed
from prismrank.llm.components import components
from prismrank.llm.exactdedup import fold

WIDTH = 5
SIMILARITY = 0.8
WORDS = 16  # of 64 bits
SEED = 42
#: Words of a fingerprint, of 64 bits, that postings hold.
HEAD = tuple(f"w{k}" for k in range(4))
#: Their differing bits up to which members of a posting meet: four standard
#: errors above the mean at a similarity of 0.8 (5 in 100,000 exceed it).
MEET_BITS = 62
#: Postings of up to so many members emit every pair that is near.
SMALL = 8
#: Of so many byte positions one has a posting for the first groups.
FIRST_STEP = 8
#: Pairs of members that are compared, and links that are held, at once.
PAIRS = 1 << 20
#: Half the standard errors of the differing bits above which a pair surely is
#: not near.
CLEAR = 2.5
#: Shingles of a set up to which its pairs are searched without loss; above,
#: pairs at 0.8 differ in at most two bits of 1024 more than large sets.
SHORT = 64
#: Members of a large family, and those that ask for it, that meet in one task.
BLOCK = 256
#: First hashes of short sets that have a posting for the first groups.
FIRST_HASHES = 4
#: Short sets that hold a hash from which on it counts as frequent, and frequent
#: hashes that are told apart.
OFTEN, FREQUENT = 64, 1 << 16
ROWS = "uid long, other long, doc long, w0 long, w1 long, w2 long, w3 long, fp binary, n int, short binary"
POSTINGS = "posting long, uid long, label long, size long, w0 long, w1 long, w2 long, w3 long, n long"
SHORT_POSTINGS = "posting long, uid long, label long, size long, s0 long, s1 long, s2 long, s3 long, n long"


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles (of all words, if fewer)."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if n <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(size + 1) - 1
    first, last = (ends - size)[: n - width + 1].tolist(), ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter([digest(joined[x:y], SEED) for x, y in zip(first, last)], np.uint64, n - width + 1))


_STEPS = (np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]


def wide_fingerprint(h: np.ndarray, words: int = WORDS) -> bytes:
    """Majority of each of ``words`` * 64 bits derived from the hashes."""
    ones = np.zeros(words * 64, np.int64)
    for k in range(0, len(h), 255):  # so that sums of a block fit a byte
        x = h[k : k + 255, None] + _STEPS[:, :words]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(h)).tobytes()


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int, words: int, most: int) -> Iterator[pa.RecordBatch]:
    """``short``: the hashes of sets of up to ``most``, null for others."""
    for batch in _slices(batches):
        sets = [shingle_hashes(fold(t.as_py()).split(), width) for t in batch["text"]]
        fps = [wide_fingerprint(h, words) for h in sets]
        head = np.frombuffer(b"".join(f[: 8 * len(HEAD)] for f in fps), "<i8").reshape(-1, len(HEAD)).T
        n, short = pa.array([len(h) for h in sets], pa.int32()), pa.array([h.tobytes() if len(h) <= most else None for h in sets], pa.binary())
        yield pa.RecordBatch.from_arrays([batch["uid"], batch["other"], batch["doc"], *map(pa.array, head), pa.array(fps, pa.binary()), n, short], names=["uid", "other", "doc", *HEAD, "fp", "n", "short"])
    release_memory()


def _postings(batches: Iterator[pa.RecordBatch], words: int, key_bytes: int, every: int = 1) -> Iterator[pa.RecordBatch]:
    n, place = words * 8, np.arange(0, words * 8, every)
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            some = batch.slice(at, 500)
            fp = np.frombuffer(b"".join(some["fp"].to_pylist()), np.uint8).reshape(some.num_rows, words * 8).astype(np.int64)
            key = np.broadcast_to(place, (some.num_rows, len(place))).copy()
            for k in range(key_bytes):
                key = key << 8 | fp[:, (place + k) % n]
            cols = [np.repeat(some[c].to_numpy(zero_copy_only=False).astype(np.int64), len(place)) for c in ("uid", "label", "size", *HEAD, "n")]
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1)), *map(pa.array, cols)], names=["posting", "uid", "label", "size", *HEAD, "n"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(batch["short"].to_pylist()), np.int64))], names=["h"])


def frequent_hashes(one: DataFrame) -> np.ndarray:
    """The most frequent hashes of the short sets, from the most frequent on:
    those of at least ``OFTEN`` sets, at most ``FREQUENT``.  They order the
    hashes of a set; any one order loses nothing, so the bound costs no pair."""
    each = one.filter("short is not null").select("short").mapInArrow(_hashes, "h long")
    often = each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= OFTEN)
    return np.array([r.h for r in often.orderBy(F.col("n").desc(), "h").limit(FREQUENT).collect()], np.int64).view(np.uint64)


class RareFirst:
    """Hashes of a set from the rarest on: what is not frequent first, by hash."""

    def __init__(self, frequent: np.ndarray) -> None:
        order = np.argsort(frequent)
        self.known, self.place = frequent[order], len(frequent) - order

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return h
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return h[np.lexsort((h, np.where(self.known[at] == h, self.place[at], 0)))]


def _short_postings(batches: Iterator[pa.RecordBatch], similarity: float, first: int | None, rare_first: RareFirst) -> Iterator[pa.RecordBatch]:
    """Two sets that are near share one of the first n - ceil(n * similarity)
    + 1 hashes of each, in any order of all hashes: from the rarest on, so that
    a common opening or line is not among them.  Sets without hashes have the
    posting 0."""
    for batch in _slices(batches):
        keys, times, bits = [], [], np.zeros((batch.num_rows, 256), np.uint8)
        for k, x in enumerate(batch["short"]):
            h = np.frombuffer(x.as_py(), np.uint64)
            bits[k, (h & np.uint64(255)).astype(np.int64)] = 1
            prefix = rare_first(h)[: len(h) - int(np.ceil(len(h) * similarity - 1e-9)) + 1][:first] if len(h) else np.zeros(1, np.uint64)
            keys.append(prefix)
            times.append(len(prefix))
        if not keys:
            continue
        bitmap = np.packbits(bits, axis=1).view(np.int64)
        cols = [batch["uid"].to_numpy(), batch["label"].to_numpy(), batch["size"].to_numpy(), *bitmap.T, batch["n"].to_numpy().astype(np.int64)]
        arrays = [np.concatenate(keys).view(np.int64), *(np.repeat(c, times) for c in cols)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, arrays)], names=["posting", "uid", "label", "size", "s0", "s1", "s2", "s3", "n"])


def _excess(x: np.ndarray, y: np.ndarray, most: int | float) -> np.ndarray:
    """By how much members (rows of words of bits, and the set's size) differ
    too much to meet.  ``most``: bits of fingerprints, which may differ; or, for
    bitmaps of sets, a similarity: each bit that differs is a hash that only one
    of the sets has."""
    far = np.bitwise_count(x[..., :-1] ^ y[..., :-1]).sum(-1, dtype=np.int16)
    n, m = x[..., -1].astype(np.int64), y[..., -1].astype(np.int64)
    if isinstance(most, int):  # near sets have sizes within the similarity
        return np.where(np.minimum(n, m) < SIMILARITY * np.maximum(n, m) - 1e-6, 1 << 12, far - most)
    return far * (1 + most) - (1 - most) * (n + m) - 1e-6


def near_forest(uid: np.ndarray, a: np.ndarray, bits: int | float, out: list) -> None:
    """Links between members that meet (see ``_excess`` for ``bits``): all of
    them for a few members, else those of a breadth-first forest, each between
    two members that are near themselves."""
    n = len(uid)
    if n <= SMALL:
        i, j = np.triu_indices(n, 1)
        near = _excess(a[i], a[j], bits) <= 0
        out.append((uid[i[near]], uid[j[near]]))
        return
    unseen = np.argsort(uid, kind="stable")
    while len(unseen) > 1:
        front, unseen = unseen[:1], unseen[1:]
        while len(front) and len(unseen):
            parent = np.full(len(unseen), -1)
            step = max(1, PAIRS // (len(unseen) * a[0].size))
            for k in range(0, len(front), step):
                open_ = np.flatnonzero(parent < 0)
                if not len(open_):
                    break
                f, u = front[k : k + step, None], unseen[None, open_]
                far = _excess(a[f], a[u], bits)
                near = far <= 0
                hit = near.any(0)
                parent[open_[hit]] = front[k : k + step][far[:, hit].argmin(0)]
            got = parent >= 0
            out.append((uid[parent[got]], uid[unseen[got]]))
            front, unseen = unseen[got], unseen[~got]


def emitted_before(x: np.ndarray, y: np.ndarray, place: np.ndarray, key_bytes: int) -> np.ndarray:
    """Whether pairs share a posting at an earlier position of the first bytes,
    which all members hold."""
    same = (x[:, :-1] ^ y[:, :-1]).astype("<u8").view(np.uint8).reshape(len(x), -1) == 0
    first = same.shape[1] - key_bytes + 1
    run = same[:, :first].copy()
    for k in range(1, key_bytes):
        run &= same[:, k : first + k]
    return (run & (np.arange(first) < place[:, None])).any(1)


def across(label: np.ndarray, a: np.ndarray, bits: int | float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of members with different labels that meet; members
    are in the order of their labels."""
    ends = np.searchsorted(label, label, "right")
    k = 0
    while k < len(label) and ends[k] < len(label):
        low = int(ends[k])
        stop = k + max(1, PAIRS // ((len(label) - low) * a.shape[1]))
        i, j = np.nonzero(_excess(a[k:stop, None], a[None, low:], bits) <= 0)
        i, j = i + k, j + low
        apart = label[i] < label[j]
        yield i[apart], j[apart]
        k = stop


def _meet(batches: Iterator[pa.RecordBatch], bits: int | float, forest: bool, key_bytes: int = 2) -> Iterator[pa.RecordBatch]:
    """Batches sorted by posting.  u, v, size: for a ``forest``, two members
    (and 1); else a member, and label and size of a family that is not smaller."""

    def links(key, uid, label, size, a) -> Iterator[tuple[np.ndarray, ...]]:
        def grouped(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
            if isinstance(bits, int) and len(i):
                new = ~emitted_before(a[i], a[j], key[i] >> 8 * key_bytes, key_bytes)
                i, j = i[new], j[new]
            less = (size[i] < size[j]) | ((size[i] == size[j]) & (label[i] < label[j]))
            return np.where(less, uid[i], uid[j]), np.where(less, label[j], label[i]), np.where(less, size[j], size[i])

        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        for d in range(1, SMALL):  # small postings together, by distance
            i = np.concatenate([starts[(sizes > d + k) & (sizes <= SMALL)] + k for k in range(SMALL - d)])
            i = i[(_excess(a[i], a[i + d], bits) <= 0) & (label[i] != label[i + d])]
            yield (uid[i], uid[i + d], np.ones(len(i), np.int64)) if forest else grouped(i, i + d)
        for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
            x = slice(s, s + n)
            if forest:
                found: list[tuple[np.ndarray, np.ndarray]] = []
                near_forest(uid[x], a[x], bits, found)
                for u, v in found:
                    yield u, v, np.ones(len(u), np.int64)
            else:
                order = s + np.argsort(label[x], kind="stable")
                for i, j in across(label[order], a[order], bits):
                    yield grouped(order[i], order[j])

    def out(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        key, uid, label, size, *a = (np.concatenate(c) for c in zip(*held))
        ready: list[tuple[np.ndarray, ...]] = []
        n = 0
        for more in links(key, uid, label, size, np.stack(a, 1).view(np.uint64)):
            ready.append(more)
            n += len(more[0])
            if n >= PAIRS:
                ready = [_distinct(ready)]
                if len(ready[0][0]) >= PAIRS // 2:
                    yield _link_batch(ready.pop())
                n = len(ready[0][0]) if ready else 0
        if ready:
            yield _link_batch(_distinct(ready))

    wait: list[list[np.ndarray]] = []
    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(batch.num_columns)]
        if not batch.num_rows:
            continue
        last = int(np.searchsorted(cols[0], cols[0][-1]))
        if last == 0 and wait and wait[0][0][0] == cols[0][0]:
            wait.append(cols)
            continue
        if last or wait:
            yield from out([*wait, [c[:last] for c in cols]])
        wait = [[c[last:] for c in cols]]
    if wait:
        yield from out(wait)
    release_memory()


def _distinct(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    u, v, size = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((v, u))
    u, v, size = u[order], v[order], size[order]
    new = np.ones(len(u), bool)
    new[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    return u[new], v[new], size[new]


def _link_batch(found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*map(pa.array, found)], names=["u", "v", "size"])


def most_differing(similarity: float, words: int = WORDS, errors: float = 0.0) -> int:
    """Differing bits of pairs of equally large sets at a Jaccard similarity,
    and so many standard errors more."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(64 * words * share + errors * np.sqrt(64 * words * share * (1 - share)))


def _tally(batches: Iterator[pa.RecordBatch], words: int, bits: int, least: int) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(batch.num_rows, words * 8) for c in ("fu", "fv"))
        near = (x == y).sum(1) >= least
        far = np.bitwise_count(x ^ y).sum(1, dtype=np.int32)
        keep = pa.array(near & (far <= bits))
        yield pa.RecordBatch.from_arrays([batch["u"].filter(keep), batch["v"].filter(keep)], names=["u", "v"])


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingle_hashes(fold(t.as_py()).split(), width).tobytes() for t in batch["text"]]
        yield pa.RecordBatch.from_arrays([batch["uid"], pa.array(found, pa.binary())], names=["uid", "shingles"])
    release_memory()


def _compare(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near = []
        for x, y in zip(batch["su"], batch["sv"]):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            near.append(both >= similarity * (len(x) + len(y) - both))
        keep = pa.array(near, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch["u"].filter(keep), batch["v"].filter(keep)], names=["u", "v"])


def _compare_blocks(asking: pa.Table, members: pa.Table, similarity: float) -> pa.Table:
    """Links of similar sets between those that ask and the members, each with
    the ``kind`` of its first group; of links that connect what links of this
    block already connect one."""
    u, v = [], []
    if asking.num_rows and members.num_rows:
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in members["shingles"]]
        size = np.array(list(map(len, sets)))
        hashes, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        order = np.argsort(hashes, kind="stable")
        hashes, owner = hashes[order], owner[order]
        ids, kinds = members["uid"].to_numpy(), members["kind"].to_numpy()
        above: dict[int, int] = {}

        def top(k: int) -> int:
            while (up := above.setdefault(k, k)) != k:
                above[k] = above[up]
                k = up
            return k

        for uid, kind, x in zip(asking["uid"].to_pylist(), asking["kind"].to_pylist(), asking["shingles"]):
            x = np.frombuffer(x.as_py(), np.uint64)
            low, high = np.searchsorted(hashes, x, "left"), np.searchsorted(hashes, x, "right")
            both = np.bincount(owner[ranges(low, high - low)], minlength=len(sets))
            near = np.flatnonzero((both >= similarity * (len(x) + size - both)) & (kinds != kind))
            for k, i in zip(*(c.tolist() for c in np.unique(kinds[near], return_index=True))):
                if top(k) != top(kind):
                    above[top(k)] = top(kind)
                    u.append(uid)
                    v.append(int(ids[near[i]]))
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def candidates(one: DataFrame, grouped: bool, rare_first: RareFirst, similarity: float = SIMILARITY, words: int = WORDS, key_bytes: int = 2) -> tuple[DataFrame, DataFrame]:
    """Links u, v, size (see ``_meet``) among ``one`` (uid, label, size,
    words of HEAD, fp, n, short), by fingerprints and by short sets.  ``grouped``: all that meet
    across labels; else forests of those that meet."""
    every, first = (1, None) if grouped else (FIRST_STEP, FIRST_HASHES)

    def met(postings: DataFrame, most: int | float) -> DataFrame:
        dealt = postings.repartition("posting").sortWithinPartitions("posting")
        return dealt.mapInArrow(lambda it: _meet(it, most, not grouped, key_bytes), "u long, v long, size long").distinct()

    large = one.filter(F.col("n") > SHORT).select("uid", "label", "size", *HEAD, "n", "fp")
    short = one.filter("short is not null").select("uid", "label", "size", "n", "short")
    return (
        met(large.mapInArrow(lambda it: _postings(it, words, key_bytes, every), POSTINGS), MEET_BITS),
        met(short.mapInArrow(lambda it: _short_postings(it, similarity, first, rare_first), SHORT_POSTINGS), float(similarity)),
    )


def tallied(links: DataFrame, one: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """Of the links u, v those whose whole fingerprints are near enough."""
    bits = most_differing(similarity, words, 2 * CLEAR)
    # a byte is shared if none of its bits differs: half of what is expected
    least = int(words * 8 * (1 - bits / (64 * words)) ** 8 / 2)
    fps = one.select("uid", "fp")
    ends = links.join(fps.toDF("u", "fu"), "u").join(fps.toDF("v", "fv"), "v").select("u", "v", "fu", "fv")
    return ends.mapInArrow(lambda it: _tally(it, words, bits, least), "u long, v long")


def shingle_sets(asked: DataFrame, texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """uid and shingles of those asked for.  ``texts``: uid, text."""
    asked = broadcast_if_small(materialize(asked.distinct(), "asked"))
    sets = texts.join(asked, "uid", "left_semi").mapInArrow(lambda it: _sets(it, width), "uid long, shingles binary")
    return materialize(sets.dropDuplicates(["uid"]), "shingles")


def verified(links: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Of the links u, v those whose shingles are similar."""
    pairs = links.join(sets.toDF("u", "su"), "u").join(sets.toDF("v", "sv"), "v")
    return pairs.select("u", "v", "su", "sv").mapInArrow(lambda it: _compare(it, similarity), "u long, v long")


def verified_families(asks: DataFrame, members: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links of similar sets between ``asks`` (uid, label, size) and ``members``
    (uid, label, size) of the same family; both are dealt out in blocks.
    ``sets``: uid, kind, shingles."""
    pieces = lambda n: F.ceil(F.col(n) / F.lit(BLOCK)).cast("int")
    block = lambda n: F.pmod(F.xxhash64(F.lit(7), "uid"), pieces(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), pieces(n) - 1))
    number = broadcast_if_small(materialize(asks.groupBy("label").agg(F.count(F.lit(1)).alias("asks")), "asks"))
    left, right = (df.join(number, "label").join(sets, "uid") for df in (asks, members))
    left = left.select("label", block("asks").alias("x"), each("size").alias("y"), "uid", "kind", "shingles")
    right = right.select("label", each("asks").alias("x"), block("size").alias("y"), "uid", "kind", "shingles").toDF(*left.columns)
    keys = ["label", "x", "y"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: _compare_blocks(a, b, similarity), "u long, v long")


def groups(rows: DataFrame, texts: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, words: int = WORDS, key_bytes: int = 2) -> DataFrame:
    """uid and root of all rows that have a near duplicate."""
    one = rows.select("uid", *HEAD, "fp", "n", "short").dropDuplicates(["uid"])
    ends = lambda df: df.select(F.col("u").alias("uid")).union(df.select("v"))
    alone = one.withColumns({"label": F.col("uid"), "size": F.lit(1).cast("long")})
    rare_first = RareFirst(frequent_hashes(one))
    by_bits, by_sets = candidates(alone, False, rare_first, similarity, words, key_bytes)
    links = materialize(tallied(by_bits.select("u", "v"), one, similarity, words).union(by_sets.select("u", "v")).distinct(), "links")
    first = materialize(verified(links, shingle_sets(ends(links), texts, width), similarity), "verified")

    # families, by links, and in them groups, by those that hold
    family = components(links).toDF("uid", "label")
    kind = components(first).toDF("uid", "kind")
    known = materialize(family.join(kind, "uid", "left").withColumn("kind", F.coalesce("kind", "uid")), "families")
    per = known.groupBy("label", "kind").agg(F.count(F.lit(1)).alias("n")).groupBy("label").agg(F.sum("n").alias("size"), F.max_by("kind", F.struct("n", "kind")).alias("main"))
    known = broadcast_if_small(materialize(known.join(per, "label"), "sized"))
    labelled = one.join(known, "uid", "left").withColumns({"label": F.coalesce("label", "uid"), "size": F.coalesce("size", F.lit(1))})
    by_bits, by_sets = (materialize(x, "met") for x in candidates(labelled, True, rare_first, similarity, words, key_bytes))

    # small families are listed: their members, and who meets them, are pairs
    small, large = F.col("size") <= SMALL, F.col("size") > SMALL
    listed = known.filter(small).select("label", F.col("uid").alias("member"), "kind")
    pairs = lambda df: df.filter(small).select("u", F.col("v").alias("label")).join(listed, "label", "left").select("u", F.coalesce("member", "label").alias("v"))
    other = listed.toDF("label", "v", "other")
    inside = listed.join(other, "label").filter("member < v AND kind <> other").select(F.col("member").alias("u"), "v")
    links = materialize(tallied(pairs(by_bits), one, similarity, words).union(pairs(by_sets)).union(inside).distinct(), "links")
    asks = by_bits.union(by_sets).filter(large).select(F.col("u").alias("uid"), F.col("v").alias("label"), "size")
    asks = materialize(asks.union(known.filter(large & (F.col("kind") != F.col("main"))).select("uid", "label", "size")).distinct(), "asking")
    members = materialize(known.filter(large).select("uid", "label", "size").join(asks.select("label").distinct(), "label", "left_semi"), "members")
    sets = shingle_sets(ends(links).union(asks.select("uid")).union(members.select("uid")), texts, width)
    named = sets.join(known.select("uid", "kind"), "uid", "left").withColumn("kind", F.coalesce("kind", "uid"))
    second = verified(links, sets, similarity).union(verified_families(asks, members, named, similarity))
    return components(first.union(second)).toDF("uid", "root")


def _identified(docs: DataFrame, width: int, words: int, most: int) -> tuple[DataFrame, DataFrame]:
    """``docs`` with uid, a hash of id and text, and their fingerprints.  A
    second hash tells whether two unlike rows have one uid; then salts go on."""
    salt = 0
    while True:
        keys = [F.col("doc_id"), F.col("text")]
        found = docs.withColumns({"uid": F.xxhash64(F.lit(salt), *keys), "other": F.xxhash64(*keys, F.lit(-1))})
        rows = found.select("uid", "other", "doc", "text").mapInArrow(lambda it: _fingerprints(it, width, words, most), ROWS)
        rows = materialize(rows, "wide")
        if rows.groupBy("uid").agg(F.min("other").alias("x"), F.max("other").alias("y")).filter("x <> y").isEmpty():
            return found, rows
        salt += 1


def keep_representatives(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, words: int = WORDS, key_bytes: int = 2) -> DataFrame:
    """``docs`` (doc_id, text and any others) without the rows that have a near
    duplicate with a smaller id in their group."""
    last = (1 << 63) - 1
    most = int(SHORT / similarity + 1e-9)  # the largest set that is near one of SHORT
    inner, own = renamed(docs, "doc_id", "text")
    inner = inner.withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(last)))
    inner, rows = _identified(inner, width, words, most)
    roots = groups(rows, inner.select("uid", "text"), width, similarity, words, key_bytes)
    member = rows.select("uid", "doc").join(roots, "uid")
    low = member.groupBy("root").agg(F.min(F.struct("doc", "uid")).alias("low"))
    gone = member.join(low, "root").filter((F.col("doc") != F.col("low.doc")) | (F.col("uid") != F.col("low.uid"))).select("uid").distinct()
    # rows with equal id and text: one stays, whether its group has others or not
    again = rows.groupBy("uid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("uid", F.lit(1).alias("mark"))
    marks = again.join(gone, "uid", "left_anti").union(gone.select("uid", F.lit(0)))
    marks = broadcast_if_small(materialize(marks, "marks"))
    left = inner.join(marks, "uid", "left")
    turn = F.row_number().over(Window.partitionBy("uid").orderBy(F.lit(1)))
    repeated = left.filter("mark = 1").withColumn("turn", turn).filter("turn = 1")
    return left.filter("mark is null").select(*own).union(repeated.select(*own)).toDF(*docs.columns)
