"""Operator 4: SimHash near-deduplication over a byte-position inverted index.

A fingerprint is eight positional bytes.  Two fingerprints that differ in at
most ``bits`` (4 by default) bits differ in at most that many bytes, so they
share at least 8 - bits bytes in place: the guaranteed minimum of matches.  The
inverted index is keyed by small sets of positions and the bytes found there;
the family of sets is such that any ``8 - bits`` positions contain one of it
(for 4: the twenty triples of a Turan system), so no pair that reaches the
minimum is missed, and one posting is 24 bits, not 8, selective.  For the pairs
that meet in a posting the shared positional bytes are tallied; pairs that
reach the minimum are retained and verified by their differing bits.

Equal fingerprints are collapsed before the index, so exact copies cost
nothing.  A posting never emits its pairs: it emits a spanning forest of its
links (one link per member at most), which keeps all reachability.  Large
postings are refined by a further position first; a dense cluster is consumed
by its first pivots.  Components come from alternating stars.

Defined results: a null or empty text has no words and fingerprint zero, which
links like any other; null ids take part but never name a component unless all
its ids are null; repeated rows share their fingerprint and component; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismrank.llm._shared import materialize, only
from prismrank.llm.components import components
from prismrank.llm.exactdedup import fold

SEED = 42
_LOW7 = np.uint64(0x7F7F7F7F7F7F7F7F)
_HIGH = np.uint64(0x8080808080808080)


def position_sets(bits: int) -> list[tuple[int, ...]]:
    """Sets of byte positions of which any 8 - bits positions contain one.  For
    four bits, Turan's construction for triples: the positions fall into three
    circular parts; a triple inside a part, or with two in a part and one in
    the next, is in the family.  Otherwise all sets of the minimum size (three
    at most: fewer positions only make postings longer, never lose a pair)."""
    least = 8 - bits
    if least < 1:
        raise ValueError("with 8 or more differing bits no positional byte is guaranteed")
    if least != 4:
        return list(combinations(range(8), min(least, 3)))
    part = [0, 0, 0, 1, 1, 1, 2, 2]

    def inside(t: tuple[int, ...]) -> bool:
        n = [sum(part[x] == p for x in t) for p in range(3)]
        return 3 in n or any(n[p] == 2 and n[(p + 1) % 3] == 1 for p in range(3))

    return [t for t in combinations(range(8), 3) if inside(t)]


def fingerprint(words: list[bytes], width: int) -> int:
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= width:
        h = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        size = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(size + 1) - 1
        a, b = (ends - size)[: n - width + 1].tolist(), ends[width - 1 :].tolist()
        digest = xxhash.xxh64_intdigest
        h = np.fromiter([digest(joined[x:y], SEED) for x, y in zip(a, b)], np.uint64, n - width + 1)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        block = h[k : k + (1 << 16)].astype("<u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(fold(t.as_py()).split(), width) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64), pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id and the 64-bit fingerprint (as a signed long) of each row."""
    return only(docs, "doc_id", "text").mapInArrow(lambda it: _fingerprints(it, width), "doc_id long, fp long")


def linked(x: np.ndarray, bits: int) -> np.ndarray:
    """For the exclusive ors of pairs: tally the positional bytes that are
    shared, retain those that reach the minimum, verify the differing bits."""
    differing = np.bitwise_count((((x & _LOW7) + _LOW7) | x) & _HIGH)
    near = differing <= bits
    near[near] = np.bitwise_count(x[near]) <= bits
    return near


def forest(fps: np.ndarray, bits: int, roots: list, members: list, limit: int = 4096) -> None:
    """Append a spanning forest of the links among distinct ``fps``."""
    if len(fps) > limit:
        pieces = []
        for k in range(8):
            byte = (fps >> np.uint64(8 * k)) & np.uint64(255)
            order = np.argsort(byte, kind="stable")
            cuts = np.flatnonzero(np.diff(byte[order])) + 1
            if len(cuts):
                pieces.append(np.split(fps[order], cuts))
        # positions that all share are no cut; of the others one more is shared
        constant = 8 - len(pieces)
        if constant < 8 - bits and pieces and max(len(p) for group in pieces for p in group) <= len(fps) // 2:
            for group in pieces:
                for p in group:
                    if len(p) > 1:
                        forest(p, bits, roots, members, limit)
            return
    unseen = np.sort(fps)
    while len(unseen) > 1:
        root, unseen = unseen[0], unseen[1:]
        front = np.array([root], np.uint64)
        while len(front) and len(unseen):
            hit = np.zeros(len(unseen), bool)
            step = max(1, (1 << 20) // len(unseen))
            for a in range(0, len(front), step):
                rest = np.flatnonzero(~hit)
                if not len(rest):
                    break
                hit[rest[linked(front[a : a + step, None] ^ unseen[None, rest], bits).any(0)]] = True
            front = unseen[hit]
            unseen = unseen[~hit]
            roots.append(np.full(len(front), root))
            members.append(front)


def _link(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by posting; the last posting of a batch waits for the
    next one.  Only distinct fingerprints are held, 8 bytes each."""

    def out(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        roots, members = [], []
        two = starts[sizes == 2]
        if len(two):
            a, b = fps[two], fps[two + 1]
            near = linked(a ^ b, bits)
            roots.append(a[near])
            members.append(b[near])
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            forest(fps[s : s + n], bits, roots, members)
        if roots and len(u := np.concatenate(roots)):
            v = np.concatenate(members)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    wait: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        k = batch.column(0).to_numpy(zero_copy_only=False)
        f = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        if not len(k):
            continue
        last = int(np.searchsorted(k, k[-1]))
        if wait and wait[0][0][0] == k[0] and last == 0:
            wait.append((k, f))  # still the same posting
            continue
        held = wait + [(k[:last], f[:last])]
        yield from out(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
        wait = [(k[last:], f[last:])]
    if wait:
        yield from out(np.concatenate([x[0] for x in wait]), np.concatenate([x[1] for x in wait]))


def links(distinct: DataFrame, bits: int = 4) -> DataFrame:
    """Links u, v that connect all of the column ``fp`` (distinct, not null)
    that can reach each other by steps of at most ``bits`` differing bits."""
    sets = position_sets(bits)

    def posting(i: int, positions: tuple[int, ...]):
        key = F.lit(i).cast("long")
        for p in positions:
            key = F.shiftleft(key, 8).bitwiseOR(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)))
        return key

    postings = distinct.select(F.explode(F.array(*[posting(i, p) for i, p in enumerate(sets)])).alias("posting"), "fp")
    return postings.repartition("posting").sortWithinPartitions("posting").mapInArrow(lambda it: _link(it, bits), "u long, v long")


def simhash_groups(docs: DataFrame, width: int = 4, bits: int = 4) -> DataFrame:
    """Per row: doc_id, fp, component_id (the smallest doc_id reachable)."""
    rows = materialize(fingerprints(docs, width), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    roots = components(links(distinct.select("fp"), bits)).withColumnRenamed("node", "fp")
    known = distinct.join(roots, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    lowest = known.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = known.join(lowest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def documents_digest(docs: DataFrame) -> DataFrame:
    """The columns that ``op4_simhash_near_dedup`` returns."""
    return simhash_groups(docs, 4, 4).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
