"""Operator 8: exact deduplication by a Grace hash table.

Every text is folded (A-Z to a-z only) and addressed by its SHA-256.  Each map
task first merges equal texts in a bounded open-addressing table, so a text
that makes up a third of all rows leaves each task as a handful of records.
The records are then dealt by address; each reducer runs a hybrid Grace hash
join with itself: distinct contents enter an open-addressing table until the
memory budget is reached, records that the full table does not know are
partitioned by further bits of their address into spill files, and each file
is processed in the same way.  Contents are compared completely, byte by byte.
The decision is finally joined back to all rows on the 32-byte address.

Defined results: a null text counts as empty; null ids rank below all others
(a group with only null ids keeps one of them and has a null ``keep_id``); of
fully repeated rows (same id, equal text) exactly one is kept; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismrank.llm._shared import UPPER, broadcast_if_small, materialize, only, release_memory, renamed

#: Bytes of distinct content that one table holds before it flushes or spills.
MEMORY_BYTES = 48 << 20
FAN_OUT_BITS = 4
_HEAD = struct.Struct("<32s?qqI")


class ContentTable:
    """Open addressing with linear probing; a slot points into parallel lists.
    Equality is that of the complete content; the address only picks the slot."""

    def __init__(self) -> None:
        self.slots = np.full(1024, -1, np.int64)
        self.keys: list[bytes] = []
        self.texts: list[bytes] = []
        self.ids: list[int | None] = []
        self.counts: list[int] = []
        self.size = 0

    def _grow(self) -> None:
        self.slots = np.full(len(self.slots) * 4, -1, np.int64)
        mask = len(self.slots) - 1
        for i, key in enumerate(self.keys):
            at = int.from_bytes(key[:8], "little") & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = i

    def merge(self, key: bytes, text: bytes, top: int | None, n: int, room: bool) -> bool:
        """False if the content is not known and there is no room for it."""
        mask = len(self.slots) - 1
        at = int.from_bytes(key[:8], "little") & mask
        while (i := self.slots[at]) >= 0:
            if self.keys[i] == key:
                if self.texts[i] != text:
                    raise RuntimeError("two contents have the same SHA-256")
                mine = self.ids[i]
                if top is not None and (mine is None or top > mine):
                    self.ids[i] = top
                self.counts[i] += n
                return True
            at = (at + 1) & mask
        if not room:
            return False
        self.slots[at] = len(self.keys)
        self.keys.append(key)
        self.texts.append(text)
        self.ids.append(top)
        self.counts.append(n)
        self.size += len(text) + 200
        if 2 * len(self.keys) > len(self.slots):
            self._grow()
        return True


def fold(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased; ``bytes.lower`` leaves everything else."""
    return text.encode("utf-8", "surrogatepass").lower() if text else b""


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
    for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        yield i, fold(text.as_py())


def _combine(batches: Iterator[pa.RecordBatch], memory: int) -> Iterator[pa.RecordBatch]:
    def out(t: ContentTable) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(t.keys), 2000):
            b = slice(a, a + 2000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(t.keys[b], pa.binary()), pa.array(t.texts[b], pa.binary()), pa.array(t.ids[b], pa.int64()), pa.array(t.counts[b], pa.int64())],
                names=["address", "content", "top_id", "n"],
            )

    held = ContentTable()
    for batch in batches:
        for i, text in _texts(batch):
            key = hashlib.sha256(text).digest()
            held.merge(key, text, i, 1, True)
            if held.size > memory:
                yield from out(held)
                held = ContentTable()
    yield from out(held)
    del held
    release_memory()


def _addresses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [hashlib.sha256(text).digest() for _, text in _texts(batch)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary())], names=["doc_id", "address"])


def _spilled(path: str) -> Iterator[tuple[bytes, bytes, int | None, int]]:
    with open(path, "rb") as f:
        while head := f.read(_HEAD.size):
            key, known, top, n, size = _HEAD.unpack(head)
            yield key, f.read(size), top if known else None, n


def grace(records: Iterator[tuple[bytes, bytes, int | None, int]], memory: int, folder: str, depth: int = 0) -> Iterator[ContentTable]:
    """Tables that together hold every distinct content of ``records`` once."""
    held, files, names = ContentTable(), {}, {}
    try:
        for key, text, top, n in records:
            if held.merge(key, text, top, n, held.size < memory):
                continue
            # the low end of the address picks table slots, the high end buckets
            at = int.from_bytes(key[-16:], "big") >> (FAN_OUT_BITS * depth) & ((1 << FAN_OUT_BITS) - 1)
            if at not in files:
                fd, names[at] = tempfile.mkstemp(dir=folder, prefix=f"bucket-{depth}-")
                files[at] = os.fdopen(fd, "wb", buffering=1 << 18)
            files[at].write(_HEAD.pack(key, top is not None, top or 0, n, len(text)))
            files[at].write(text)
    finally:
        for f in files.values():
            f.close()
    yield held
    del held
    for name in names.values():
        yield from grace(_spilled(name), memory, folder, depth + 1)
        os.unlink(name)


def _reduce(batches: Iterator[pa.RecordBatch], memory: int) -> Iterator[pa.RecordBatch]:
    def records() -> Iterator[tuple[bytes, bytes, int | None, int]]:
        for batch in batches:
            key, text, top, n = (batch.column(c) for c in range(4))
            for i in range(batch.num_rows):
                yield key[i].as_py(), text[i].as_py(), top[i].as_py(), n[i].as_py()

    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        for t in grace(records(), memory, folder):
            yield pa.RecordBatch.from_arrays([pa.array(t.keys, pa.binary()), pa.array(t.ids, pa.int64()), pa.array(t.counts, pa.int64())], names=["address", "keep_id", "group_size"])
    release_memory()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory_bytes: int = MEMORY_BYTES) -> DataFrame:
    """One row per distinct folded text: address, keep_id, group_size."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    combined = rows.mapInArrow(lambda it: _combine(it, memory_bytes), "address binary, content binary, top_id long, n long")
    return combined.repartition("address").mapInArrow(lambda it: _reduce(it, memory_bytes), "address binary, keep_id long, group_size long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory_bytes: int = MEMORY_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, address (the
    SHA-256 of the folded text).  See the module for the defined results."""
    found = groups(docs, id_col, text_col, memory_bytes)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_addresses, "doc_id long, address binary")
    # repeated rows are counted and told apart again, so that one of them stays
    rows = rows.groupBy("address", "doc_id").agg(F.count(F.lit(1)).alias("times"))
    joined = rows.join(found, "address").select("*", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("turn"))
    return joined.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("turn") == 1)).alias("kept"), "address")


def keep_unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory_bytes: int = MEMORY_BYTES) -> DataFrame:
    """``docs``, with all its columns, without the rows that repeat a text.
    Rows that go are few against all; their keys are broadcast within a bound,
    so that the texts of the others are not dealt out once more."""
    inner, own = renamed(docs, id_col, text_col)
    inner = inner.toDF(*own, "doc_id", "text")
    # a null id is held as the smallest number, so that the keys are plain
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    per = exact_dedup(inner, "doc_id", "text", memory_bytes).groupBy(number.alias("doc"), "address").agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    # 0: no row of this id and text stays; 1: one of several does
    marks = per.filter("NOT kept OR n > 1").select("doc", "address", F.col("kept").cast("int").alias("mark"))
    marks = broadcast_if_small(materialize(marks, "marks"))
    folded = F.translate(F.coalesce("text", F.lit("")), UPPER, UPPER.lower())
    left = inner.withColumns({"doc": number, "address": F.unhex(F.sha2(folded, 256))}).join(marks, ["doc", "address"], "left")
    turn = F.row_number().over(Window.partitionBy("doc", "address").orderBy(F.lit(1)))
    repeated = left.filter("mark = 1").withColumn("turn", turn).filter("turn = 1")
    return left.filter("mark is null").select(*own).union(repeated.select(*own)).toDF(*docs.columns)


def documents_digest(docs: DataFrame) -> DataFrame:
    """The columns that ``op8_exact_dedup`` returns."""
    out = exact_dedup(only(docs, "doc_id", "text"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("address")).alias("text_sha256"))


SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
