"""Operator 10: a deterministic sharded WARC writer, and its reader.

Records are range-sorted by key into shards, whose number follows from the bytes
of all payloads alone.  The bounds of the shards are quantiles of the keys whose
hashes are below a share of their range (a sample of about ten thousand keys, or
twenty a shard, that does not depend on partitions or on the order of rows), so
the same table always gives the same files, byte for byte, whatever the settings
of the session.  A task writes its shards one after the
other; a shard rolls to its next file when the compressed size is reached.
Headers, record ids and digests are regenerated from the content.  Files are
written under a name of the task attempt and renamed when they are complete;
the manifest, written last, is the commit: readers read only what it names.  A
task that is run again renames the same bytes to the same name.

Of records with equal payloads (of ``least`` bytes or more) the one with the
largest key is stored; the others are ``revisit`` records without a payload.

Defined results: a null payload is empty; a null key sorts first and is larger
than no other (among only null keys one is the response and the others revisit
it with a null ``refers_to``); of repeated rows that share the largest key one
is the response, the others revisit it; a null URL gives no target header; an
empty table gives an empty manifest; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismrank.llm._shared import delete, materialize, scratch

DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
#: Keys that bounds are chosen from, on average, where there are more: in all,
#: and at least of each shard.
SAMPLE = 10_000
SHARD_SAMPLE = 20
#: Bytes of payload of a shard, which one task writes; with very many, more.
SHARD_BYTES = 32 << 20
RANGE = 1 << 40
NAMESPACE = uuid.UUID("6f1c1a53-9a0f-5b52-8f0e-5d0a4a7a2b10")
MANIFEST = "name string, shard int, records long, bytes long, sha256 string, first_key long, last_key long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{key}/{digest}')}>"


def record(key: int | None, url: str | None, payload: bytes, digest: str, revisits: bool, top: int | None) -> bytes:
    """One record, uncompressed.  ``digest``: of the payload, bare base32."""
    head = HTTP % len(payload)
    block = head if revisits else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisits else 'response'}", f"WARC-Record-ID: {record_id(key, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"X-Payload-Length: {len(payload)}"]
    if key is not None:
        lines.append(f"X-Key: {key}")
    if revisits:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(top, digest)}"]
        if top is not None:
            lines.append(f"X-Refers-To-Key: {top}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


class Roller:
    """Files of one shard, written under attempt names, renamed when full."""

    def __init__(self, folder: str, attempt: str, roll_bytes: int, level: int) -> None:
        self.fs, self.root = _open(folder)
        self.folder, self.attempt, self.roll, self.level = self.root, attempt, roll_bytes, level
        self.shard, self.turn, self.stream, self.done = -1, 0, None, []

    def put(self, shard: int, key: int | None, data: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.turn = shard, 0
        if self.stream is None:
            self.temp = f"{self.folder}/_temporary/{self.attempt}-{shard:06d}-{self.turn:04d}"
            self.fs.create_dir(f"{self.folder}/_temporary", recursive=True)
            self.stream, self.sha, self.size, self.n, self.first = self.fs.open_output_stream(self.temp), hashlib.sha256(), 0, 0, key
            info = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(shard, str(self.turn))}\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: 18\r\n\r\nformat: WARC/1.1\r\n\r\n\r\n"
            self._member(info.encode())
        self._member(data)
        self.n, self.last = self.n + 1, key
        if self.size >= self.roll:
            self._finish()

    def _member(self, data: bytes) -> None:
        z = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        packed = z.compress(data) + z.flush()
        self.stream.write(packed)
        self.sha.update(packed)
        self.size += len(packed)

    def _finish(self) -> None:
        self.stream.close()
        name = f"part-{self.shard:06d}-{self.turn:04d}.warc.gz"
        self.fs.move(self.temp, f"{self.folder}/{name}")
        self.done.append((name, self.shard, self.n, self.size, self.sha.hexdigest(), self.first, self.last))
        self.stream, self.turn = None, self.turn + 1

    def close(self) -> None:
        if self.stream is not None:
            self._finish()


def _write(batches: Iterator[pa.RecordBatch], folder: str, least: int, roll_bytes: int, level: int) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    out = Roller(folder, f"{context.stageId()}-{context.partitionId()}-{context.attemptNumber()}-{uuid.uuid4().hex[:8]}", roll_bytes, level)
    now, tops, answered = object(), {}, set()
    for batch in batches:
        for shard, key, kind, digest, url, html, top in zip(*(batch[c].to_pylist() for c in ("shard", "page_id", "kind", "digest", "url", "html", "top"))):
            if key != now:
                now, tops, answered = key, {}, set()
            if kind == 0:
                tops[digest] = top
                continue
            payload = (html or "").encode("utf-8", "surrogatepass")
            revisits = len(payload) >= least and (tops[digest] != key or digest in answered)
            if not revisits:
                answered.add(digest)
            out.put(shard, key, record(key, url, payload, base64.b32encode(digest).decode(), revisits, tops[digest]))
    out.close()
    yield pa.RecordBatch.from_pylist([dict(zip(("name", "shard", "records", "bytes", "sha256", "first_key", "last_key"), x)) for x in out.done], pa.schema([("name", pa.string()), ("shard", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string()), ("first_key", pa.int64()), ("last_key", pa.int64())]))


def write_warc(pages: DataFrame, folder: str, least: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = 256 << 20, level: int = 6) -> DataFrame:
    """Write ``pages`` (page_id, url, html) below ``folder``, which driver and
    executors share.  Returns the committed manifest, one row per file."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha1(F.coalesce("html", F.lit("")))))
    small = materialize(rows.select("page_id", "digest", F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("size")), "digests")
    top = small.groupBy("digest").agg(F.max("page_id").alias("top"))
    meta = small.select("page_id", "digest").distinct().join(top, "digest")
    total, n = small.agg(F.sum("size"), F.count("page_id")).first()
    total = total or 0
    shards = max(1, -(-total // shard_bytes))
    share = F.pmod(F.xxhash64("page_id"), F.lit(RANGE)) < F.lit(int(min(1.0, max(SAMPLE, SHARD_SAMPLE * shards) / max(n, 1)) * RANGE))
    sample = sorted(r[0] for r in small.select("page_id").filter(F.col("page_id").isNotNull() & share).collect())
    bounds = np.array(sorted({sample[len(sample) * k // shards] for k in range(1, shards)}) if sample else [], np.int64)

    @F.pandas_udf("int")
    def shard_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.fillna(-(1 << 63)).to_numpy(np.int64), "right").astype(np.int32))

    kinds = [("page_id", "long"), ("kind", "int"), ("digest", "binary"), ("url", "string"), ("html", "string"), ("top", "long")]
    have = {"kind": F.lit(1), "top": F.lit(None)}
    a = rows.select(*[have.get(c, F.col(c)).cast(t).alias(c) for c, t in kinds])
    have = {"kind": F.lit(0), "url": F.lit(None), "html": F.lit(None), "top": F.col("top")}
    b = meta.select(*[have.get(c, F.col(c)).cast(t).alias(c) for c, t in kinds])
    both = a.union(b).withColumn("shard", shard_of("page_id"))
    dealt = both.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "page_id", "kind", "digest", "url")
    dealt = dealt.select("shard", *[c for c, _ in kinds])
    manifest = dealt.mapInArrow(lambda it: _write(it, folder, least, roll_bytes, level), MANIFEST)
    path = f"{folder}/_manifest"
    manifest.write.mode("overwrite").parquet(path)
    delete(spark, f"{folder}/_temporary")
    return spark.read.schema(manifest.schema).parquet(path)


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The decompressed gzip members of a file, one after the other."""
    z, held = zlib.decompressobj(31), []
    while data := stream.read(chunk):
        while data:
            held.append(z.decompress(data))
            data = z.unused_data
            if z.eof:
                yield b"".join(held)
                z, held = zlib.decompressobj(31), []
    if any(held):
        raise ValueError("a file ends inside a record")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"not a record: {first[:40]}")
    fields = dict(x.split(": ", 1) for x in lines)
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record does not have the length that it states")
    return fields, rest[:size]


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    fs, root = _open(folder)
    for batch in batches:
        for name in batch.column(0).to_pylist():
            out = []
            with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                for data in members(stream):
                    fields, block = parse(data)
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    if fields["WARC-Block-Digest"] != "sha1:" + base32_sha1(block):
                        raise ValueError(f"{name}: a block does not have its digest")
                    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
                    if fields["WARC-Type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if base32_sha1(payload) != digest or len(payload) != size:
                            raise ValueError(f"{name}: a payload does not have its digest")
                    out.append((fields.get("X-Key"), size, digest, fields["WARC-Type"], fields.get("X-Refers-To-Key")))
                    if len(out) == 5000:
                        yield _rows(out)
                        out = []
            yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    number = lambda k: pa.array([None if x[k] is None else int(x[k]) for x in out], pa.int64())
    return pa.RecordBatch.from_arrays([number(0), number(1), pa.array([x[2] for x in out], pa.string()), pa.array([x[3] for x in out], pa.string()), number(4)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record of the files that the manifest names; every digest
    and length is verified on the way."""
    # an explicit number, which adaptive execution does not reduce to one task
    files = manifest.select("name").repartition(max(1, manifest.count()), "name")
    return files.mapInArrow(lambda it: _read(it, folder), RECORD)


def pages_digest(pages: DataFrame) -> DataFrame:
    """The columns that ``op10_warc`` returns."""
    folder = scratch(pages.sparkSession, "warc")
    return read_warc(write_warc(pages, folder), folder)


SQL = """
WITH d AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
b AS (
  SELECT page_id, payload_bytes, max(page_id) OVER (PARTITION BY x) AS top,
    list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, 5 * (k // 4) + 1, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)::INT, 1)), 'string_agg', '') AS payload_digest
  FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM b
"""
