"""Operator 13: codes of vectors by codebooks of whole numbers.

A vector is cut into parts; each part's position has a codebook, whose entries
start as that part of the vectors with the smallest ids.  The codebooks are
broadcast (positions x entries x components of a part, whatever the table's
size).  Tasks work on Arrow batches: the distances of all parts to all entries
come from the expansion of their norms and matrix products of 64-bit integers,
the first least one wins, and the parts are added to their entries' sums.  Sums
and counts leave a task as a row per entry and component and are merged by a
grouped shuffle in each round.  Vectors are read again in each round and never
shuffled.

Defined results: vectors that are null or hold a null or non-finite component
take no part; of vectors of different lengths the missing components are 0, and
all are as long as the longest, rounded up to a whole number of parts (an empty
vector is all zeros); null ids take part and rank last; of rows with one id the
smallest vector starts the codebooks; fewer ids than entries start as many
entries as there are; errors and sums outside of 64 bits are clipped to them
(codes and codebooks stay exact); an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismrank.llm._shared import broadcast_if_small, materialize, only
from prismrank.llm.lattice import ROWS, as_long, distances, long_sum, matrix, partial_sums, quantized, summed, whole


class Codebooks:
    """Entries by part: whole numbers, held on the driver as lists."""

    def __init__(self, entries: list[list[list[int]]]) -> None:
        self.parts = [whole(part) for part in entries]
        self.size, self.width = self.parts[0].shape

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry per row and part, and summed distances."""
        code = np.zeros((len(x), len(self.parts)), np.uint8 if self.size <= 256 else np.int64)
        error = np.zeros(len(x), x.dtype)
        for p, entries in enumerate(self.parts):
            d = distances(x[:, p * self.width : (p + 1) * self.width], entries)
            code[:, p] = d.argmin(1)
            error = error + d[np.arange(len(x)), code[:, p]]
        return code, error

    def add(self, x: np.ndarray, code: np.ndarray, totals: np.ndarray) -> None:
        """Counts (place 0) and sums of a block's parts, by part and entry."""
        for p in range(len(self.parts)):
            part = x[:, p * self.width : (p + 1) * self.width]
            at = p * self.size
            if x.dtype == object:
                for row, c in zip(part, code[:, p].tolist()):
                    totals[at + c, 0] += 1
                    totals[at + c, 1:] += row
                continue
            order = np.argsort(code[:, p], kind="stable")
            used, first = np.unique(code[order, p], return_index=True)
            totals[at + used.astype(np.int64), 0] += np.diff(np.r_[first, len(order)])
            if self.width:
                totals[at + used.astype(np.int64), 1:] += np.add.reduceat(part[order], first, axis=0)


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            some = batch.slice(at, ROWS)
            yield some, matrix(some["q"], width)


def _partial(batches: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[pa.RecordBatch]:
    n = len(books.parts)
    totals = np.zeros((n * books.size, 1 + books.width), object)
    for _, x in _blocks(batches, n * books.width):
        books.add(x, books.encode(x)[0], totals)
    yield partial_sums(totals)


def _codes(batches: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[pa.RecordBatch]:
    digits = 2 if books.size <= 256 else -(-(books.size - 1).bit_length() // 4)
    for batch, x in _blocks(batches, len(books.parts) * books.width):
        code, error = books.encode(x)
        names = [row.tobytes().hex() if digits == 2 else "".join(f"{c:0{digits}x}" for c in row.tolist()) for row in code]
        yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], pa.array(names, pa.string()), as_long(error)], names=["vec_id", "label", "code", "error"])


def starts(rows: DataFrame, entries: int) -> list[list[int]]:
    """The vectors of the ``entries`` smallest ids, one an id.  A task sends at
    most so many of its own: rows of one id are counted once before they are
    ranked."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int | None, list[float]] = {}
        for batch in batches:
            ids = batch["vec_id"].to_pylist()
            for i in sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0)):
                if ids[i] not in best and len(best) >= entries and (ids[i] is None or all(k is not None and k < ids[i] for k in best)):
                    break
                q = batch["q"][i].as_py()
                best[ids[i]] = min(q, best.get(ids[i], q))
            best = dict(sorted(best.items(), key=lambda kv: (kv[0] is None, kv[0] or 0))[:entries])
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array(list(best.values()), pa.list_(pa.float64()))], names=["vec_id", "q"])

    few = rows.select("vec_id", "q").mapInArrow(least, "vec_id long, q array<double>").groupBy("vec_id").agg(F.min("q").alias("q"))
    return [[int(v) for v in r.q] for r in few.orderBy(F.col("vec_id").asc_nulls_last()).limit(entries).collect()]


def encoded(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0) -> tuple[DataFrame, list[list[list[int]]]]:
    """vec_id, label, code and error (squared distance to what the code stands
    for) of every vector; and the codebooks by part, entry and place."""
    spark = vectors.sparkSession
    rows = materialize(quantized(only(vectors, "vec_id", "embedding", "label"), scale, None, "label"), "whole")
    schema = f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long"
    first = starts(rows, entries)
    if not first:
        return spark.createDataFrame([], schema), []
    longest = rows.agg(F.max(F.size("q"))).first()[0]
    width = -(-longest // parts)
    padded = [q + [0] * (width * parts - len(q)) for q in first]
    books = [[q[p * width : (p + 1) * width] for q in padded] for p in range(parts)]
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(Codebooks(books))
        totals = summed(rows.select("q"), lambda it, b=sent: _partial(it, b.value), parts * len(first), 1 + width)
        sums = [totals[p * len(first) : (p + 1) * len(first)] for p in range(parts)]
        books = [[[x // s[0] for x in s[1:]] if s[0] else e for s, e in zip(sums[p], books[p])] for p in range(parts)]
        sent.unpersist()
    sent = spark.sparkContext.broadcast(Codebooks(books))
    return rows.mapInArrow(lambda it: _codes(it, sent.value), schema), books


def embeddings_digest(vectors: DataFrame) -> DataFrame:
    """The columns that ``op13_vector_codes`` returns."""
    rows, books = encoded(vectors, 16, 64, 2, 256.0)
    rows = materialize(rows, "codes")
    sums = broadcast_if_small(materialize(rows.groupBy("label").agg(long_sum("error").alias("label_error")), "errors"))
    name = hashlib.sha256(",".join(str(v) for part in books for entry in part for v in entry).encode()).hexdigest()
    found = rows.alias("r").join(sums.alias("s"), F.col("r.label").eqNullSafe(F.col("s.label")))
    return found.select("vec_id", "code", "error", "label_error", F.lit(name).alias("codebooks_sha256"))


def _sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    steps = [
        "v AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS q FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"w AS (SELECT max(len(q)) // {parts} AS w FROM v)",
        f"p AS (SELECT vec_id, label, part, q[part * w + 1 : (part + 1) * w] AS x FROM v, w, range({parts}) r(part))",
        f"f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v QUALIFY entry < {entries})",
        "c0 AS (SELECT p.part, f.entry, p.x FROM p JOIN f USING (vec_id))",
    ]
    for n in range(rounds + 1):
        far = "list_dot_product(p.x, p.x) - 2 * list_dot_product(p.x, c.x) + list_dot_product(c.x, c.x)"
        steps.append(f"a{n} AS (SELECT p.vec_id, p.part, any_value(p.label) AS label, any_value(p.x) AS x, min(struct_pack(d := {far}, e := c.entry)) AS best FROM p JOIN c{n} c USING (part) GROUP BY p.vec_id, p.part)")
        if n < rounds:
            steps += [
                f"m{n} AS (SELECT part, entry, place, sum(y) AS s, count(*) AS n FROM (SELECT part, best.e AS entry, unnest(x)::BIGINT AS y, generate_subscripts(x, 1) AS place FROM a{n}) GROUP BY ALL)",
                f"g{n} AS (SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY place) AS x FROM m{n} GROUP BY part, entry)",
                f"c{n + 1} AS (SELECT c.part, c.entry, coalesce(g.x, c.x) AS x FROM c{n} c LEFT JOIN g{n} g USING (part, entry))",
            ]
    return f"""
WITH {", ".join(steps)},
h AS (SELECT sha256(string_agg(t, ',' ORDER BY part, entry)) AS name FROM (SELECT part, entry, list_aggregate(list_transform(x, lambda y: y::BIGINT::VARCHAR), 'string_agg', ',') AS t FROM c{rounds})),
o AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, name AS codebooks_sha256 FROM o, h
"""


SQL = _sql()
