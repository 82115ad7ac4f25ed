"""Operator 7: exact top-k search with MaxScore over sharded postings.

A vector's terms are its dimensions; a shard (a bounded number of rows, dealt
by the hash of their id) holds one posting list per dimension with the least
and largest component in it, which bound what the term can add to a score.  A
query orders its terms by bound.  Against the threshold (the k-th best score of
a first block of candidates) the terms split: the non-essential ones are the
longest tail whose bounds together cannot make a candidate competitive.  The
essential postings are traversed for all candidates; the others are probed in
order of bound, and only for candidates whose partial score plus the bounds
still open reaches the threshold.  Each shard returns its k best per query, and
a window merges the shards (its groups have k rows per shard; with limits
pushed below the shuffle).

Queries meet candidates in blocks: a task has one shard and one block of
queries, both of bounded size.  Dense vectors have every candidate in every
posting, so the bounds prune arithmetic, not candidates.

Defined results: vectors that are null, or have null or non-finite components,
or a null id, take no part; an empty vector has no terms and scores 0; of
vectors of different lengths the missing components are 0; rows with the
query's id are its own; a repeated candidate counts as often as it occurs;
fully repeated query rows are one query; scores outside of a 64-bit integer are
clipped to it; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 8192
BLOCK_ROWS = 2048
SEEDS = 512
PROBE = 8
RESULT = "query_id long, query_key long, vec_id long, score long"


def quantized(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """vec_id and q (array<double> of whole numbers: floor(scale * x))."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(fine)
    # doubles from 2^53 are whole already, and may not fit the long of floor
    return rows.select("vec_id", F.transform("embedding", lambda x: F.when(F.abs(x * scale) < 2.0**53, F.floor(x * scale).cast("double")).otherwise(x * scale)).alias("q"))


class Shard:
    """Posting lists of one shard: by dimension, the components of all rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.lists = ids[order], np.ascontiguousarray(rows[order].T)
        self.low = self.lists.min(1) if rows.shape[1] else np.zeros(0)
        self.high = self.lists.max(1) if rows.shape[1] else np.zeros(0)

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.ids)
        if not n:
            return self.ids, np.zeros(0)
        bound = np.maximum(query * self.low, query * self.high)
        terms = np.argsort(-bound, kind="stable")
        rest = np.r_[np.cumsum(bound[terms][::-1])[::-1], 0.0]  # bounds of terms[t:]
        seeds = query @ self.lists[:, :SEEDS]
        seeds = seeds[self.ids[:SEEDS] != own]
        least = np.partition(seeds, -k)[-k] if len(seeds) >= k else -np.inf
        # essential: what stands before the longest tail that alone stays below
        split = int(np.flatnonzero(rest < least)[0]) if (rest < least).any() else len(terms)
        at = terms[:split]
        score = query[at] @ self.lists[at] if split else np.zeros(n)
        alive = np.flatnonzero((score + rest[split] >= least) & (self.ids != own))
        score = score[alive]
        for t in range(split, len(terms), PROBE):
            at = terms[t : t + PROBE]
            score = score + query[at] @ self.lists[np.ix_(at, alive)]
            held = score + rest[min(t + PROBE, len(terms))] >= least
            alive, score = alive[held], score[held]
        ids = self.ids[alive]
        best = np.lexsort((ids, -score))[:k]
        return ids[best], score[best]


def _matrix(q: pa.ChunkedArray, width: int) -> np.ndarray:
    held = q.combine_chunks()
    flat, n = held.flatten().to_numpy(zero_copy_only=False).astype(np.float64), held.value_lengths().to_numpy()
    if (n == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(n), width))
    out[np.arange(width) < n[:, None]] = flat
    return out


def _search(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    out: list[list[np.ndarray]] = [[], [], [], []]
    if queries.num_rows and rows.num_rows:
        width = max(pc.max(pc.list_value_length(t["q"])).as_py() for t in (queries, rows))
        a, c = _matrix(queries["q"], width), _matrix(rows["q"], width)
        ids = rows["vec_id"].to_numpy()
        # doubles are exact while every sum stays below 2^53; else whole numbers
        exact = np.abs(a).max(initial=0) * np.abs(c).max(initial=0) * max(1, width) < 2.0**52
        if not exact:
            whole = np.vectorize(int, otypes=[object])
            a, c = (whole(x) if x.size else x for x in (a, c))
        shard = Shard(ids, c) if exact else None
        for i, (own, key) in enumerate(zip(queries["vec_id"].to_pylist(), queries["query_key"].to_pylist())):
            if exact:
                found, score = shard.top(a[i], own, k)
                score = score.astype(np.int64)
            else:
                all_scores = sorted((-max(-(1 << 63), min((1 << 63) - 1, int(s))), v) for v, s in zip(ids.tolist(), c @ a[i]) if v != own)[:k]
                found, score = np.array([v for _, v in all_scores], np.int64), np.array([-s for s, _ in all_scores], np.int64)
            for column, x in zip(out, (np.full(len(found), own), np.full(len(found), key), found, score)):
                column.append(x)
    return pa.table([pa.array(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64)) for x in out], names=["query_id", "query_key", "vec_id", "score"])


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For each row of ``vectors`` (vec_id, embedding) with an id divisible by
    ``every``: query_id, rank, vec_id, score of its k best other rows."""
    rows = quantized(vectors)
    chosen = F.pmod("vec_id", F.lit(every)) == 0
    n, top = rows.agg(F.count(F.lit(1)), F.max(F.array_max(F.transform("q", F.abs)))).first()
    if (top or 0) < 1 << 15:  # the same numbers in a quarter of the bytes
        rows = rows.withColumn("q", F.col("q").cast("array<smallint>"))
    asked = rows.filter(chosen).distinct()
    m = asked.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // block_rows))
    # a row's place among all tells repeated rows apart: a row that is repeated
    # very often must not fill one shard
    rows = rows.withColumn("place", F.monotonically_increasing_id())
    dealt = lambda pieces, salt, *c: F.pmod(F.xxhash64(F.lit(salt), *c), F.lit(pieces)).cast("int")
    each = lambda pieces: F.explode(F.sequence(F.lit(0), F.lit(pieces - 1)))
    right = rows.select("vec_id", "q", dealt(shards, 1, "vec_id", "place").alias("shard"), each(blocks).alias("block"))
    left = asked.select("vec_id", "q", F.xxhash64("q").alias("query_key"), dealt(blocks, 2, "vec_id", "q").alias("block"), each(shards).alias("shard"))
    keys = ["shard", "block"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: _search(a, b, k), RESULT)
    order = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def embeddings_digest(vectors: DataFrame) -> DataFrame:
    """The columns that ``op7_exact_top_k`` returns."""
    return top_k(vectors, 20, 20)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(64 * x)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
