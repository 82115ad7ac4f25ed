"""Operator 12: clustering of whole-number vectors around centroids, with
Hamerly's bounds.

Every vector carries its cluster, an upper bound on the distance to its own
centroid and one lower bound on the distance to any other; they are written
with the vector to the shared folder after each round.  When centroids move, the
upper bound grows by the drift of the vector's own centroid and the lower one
shrinks by the largest drift among the others.  A vector whose upper bound stays
below its lower one keeps its cluster unseen; otherwise its own distance is
computed, and if that does not settle it either, all distances are, in whole
numbers.  Bounds are rounded outward and must differ strictly, so ties always go
to the full scan, where the smaller number wins.

A vector is never shuffled.  Sums of centroids change by what moved: each task
adds the vectors that changed their cluster to one total and takes them off the
other, and these totals (a row per cluster and component) are summed by a
grouped shuffle.  The driver holds the centroids alone.

Defined results: vectors that are null, hold a null or non-finite component or
are not of the wanted length take no part; null ids take part, and rank last
among the vectors that could start a centroid; repeated rows are vectors of
their own; fewer vectors than centroids start as many centroids as there are;
squared distances and sums outside of 64 bits are clipped to them (the choice of
clusters and the centroids stay exact); an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismrank.llm._shared import delete, only, written
from prismrank.llm.lattice import ROWS, as_long, distances, long_sum, matrix, partial_sums, quantized, summed, whole

STATE = "vec_id long, q array<double>, cluster int, was int, upper double, lower double"
ASSIGNED = "vec_id long, cluster int, distance long"
#: Relative errors of the bounds' arithmetic stay far below this.
SLACK = 1e-9


class Centroids:
    """Centroids of a round, and how far each has moved since the last one."""

    def __init__(self, now: list[list[int]], before: list[list[int]] | None = None) -> None:
        self.now = whole(now)
        self.width = self.now.shape[1]
        moved = [sum((x - y) ** 2 for x, y in zip(a, b)) for a, b in zip(now, before or now)]
        self.drift = np.sqrt(np.array(moved, float)) * (1 + SLACK)
        # for each cluster the largest drift among the others
        order = np.argsort(-self.drift, kind="stable")
        self.others = np.full(len(now), self.drift[order[0]])
        self.others[order[0]] = self.drift[order[1]] if len(now) > 1 else 0.0

    def own_distance(self, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        c = self.now
        if object in (x.dtype, c.dtype):
            x, c = x.astype(object), c.astype(object)
        gap = x - c[cluster]
        return (gap * gap).sum(1)

    def scan(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest centroid, and the bounds of a full scan."""
        d = distances(x, self.now)
        cluster = d.argmin(1) if len(d) else np.zeros(0, np.int64)
        nearest = d[np.arange(len(d)), cluster]
        if d.shape[1] == 1:
            second = np.full(len(d), np.inf)
        else:
            rest = d.copy()
            rest[np.arange(len(d)), cluster] = d.max() + 1 if len(d) else 0
            second = np.sqrt(rest.min(1).astype(float))
        return cluster, np.sqrt(nearest.astype(float)) * (1 + SLACK), second * (1 - SLACK)

    def reassign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Clusters and bounds after the move; and how many were scanned."""
        cluster, upper = cluster.copy(), upper + self.drift[cluster]
        upper *= 1 + SLACK
        lower = np.maximum(lower - self.others[cluster], 0.0) * (1 - SLACK)
        open_ = np.flatnonzero(~(upper < lower))
        upper[open_] = np.sqrt(self.own_distance(x[open_], cluster[open_]).astype(float)) * (1 + SLACK)
        open_ = open_[~(upper[open_] < lower[open_])]
        cluster[open_], upper[open_], lower[open_] = self.scan(x[open_])
        return cluster, upper, lower, len(open_)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _first(batches: Iterator[pa.RecordBatch], centroids: Centroids) -> Iterator[pa.RecordBatch]:
    for batch in _pieces(batches):
        cluster, upper, lower = centroids.scan(matrix(batch["q"], centroids.width))
        was = np.full(len(cluster), -1, np.int32)
        yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["q"], *map(pa.array, (cluster.astype(np.int32), was, upper, lower))], names=["vec_id", "q", "cluster", "was", "upper", "lower"])


def _next(batches: Iterator[pa.RecordBatch], centroids: Centroids) -> Iterator[pa.RecordBatch]:
    for batch in _pieces(batches):
        was, upper, lower = (batch[c].to_numpy() for c in ("cluster", "upper", "lower"))
        cluster, upper, lower, _ = centroids.reassign(matrix(batch["q"], centroids.width), was, upper, lower)
        yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["q"], *map(pa.array, (cluster.astype(np.int32), was, upper, lower))], names=["vec_id", "q", "cluster", "was", "upper", "lower"])


def _last(batches: Iterator[pa.RecordBatch], centroids: Centroids) -> Iterator[pa.RecordBatch]:
    for batch in _pieces(batches):
        x = matrix(batch["q"], centroids.width)
        cluster, *_ = centroids.reassign(x, *(batch[c].to_numpy() for c in ("cluster", "upper", "lower")))
        yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(cluster.astype(np.int32)), as_long(centroids.own_distance(x, cluster))], names=["vec_id", "cluster", "distance"])


def _moves(batches: Iterator[pa.RecordBatch], k: int, width: int) -> Iterator[pa.RecordBatch]:
    """What the vectors that moved add to, and take off, counts (place 0) and
    sums of clusters."""
    totals = np.zeros((k, 1 + width), object)
    for batch in _pieces(batches):
        x = matrix(batch["q"], width)
        rows = np.concatenate([np.ones((len(x), 1), x.dtype), x], 1)
        for column, sign in (("cluster", 1), ("was", -1)):
            of = batch[column].to_numpy()
            for c in np.unique(of[of >= 0]).tolist():
                totals[c] += sign * rows[of == c].sum(0).astype(object)
    yield partial_sums(totals)


def starts(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest hashes of ``seed:vec_id``, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.select(key.alias("key"), "q").orderBy(F.col("key").asc_nulls_last(), "q").limit(k).collect()
    return [[int(v) for v in r.q] for r in first]


def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: float = 64.0, components: int = 64, seed: int = 1) -> tuple[DataFrame, list[list[int]]]:
    """vec_id, cluster and squared distance of every vector after ``rounds``
    rounds and a last assignment; and the centroids."""
    spark = vectors.sparkSession
    rows = quantized(only(vectors, "vec_id", "embedding"), scale, components)
    now = starts(rows, k, seed)
    if not now:
        return spark.createDataFrame([], ASSIGNED), []
    held, before, width = [0] * len(now), None, components
    sums = [[0] * width for _ in now]
    state = path = None
    for _ in range(rounds):
        at = Centroids(now, before)
        step = rows.mapInArrow(lambda it, at=at: _first(it, at), STATE) if state is None else state.mapInArrow(lambda it, at=at: _next(it, at), STATE)
        last, (state, path) = path, written(step, "bounds")
        if last:
            delete(spark, last)
        moved = summed(state.filter("cluster <> was").select("q", "cluster", "was"), lambda it, n=len(now): _moves(it, n, width), len(now), 1 + width)
        held = [a + b[0] for a, b in zip(held, moved)]
        sums = [[x + y for x, y in zip(a, b[1:])] for a, b in zip(sums, moved)]
        before, now = now, [[x // n for x in s] if n else c for c, s, n in zip(now, sums, held)]
    at = Centroids(now, before)
    if state is None:
        state = rows.mapInArrow(lambda it: _first(it, at), STATE)
    out, _ = written(state.mapInArrow(lambda it: _last(it, at), ASSIGNED), "clusters")
    return out, now


def embeddings_digest(vectors: DataFrame) -> DataFrame:
    """The columns that ``op12_centroid_clustering`` returns."""
    rows, centroids = clustered(vectors, 16, 3, 64.0, 64, 1)
    by = rows.groupBy("cluster").agg(long_sum("distance").alias("cluster_inertia"))
    inertia = rows.agg(long_sum("distance").alias("inertia"))
    names = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    # a row per cluster each: bounded by the number of centroids
    known = vectors.sparkSession.createDataFrame(names, "cluster int, centroid_sha256 string")
    return rows.join(F.broadcast(by), "cluster").join(F.broadcast(known), "cluster").join(F.broadcast(inertia)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 16, rounds: int = 3) -> str:
    """The rounds written out: a<n> assigns, c<n> are the centroids before it."""
    steps = [
        "v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(64 * x)) AS q FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster, q FROM v QUALIFY cluster < {k})",
    ]
    for n in range(rounds + 1):
        far = "list_dot_product(v.q, v.q) - 2 * list_dot_product(v.q, c.q) + list_dot_product(c.q, c.q)"
        steps.append(f"a{n} AS (SELECT v.vec_id, v.q, c.cluster, {far} AS distance FROM v CROSS JOIN c{n} c QUALIFY row_number() OVER (PARTITION BY v.vec_id ORDER BY distance, c.cluster) = 1)")
        if n < rounds:
            steps += [
                f"m{n} AS (SELECT cluster, place, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(q)::BIGINT AS x, generate_subscripts(q, 1) AS place FROM a{n}) GROUP BY ALL)",
                f"g{n} AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY place) AS q FROM m{n} GROUP BY cluster)",
                f"c{n + 1} AS (SELECT c.cluster, coalesce(g.q, c.q) AS q FROM c{n} c LEFT JOIN g{n} g USING (cluster))",
            ]
    return f"""
WITH {", ".join(steps)}
SELECT a.vec_id, a.cluster::INT AS cluster, a.distance::BIGINT AS distance,
  (sum(a.distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia, (sum(a.distance) OVER ())::BIGINT AS inertia,
  sha256(list_aggregate(list_transform(c.q, lambda x: x::BIGINT::VARCHAR), 'string_agg', ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c USING (cluster)
"""


SQL = _sql()
