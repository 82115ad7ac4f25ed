"""Band graphs of one sample, as expressions over its collected bands.

``bands`` is ARRAY<ARRAY<DOUBLE>> (B vectors of D), ``query`` ARRAY<DOUBLE>.
A sample's graph needs nothing but its own row, so none of these shuffles; the
edge form of a matrix is one ``posexplode`` away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismrank.functions import vectors as V


def collect_bands(long: DataFrame, sample: str = "sample_id", position: str = "band_pos", vector: str = "x") -> DataFrame:
    """(sample, position, vector) rows to (sample, bands), in order of position."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(position), V.doubles(vector).alias("x"))))
    return long.groupBy(sample).agg(F.transform(pairs, lambda p: p["x"]).alias("bands"))


def explode_bands(wide: DataFrame, sample: str = "sample_id", bands: str = "bands") -> DataFrame:
    return wide.select(sample, F.posexplode(bands).alias("band_pos", "x"))


def split_bands(vector: Column | str, bands: int, width: int) -> Column:
    """A flat vector as ``bands`` consecutive vectors of ``width``."""
    v = V.doubles(vector)
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.slice(v, b * width + 1, F.lit(width)))


def query_weights(bands: Column | str, query: Column | str, sigma: float = 0.5, normalize: bool = True) -> Column:
    """Softmax over bands of the (cosine) similarity to the query / sigma."""
    if sigma <= 0:
        raise ValueError("sigma must be positive")
    metric = "cosine" if normalize else "dot"
    q = V.col(query)
    return V.softmax(F.transform(V.col(bands), lambda b: V.similarity(b, q, metric) / sigma))


def pairwise(bands: Column | str, normalize: bool = True, clamp: bool = True) -> Column:
    """A1: B x B similarities, negatives set to 0 if ``clamp``."""
    bands = V.col(bands)
    unit = F.transform(bands, lambda b: V.l2_normalize(b)) if normalize else bands
    low = (lambda x: F.greatest(x, F.lit(0.0))) if clamp else (lambda x: x)
    return V.let(unit, lambda u: F.transform(u, lambda a: F.transform(u, lambda b: low(V.dot(a, b)))))


def symmetric_normalize(matrix: Column | str, eps: float = 1e-8) -> Column:
    """A2: a_ij / sqrt((d_i + eps) (d_j + eps)) with row sums d."""

    def divide(m: Column, d: Column) -> Column:
        return F.transform(m, lambda row, i: F.transform(row, lambda a, j: a / F.sqrt(F.get(d, i) * F.get(d, j))))

    return V.let(V.col(matrix), lambda m: V.let(F.transform(m, lambda row: V.total(row) + eps), lambda d: divide(m, d)))


def symmetric(matrix: Column) -> Column:
    return V.let(matrix, lambda m: F.transform(m, lambda row, i: F.transform(row, lambda x, j: 0.5 * (x + F.get(F.get(m, j), i)))))


def affinity(bands: Column | str, query: Column | str, sigma: float = 0.5, tau: float | None = None, normalize: bool = True) -> Column:
    """A3: similarities (clamped, or a row softmax of S / tau) times the outer
    product of the query weights, made symmetric and normalized once."""
    weights = query_weights(bands, query, sigma, normalize)
    s = pairwise(bands, normalize, clamp=tau is None)
    if tau is not None:
        if tau <= 0:
            raise ValueError("tau must be positive")
        s = F.transform(s, lambda row: V.softmax(F.transform(row, lambda x: x / tau)))
    raw = V.let(weights, lambda w: F.transform(s, lambda row, i: F.transform(row, lambda x, j: x * F.get(w, i) * F.get(w, j))))
    return symmetric_normalize(symmetric(raw))


def laplacian(matrix: Column | str, normalized: bool = True, floor: float = 1e-12) -> Column:
    """A4: I - D^-1/2 A D^-1/2, or D - A, of the symmetric part of a matrix."""
    def entries(m: Column, d: Column) -> Column:
        one = lambda i, j: F.when(i == j, 1.0).otherwise(0.0)
        if normalized:
            return F.transform(m, lambda row, i: F.transform(row, lambda a, j: one(i, j) - a / (F.get(d, i) * F.get(d, j))))
        return F.transform(m, lambda row, i: F.transform(row, lambda a, j: one(i, j) * F.get(d, i) - a))

    degree = (lambda row: F.sqrt(F.greatest(V.total(row), F.lit(floor)))) if normalized else (lambda row: V.total(row))
    return V.let(symmetric(V.col(matrix)), lambda m: V.let(F.transform(m, degree), lambda d: entries(m, d)))


def knn(bands: Column | str, k: int) -> Column:
    """Per band the k nearest others by (distance, position), as structs
    (d, j).  With k >= B the row is an error."""
    bands = V.col(bands)

    def nearest(a: Column, i: Column) -> Column:
        others = F.filter(F.transform(bands, lambda b, j: F.struct(V.l2_distance(a, b).alias("d"), j.alias("j"))), lambda s: s["j"] != i)
        return F.slice(F.array_sort(others), 1, k)

    checked = F.when(F.size(bands) <= k, F.raise_error(F.lit(f"k={k} needs more than {k} bands")).cast("array<array<double>>")).otherwise(bands)
    return F.transform(checked, nearest)


def manifold_loss(fused: Column | str, bands: Column | str, neighbours: Column | str, lambda_m: float = 0.1) -> Column:
    """Lambda times the mean, over bands and their neighbours, of the
    distance of the fused vector to the neighbour."""
    f, bands = V.col(fused), V.col(bands)
    rows = F.transform(V.col(neighbours), lambda row: V.total(F.transform(row, lambda s: V.l2_distance(f, F.get(bands, s["j"])))) / F.size(row))
    return lambda_m * V.total(rows) / F.size(rows)


def preservation(fused: Column | str, bands: Column | str, neighbours: Column | str, k_check: int) -> Column:
    """Struct of the share of band neighbours that are among the fused
    vector's nearest ``k_check``, and the mean distance to all neighbours."""
    f, bands, neighbours = V.col(fused), V.col(bands), V.col(neighbours)
    near = F.slice(F.array_sort(F.transform(bands, lambda b, j: F.struct(V.l2_distance(f, b).alias("d"), j.alias("j")))), 1, k_check)
    near = F.transform(near, lambda s: s["j"])
    kept = F.aggregate(neighbours, F.lit(0), lambda n, row: n + F.size(F.array_intersect(F.transform(row, lambda s: s["j"]), near)))
    all_ = F.aggregate(neighbours, F.lit(0), lambda n, row: n + F.size(row))
    return F.struct((kept / F.greatest(all_, F.lit(1))).alias("preservation_rate"), manifold_loss(f, bands, neighbours, 1.0).alias("mean_neighbor_dist"))


def fuse(bands: Column | str, weights: Column | str, normalize: bool = True) -> Column:
    """Weighted sum of the bands, to unit length if ``normalize``."""
    out = V.weighted_sum(bands, weights)
    return V.l2_normalize(out) if normalize else out


def mean_fusion(bands: Column | str) -> Column:
    """P14."""
    return V.l2_normalize(V.mean_vector(bands))


def affinity_fusion(bands: Column | str, query: Column | str, sigma: float = 0.5) -> Column:
    """The query weights alone, without a graph."""
    return fuse(bands, query_weights(bands, query, sigma))


def edges(matrix: DataFrame, sample: str, column: str, value: str) -> DataFrame:
    """A matrix column as an edge table (sample, i, j, value)."""
    rows = matrix.select(sample, F.posexplode(column).alias("i", "row"))
    return rows.select(sample, "i", F.posexplode("row").alias("j", value))
