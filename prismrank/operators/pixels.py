"""Pixel tables: spectral indices, PCA by sums, stretches.

A pixel table has one row per pixel and one column per channel; every fit is
one distributed aggregation, and only C x C numbers reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismrank.session import kept


def _bounded(x: Column) -> Column:
    return (F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0)) + 1.0) / 2.0


def raw_indices(nir: Column, red: Column, green: Column, savi_l: float = 0.5, eps: float = 1e-6) -> dict[str, Column]:
    """Vegetation, water and soil-adjusted index as defined."""
    return {"ndvi": (nir - red) / (nir + red + eps), "ndwi": (green - nir) / (green + nir + eps), "savi": (1.0 + savi_l) * (nir - red) / (nir + red + savi_l + eps)}


def indices(nir: Column, red: Column, green: Column, savi_l: float = 0.5, eps: float = 1e-6) -> dict[str, Column]:
    """The three indices, clamped to [-1, 1] and mapped to [0, 1]."""
    return {k: _bounded(v) for k, v in raw_indices(nir, red, green, savi_l, eps).items()}


def scale_reflectance(pixels: DataFrame, channels: list[str], by: list[str] | None = None, scale: float = 10_000.0) -> DataFrame:
    """P5: divide an image (all rows, or those of a group) by ``scale`` if it
    has a value above 1, and clamp to [0, 1]."""
    top = F.greatest(*[F.max(c) for c in channels]) if len(channels) > 1 else F.max(channels[0])
    if by:
        high = pixels.groupBy(*by).agg(top.alias("__top"))
        out = pixels.join(high, by)
    else:
        out = pixels.crossJoin(F.broadcast(pixels.agg(top.alias("__top"))))
    factor = F.when(F.col("__top") > 1, F.lit(scale)).otherwise(1.0)
    return out.withColumns({c: F.least(F.greatest(F.col(c) / factor, F.lit(0.0)), F.lit(1.0)) for c in channels}).drop("__top")


def standardize(channel: Column, mean: float, std: float) -> Column:
    return (channel - mean) / std


@dataclass(frozen=True)
class Pca:
    mean: tuple[float, ...]
    components: tuple[tuple[float, ...], ...]
    variance: tuple[float, ...]
    low: tuple[float, ...] | None = None
    high: tuple[float, ...] | None = None


def moments(pixels: DataFrame, channels: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """n, sums and sums of products, in one aggregation."""
    pairs = [(i, j) for i in range(len(channels)) for j in range(i, len(channels))]
    c = [F.col(x).cast("double") for x in channels]
    row = pixels.agg(F.count(F.lit(1)), *[F.sum(x) for x in c], *[F.sum(c[i] * c[j]) for i, j in pairs]).first()
    n, sums = row[0], np.array(row[1 : 1 + len(c)], float)
    products = np.zeros((len(c), len(c)))
    for (i, j), v in zip(pairs, row[1 + len(c) :]):
        products[i, j] = products[j, i] = v
    return n, sums, products


def fit_pca(pixels: DataFrame, channels: list[str], components: int = 3, ranges: bool = True) -> Pca:
    """Components of the covariance E[xx'] - mm' (by n), largest
    first; each has its largest coefficient positive, so signs are fixed.  A
    second pass finds the range of the projections."""
    n, sums, products = moments(pixels, channels)
    if not n:
        raise ValueError("no pixels")
    mean = sums / n
    cov = products / n - np.outer(mean, mean)
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    order = np.argsort(values)[::-1][:components]
    rows = vectors[:, order].T
    rows = rows * np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(1)])[:, None]
    state = Pca(tuple(mean), tuple(map(tuple, rows)), tuple(values[order]))
    if not ranges:
        return state
    p = projections(state, channels)
    low_high = pixels.agg(*[f(x) for f in (F.min, F.max) for x in p]).first()
    return Pca(state.mean, state.components, state.variance, tuple(low_high[: len(p)]), tuple(low_high[len(p) :]))


def projections(state: Pca, channels: list[str]) -> list[Column]:
    out = []
    for row in state.components:
        terms = [(F.col(c).cast("double") - m) * w for c, m, w in zip(channels, state.mean, row)]
        x = terms[0]
        for t in terms[1:]:
            x = x + t
        out.append(x)
    return out


def apply_pca(pixels: DataFrame, state: Pca, channels: list[str], by: list[str] | None = None, names: tuple[str, ...] = ("pc1", "pc2", "pc3"), eps: float = 1e-6) -> DataFrame:
    """Projections to [0, 1], by the fitted range or, without one, by that
    of each group of ``by`` (an image)."""
    names = names[: len(state.components)]
    out = pixels.withColumns(dict(zip(names, projections(state, channels))))
    if state.low is not None:
        low, high = map(list, (map(F.lit, state.low), map(F.lit, state.high)))
    else:
        ends = out.groupBy(*by).agg(*[f(c).alias(f"__{f.__name__}_{c}") for c in names for f in (F.min, F.max)])
        out = out.join(ends, by)
        low, high = ([F.col(f"__{m}_{c}") for c in names] for m in ("min", "max"))
    clamp = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    out = out.withColumns({c: clamp((F.col(c) - a) / (b - a + eps)) for c, a, b in zip(names, low, high)})
    return out.drop(*[c for c in out.columns if c.startswith("__m")])


def _axes(batches: Iterator[pa.RecordBatch], channels: int, components: int) -> Iterator[pa.RecordBatch]:
    """Components of each row's covariance, given as its upper triangle."""
    upper = np.triu_indices(channels)
    for batch in batches:
        cov = np.zeros((batch.num_rows, channels, channels))
        if batch.num_rows:
            cov[:, upper[0], upper[1]] = batch["cov"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            cov[:, upper[1], upper[0]] = cov[:, upper[0], upper[1]]
        values, vectors = np.linalg.eigh(cov)
        w = np.take_along_axis(vectors, np.argsort(values, axis=1)[:, None, ::-1][:, :, :components], 2).transpose(0, 2, 1)
        w = w * np.sign(np.take_along_axis(w, np.abs(w).argmax(2)[:, :, None], 2))
        yield pa.RecordBatch.from_arrays([batch["__image"], batch["__mean"], pa.array(list(w.reshape(len(w), -1)), pa.list_(pa.float64()))], names=["__image", "__mean", "__axes"])


def image_pca(pixels: DataFrame, image: str, channels: list[str], components: int = 3, eps: float = 1e-6) -> DataFrame:
    """Components of each image on its own (covariance by P - 1), its
    projections min-max to [0, 1].  Means and covariances are grouped sums, so an
    image may have any number of pixels; the eigenvectors of all images of a
    batch are found at once."""
    c, k = [F.col(x).cast("double") for x in channels], min(components, len(channels))
    fine = lambda x: F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))  # noqa: E731  an image of one pixel has no covariance
    cov = [fine(F.covar_samp(c[i], c[j])) for i in range(len(c)) for j in range(i, len(c))]
    moments_ = pixels.groupBy(F.col(image).alias("__image")).agg(F.array(*map(F.avg, c)).alias("__mean"), F.array(*cov).alias("cov"))
    kind = pixels.schema[image].dataType.simpleString()
    n = len(channels)
    axes = moments_.mapInArrow(lambda it: _axes(it, n, k), f"__image {kind}, __mean array<double>, __axes array<double>")

    def part(p: int) -> Column:
        terms = [(x - F.get("__mean", F.lit(i))) * F.get("__axes", F.lit(p * len(c) + i)) for i, x in enumerate(c)]
        return sum(terms[1:], terms[0])

    of = lambda t: pixels.join(t, F.col(image).eqNullSafe(F.col("__image")))
    names = [f"pc{p + 1}" for p in range(k)]
    ends = of(axes).groupBy(F.col(image).alias("__image"), "__mean", "__axes").agg(*[f(part(p)).alias(f"__{f.__name__}{p}") for p in range(k) for f in (F.min, F.max)])
    scaled = [F.least(F.greatest((part(p) - F.col(f"__min{p}")) / (F.col(f"__max{p}") - F.col(f"__min{p}") + eps), F.lit(0.0)), F.lit(1.0)).alias(n) for p, n in enumerate(names)]
    return of(ends).select(image, "pixel_id", *scaled)


#: Rows of a group up to which its percentiles are found in one task, and bins of
#: a pass over a larger one.
HELD = 100_000
BINS = 1024


def _same(by: list[str]) -> Column:
    out = F.lit(True)
    for c in by:
        out = out & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return out


def percentiles(pixels: DataFrame, value: str, shares: list[float], by: list[str], held: int = HELD, bins: int = BINS) -> DataFrame:
    """``by`` and ``__q``, the exact interpolated percentiles of each group.

    A group of many rows is narrowed down to the two order statistics of each
    share: a pass counts the rows of a range in bins and goes on with the bin
    that has the wanted rank, between its own least and largest value; until so
    few rows are left that they can be ranked, or all are equal.  What meets in
    a task is a row per bin, or ``held`` rows.  Values that are null or not
    finite are left out."""
    if not by:
        return percentiles(pixels.withColumn("__g", F.lit(0)), value, shares, ["__g"], held, bins).drop("__g")
    x = F.col(value).cast("double")
    rows = pixels.select(*by, x.alias("__x")).filter(F.abs(x) < float("inf"))
    mine = [F.col(c).alias(f"__{c}") for c in by]
    own = [f"__{c}" for c in by]
    sizes = kept(rows.groupBy(*mine).agg(F.count(F.lit(1)).alias("n"), F.min("__x").alias("lo"), F.max("__x").alias("hi")), "sizes")
    large = sizes.filter(F.col("n") > held)
    at_once = F.percentile("__x", F.array(*[F.lit(s) for s in shares])).alias("__q")
    if large.isEmpty():
        return rows.groupBy(*by).agg(at_once)
    small = rows.join(sizes.filter(F.col("n") <= held).select(*own), _same(by)).groupBy(*by).agg(at_once)

    ranks = [F.struct(F.lit(2 * i + k).alias("k"), F.least(F.floor(F.lit(s) * (F.col("n") - 1)) + k, F.col("n") - 1).alias("rank")) for i, s in enumerate(shares) for k in (0, 1)]
    state = kept(large.select("*", F.explode(F.array(*ranks)).alias("t")).select(*own, "t.k", "lo", "hi", "t.rank", "n"), "ranks")
    keys = [*own, "k"]
    while not (open_ := state.filter((F.col("n") > held) & (F.col("lo") < F.col("hi")))).isEmpty():
        width = F.col("hi") / 2 - F.col("lo") / 2  # halves cannot overflow
        bin_ = F.when(F.col("__x") >= F.col("hi"), bins - 1).when(width > 0, F.least(F.floor((F.col("__x") / 2 - F.col("lo") / 2) / width * bins), F.lit(bins - 1))).otherwise(0)
        near = rows.join(open_, _same(by)).filter(F.col("__x").between(F.col("lo"), F.col("hi")))
        counts = near.groupBy(*keys, "rank", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("__x").alias("lo"), F.max("__x").alias("hi"))
        upto = F.sum("c").over(Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        found = counts.withColumn("upto", upto).filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c")))
        done = state.filter((F.col("n") <= held) | (F.col("lo") >= F.col("hi")))
        state = kept(done.unionByName(found.select(*keys, "lo", "hi", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"), F.col("c").alias("n"))), "ranks")
    left = rows.join(state.filter("lo < hi"), _same(by)).filter(F.col("__x").between(F.col("lo"), F.col("hi")))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("__x")) - 1
    picked = left.withColumn("at", place).filter("at = rank").select(*keys, "__x").union(state.filter("lo = hi").select(*keys, "lo"))
    both = F.array_sort(F.collect_list(F.struct("k", F.col("__x").alias("v"))))  # two values a share
    per = picked.groupBy(*own).agg(both.alias("__v")).join(large.select(*[F.col(c).alias(f"__{c}") for c in own], "n"), _same(own))
    v = lambda k: F.get("__v", F.lit(k))["v"]
    q = [v(2 * i) + (F.lit(s) * (F.col("n") - 1) - F.floor(F.lit(s) * (F.col("n") - 1))) * (v(2 * i + 1) - v(2 * i)) for i, s in enumerate(shares)]
    return small.unionByName(per.select(*[F.col(f"__{c}").alias(c) for c in by], F.array(*q).alias("__q")))


def stretch(pixels: DataFrame, value: str, by: list[str] | None = None, low: float = 0.02, high: float = 0.98, eps: float = 1e-8, exact: bool = True, held: int = HELD) -> DataFrame:
    """Percentile stretch to [0, 1], global or by group.  ``exact`` uses
    interpolated percentiles (see ``percentiles``); without it a sketch of
    bounded size."""
    if exact:
        # written, so that their size is known and few of them do not make Spark
        # sort the pixels by group
        ends = kept(percentiles(pixels, value, [low, high], by or [], held), "ends")
    else:
        ends = pixels.groupBy(*(by or [])).agg(F.percentile_approx(value, [low, high], 100_000).alias("__q"))
    if by:
        out = pixels.join(ends.toDF(*[f"__{c}" for c in by], "__q"), _same(by)).drop(*[f"__{c}" for c in by])
    else:
        out = pixels.crossJoin(F.broadcast(ends))  # one row
    a, b = F.get("__q", F.lit(0)), F.get("__q", F.lit(1))
    x = (F.col(value) - a) / (b - a + eps)
    return out.withColumn("stretched", F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))).drop("__q")


def pool_weights(size: int, to: int) -> list[tuple[int, int, float]]:
    """Bilinear weights (output cell, input cell, weight) along one axis,
    with cell centres aligned."""
    out = []
    for o in range(to):
        x = min(max((o + 0.5) * size / to - 0.5, 0.0), size - 1.0)
        a = int(np.floor(x))
        b = min(a + 1, size - 1)
        f = x - a
        out += [(o, a, 1 - f)] if a == b or f == 0 else [(o, a, 1 - f), (o, b, f)]
    return out


def pool_tokens(tokens: DataFrame, size: int, to: int, unit: bool = False) -> DataFrame:
    """(sample_id, y, x, d, value) on a size x size grid to a to x to
    grid; with ``unit`` each token to unit length.  The weight table has a few
    rows."""
    spark = tokens.sparkSession
    axis = pool_weights(size, to)
    wy = F.broadcast(spark.createDataFrame(axis, "oy int, y int, wy double"))
    wx = F.broadcast(spark.createDataFrame(axis, "ox int, x int, wx double"))
    pooled = tokens.join(wy, "y").join(wx, "x").groupBy("sample_id", "oy", "ox", "d").agg(F.sum(F.col("value") * F.col("wy") * F.col("wx")).alias("value"))
    if not unit:
        return pooled
    n = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy("sample_id", "oy", "ox")))  # a token's components
    return pooled.withColumn("value", F.col("value") / F.greatest(n, F.lit(1e-12)))


def descriptor(tokens: DataFrame) -> DataFrame:
    """Mean and maximum over a sample's tokens, added, to unit length.
    ``tokens``: sample_id, d, value."""
    per = tokens.groupBy("sample_id", "d").agg((F.avg("value") + F.max("value")).alias("v"))
    n = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("sample_id")))
    return per.select("sample_id", "d", (F.col("v") / F.greatest(n, F.lit(1e-12))).alias("value"))


def signature(pixels: DataFrame, channels: list[str], by: list[str]) -> DataFrame:
    """Mean of every channel per group."""
    return pixels.groupBy(*by).agg(*[F.avg(c).alias(c) for c in channels])


def histogram(pixels: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Rows per bin; the last bin holds its upper end."""
    at = F.least(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins)) - 1
    return pixels.filter(F.col(value).between(low, high)).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
