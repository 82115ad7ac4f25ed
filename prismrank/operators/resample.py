"""Resampling of decoded cubes, and what encoders are given.

A cube is a flat band-major array with its height and width.  Order-1
(bilinear) resampling is separable: a matrix for the rows, one for the columns,
which depend on the sizes alone; a task keeps those of the sizes it has met.
Two alignments are in use: with ``corners`` the first and last cells of both
grids lie on each other (patches of several resolutions), without it the cells'
outer edges do (what encoders are trained with).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismrank.operators.pixels import pool_weights

#: Means and deviations by channel of the public image encoder.
ENCODER_MEAN = (0.48145466, 0.4578275, 0.40821073)
ENCODER_STD = (0.26862954, 0.26130258, 0.27577711)


def _kind(cubes: DataFrame) -> str:
    """Components stay what they are, float or double."""
    return "double" if cubes.schema["cube"].dataType.simpleString() == "array<double>" else "float"


def axis_weights(size: int, to: int, corners: bool) -> list[tuple[int, int, float]]:
    """Output cell, input cell and weight along one axis."""
    if not corners:
        return pool_weights(size, to)
    out = []
    for o in range(to):
        x = o * (size - 1) / (to - 1) if to > 1 else 0.0
        a = min(int(np.floor(x)), size - 1)
        f = x - a
        out.append((o, a, 1 - f))
        if f > 0 and a + 1 < size:
            out.append((o, a + 1, f))
    return out


def axis_matrix(size: int, to: int, corners: bool) -> np.ndarray:
    w = np.zeros((to, size))
    for o, i, x in axis_weights(size, to, corners):
        w[o, i] += x
    return w


class Resampler:
    """(bands, height, width) to (bands, to, to)."""

    def __init__(self, to: tuple[int, int], corners: bool) -> None:
        self.to, self.corners, self.known = to, corners, {}

    def axis(self, size: int, to: int) -> np.ndarray:
        if (size, to) not in self.known:
            self.known[size, to] = axis_matrix(size, to, self.corners)
        return self.known[size, to]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, np.float64)
        return x if x.shape[1:] == self.to else self.axis(x.shape[1], self.to[0]) @ x @ self.axis(x.shape[2], self.to[1]).T


def _cube(flat: np.ndarray, height: int, width: int) -> np.ndarray:
    if not height or not width or len(flat) % (height * width):
        raise ValueError(f"{len(flat)} values are no bands of {height} x {width}")
    return flat.reshape(-1, height, width)


def resampled(cubes: DataFrame, height: int, width: int | None = None, corners: bool = False) -> DataFrame:
    """sample_id, height, width, cube of cubes of any sizes; an empty or
    misshapen cube is an error, a null one stays null."""
    to, component = (height, width or height), _kind(cubes)
    exact = np.float64 if component == "double" else np.float32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = Resampler(to, corners)
        for b in batches:
            out = [None if c.as_py() is None else change(_cube(c.values.to_numpy(zero_copy_only=False), h, w)).reshape(-1).astype(exact) for c, h, w in zip(b["cube"], b["height"].to_pylist(), b["width"].to_pylist())]
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b["sample_id"], pa.array([to[0]] * n, pa.int32()), pa.array([to[1]] * n, pa.int32()), pa.array(out, pa.list_(pa.from_numpy_dtype(exact)))], names=["sample_id", "height", "width", "cube"])

    kind = cubes.schema["sample_id"].dataType.simpleString()
    return cubes.select("sample_id", "height", "width", "cube").mapInArrow(run, f"sample_id {kind}, height int, width int, cube array<{component}>")


def stacked(files: DataFrame, reader: Callable[[bytes], np.ndarray], bands: tuple[str, ...], size: int = 120, scale: float | None = 10_000.0, clamp: tuple[float, float] | None = (0.0, 1.0)) -> DataFrame:
    """One cube per patch from files of one band each, of any resolutions
    (sample_id, band, content), in the order of ``bands``; each is read and
    resampled where its bytes are, and a patch without one of them is an error.
    ``reader``: bytes -> (height, width)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = Resampler((size, size), True)
        for b in batches:
            out = []
            for data in b["content"]:
                x = change(np.asarray(reader(data.as_py()), np.float32)[None])[0]
                x = x if scale is None else x / scale
                out.append((x if clamp is None else np.clip(x, *clamp)).reshape(-1).astype(np.float32))
            yield pa.RecordBatch.from_arrays([b["sample_id"], b["band_pos"], pa.array(out, pa.list_(pa.float32()))], names=["sample_id", "band_pos", "image"])

    place = F.array_position(F.array(*[F.lit(b) for b in bands]), F.col("band")).cast("int").alias("band_pos")
    kind = files.schema["sample_id"].dataType.simpleString()
    each = files.select("sample_id", place, "content").filter("band_pos > 0").mapInArrow(run, f"sample_id {kind}, band_pos int, image array<float>")
    # a patch's bands, a few arrays, come together
    held = F.array_sort(F.collect_list(F.struct("band_pos", "image")))
    whole = each.groupBy("sample_id").agg(held.alias("held"), F.countDistinct("band_pos").alias("n"), F.count(F.lit(1)).alias("rows"))
    fault = F.concat(F.lit("patch "), F.col("sample_id").cast("string"), F.lit(f" has not one file for each of {len(bands)} bands"))
    cube = F.when((F.col("n") == len(bands)) & (F.col("rows") == len(bands)), F.flatten(F.transform("held", lambda x: x["image"]))).otherwise(F.raise_error(fault).cast("array<float>"))
    return whole.select("sample_id", F.lit(size).alias("height"), F.lit(size).alias("width"), cube.alias("cube"))


def band(position: int | Column) -> Column:
    """One band of a cube."""
    n = F.col("height") * F.col("width")
    return F.slice("cube", n * position + 1, n)


def select_bands(cubes: DataFrame, positions: tuple[int, ...] = (3, 2, 1)) -> DataFrame:
    """Cubes of the bands at these positions, in this order; one that
    a cube lacks is an error."""
    n = F.col("height") * F.col("width")
    enough = F.size("cube") >= n * (max(positions) + 1)
    chosen = F.when(enough, F.concat(*[band(p) for p in positions])).otherwise(F.raise_error(F.lit(f"a cube lacks one of the bands {positions}")).cast(f"array<{_kind(cubes)}>"))
    return cubes.withColumn("cube", chosen)


def replicated(cubes: DataFrame, times: int = 3) -> DataFrame:
    """sample_id, band_pos and a cube that holds the band ``times`` times."""
    n = F.col("height") * F.col("width")
    each = cubes.select("sample_id", "height", "width", "cube", F.explode(F.sequence(F.lit(0), (F.size("cube") / n).cast("int") - 1)).alias("band_pos"))
    return each.select("sample_id", "band_pos", "height", "width", F.flatten(F.array_repeat(band(F.col("band_pos")), times)).alias("cube"))


def standardized(cubes: DataFrame, mean: tuple[float, ...] = ENCODER_MEAN, std: tuple[float, ...] = ENCODER_STD) -> DataFrame:
    """Each channel of a cube of as many channels less its mean, by its deviation."""
    n = F.col("height") * F.col("width")
    at = lambda values, i: F.get(F.array(*[F.lit(float(x)) for x in values]), F.floor(i / n).cast("int"))
    return cubes.withColumn("cube", F.transform("cube", lambda x, i: ((x - at(mean, i)) / at(std, i)).cast(_kind(cubes))))


def for_encoder(cubes: DataFrame, size: int = 224, scale: float = 10_000.0, mean: tuple[float, ...] = ENCODER_MEAN, std: tuple[float, ...] = ENCODER_STD) -> DataFrame:
    """P5 as a plan: an image whose largest value exceeds 1 is divided by
    ``scale``, clamped to [0, 1] and resampled; each band, as three channels, is
    standardized.  sample_id, band_pos, height, width, cube."""
    by = F.when(F.array_max("cube") > 1, F.lit(scale)).otherwise(1.0)
    scaled = cubes.withColumn("__by", by).withColumn("cube", F.transform("cube", lambda x: F.least(F.greatest(x / F.col("__by"), F.lit(0.0)), F.lit(1.0)).cast(_kind(cubes)))).drop("__by")
    # a band is resampled once, not once a channel
    return standardized(replicated(resampled(scaled, size), len(mean)), mean, std)
