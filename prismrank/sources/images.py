"""Image folders and encoders.

Decoding TIFFs and encoding images needs libraries and weights that are not
part of this repository, so both are functions that the caller gives: they run
in Python workers on Arrow batches, and state such as a model is made once per
task.  Everything after them starts from embedding tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def class_folder(spark: SparkSession, root: str, classes: list[str], pattern: str = "*.tif") -> DataFrame:
    """sample_id (by path), path, label, label_name of a folder per class;
    a class without a file is an error.  Only file names are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    names = F.array(*[F.lit(c) for c in classes])
    rows = files.select("path", F.element_at(F.split("path", "/"), -2).alias("label_name"))
    rows = rows.withColumn("label", (F.array_position(names, F.col("label_name")) - 1).cast("int")).filter("label >= 0")
    have = {r.label_name for r in rows.select("label_name").distinct().collect()}
    if missing := [c for c in classes if c not in have]:
        raise FileNotFoundError(f"no files for {', '.join(missing)} in {root}")
    return rows.select(F.xxhash64("path").alias("sample_id"), "path", "label", "label_name")


def decode(samples: DataFrame, reader: Callable[[bytes], np.ndarray], bands: int, scale: float = 10_000.0) -> DataFrame:
    """sample_id, height, width and ``cube``, a flat band-major
    array scaled and clipped to [0, 1], from sample_id and ``content`` (a file's
    bytes, as the ``binaryFile`` source gives them).  ``reader``: bytes -> (bands, height, width)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, heights, widths, cubes = [], [], [], []
            for i, data in zip(batch["sample_id"].to_pylist(), batch["content"]):
                x = np.asarray(reader(data.as_py()), np.float32)
                if x.ndim != 3 or x.shape[0] != bands:
                    raise ValueError(f"sample {i}: shape {x.shape}, not {bands} bands")
                x = np.clip(x / scale if x.max(initial=0) > 1 else x, 0, 1)
                ids.append(i)
                heights.append(x.shape[1])
                widths.append(x.shape[2])
                cubes.append(x.reshape(-1))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(heights, pa.int32()), pa.array(widths, pa.int32()), pa.array(cubes, pa.list_(pa.float32()))], names=["sample_id", "height", "width", "cube"])

    return samples.select("sample_id", "content").mapInArrow(run, "sample_id long, height int, width int, cube array<float>")


def encode(rows: DataFrame, make_encoder: Callable[[], Callable[[list], np.ndarray]], column: str, width: int, batch: int = 64, sample: str = "sample_id") -> DataFrame:
    """Sample, vec.  ``make_encoder()`` loads a model once per task
    and returns a function from a list of values to an (n, width) array; it is
    given micro-batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for b in batches:
            encoder = encoder or make_encoder()
            for at in range(0, b.num_rows, batch):
                some = b.slice(at, batch)
                x = np.asarray(encoder(some[column].to_pylist()), np.float32)
                if x.shape != (some.num_rows, width):
                    raise ValueError(f"the encoder returned {x.shape}, not {(some.num_rows, width)}")
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                yield pa.RecordBatch.from_arrays([some[sample], pa.array(list(x), pa.list_(pa.float32()))], names=[sample, "vec"])

    kind = rows.schema[sample].dataType.simpleString()
    return rows.select(sample, column).mapInArrow(run, f"{sample} {kind}, vec array<float>")


def pixel_rows(cubes: DataFrame, bands: int) -> DataFrame:
    """Decoded cubes as a pixel table: sample_id, pixel_id, one column per
    band."""
    n = F.col("height") * F.col("width")
    each = cubes.select("sample_id", "cube", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("pixel_id"))
    return each.select("sample_id", "pixel_id", *[F.get("cube", F.lit(b) * F.col("n") + F.col("pixel_id")).cast("double").alias(f"b{b}") for b in range(bands)])
