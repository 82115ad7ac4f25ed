"""Vectors as whole numbers, and exact sums of them over all tasks.

Components become floor(scale * x) of their doubles.  Whole numbers below
``SMALL`` are worked on as 64-bit integers, in which squared distances cannot
overflow; a block that holds a larger one is worked on as Python integers, with
the same results.  Sums leave a task as limbs of 40 bits, so that their grouped
sums cannot overflow either.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALL = 1 << 26
LIMB = 40
LONG = (1 << 63) - 1
PARTIAL = "slot int, place int, limb int, total long"
#: Vectors of a batch that are worked on at once.
ROWS = 2048


def quantized(vectors: DataFrame, scale: float, components: int | None = None, *others: str) -> DataFrame:
    """vec_id, q (array<double> of whole numbers) and ``others`` of the vectors
    that are not null and hold nothing null or non-finite; with ``components``,
    only those of that length.  Components that leave the doubles when they are
    scaled count as non-finite."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * scale) < float("inf")))
    rows = vectors.filter(F.col("embedding").isNotNull() & fine)
    if components is not None:
        rows = rows.filter(F.size("embedding") == components)
    # doubles from 2^53 are whole already, and may not fit the long of floor
    whole = lambda v: F.when(F.abs(v * scale) < 2.0**53, F.floor(v * scale).cast("double")).otherwise(v * scale)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, whole).alias("q"), *others)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers; missing components are 0."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    n = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = flat.astype(np.int64) if np.abs(flat).max(initial=0) < SMALL else np.array([int(v) for v in flat.tolist()], object)
    if (n == width).all():
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), width), flat.dtype)
    out[np.arange(width) < n[:, None]] = flat
    return out


def whole(values: list[list[int]]) -> np.ndarray:
    """A table of the driver's whole numbers."""
    small = all(abs(v) < SMALL for row in values for v in row)
    return np.array(values, np.int64 if small else object).reshape(len(values), -1)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows and entries by the expansion of their norms."""
    if object in (x.dtype, c.dtype):
        x, c = x.astype(object), c.astype(object)
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None]


def as_long(x: np.ndarray) -> pa.Array:
    """Whole numbers clipped to 64 bits."""
    return pa.array((np.minimum(x, LONG) if x.dtype == object else x).astype(np.int64))


def partial_sums(totals: np.ndarray) -> pa.RecordBatch:
    """The rows of ``PARTIAL`` of a table of totals; zeros are left out."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    limb, done = 0, False
    while not done:
        done = bool(((totals >= -1) & (totals <= 0)).all())  # the sign stays
        low = totals if done else totals & ((1 << LIMB) - 1)
        slot, place = np.nonzero(low)
        for column, x in zip(out, (slot, place, np.full(len(slot), limb), low[slot, place])):
            column.append(x.astype(np.int64))
        totals, limb = totals >> LIMB, limb + 1
    slot, place, limbs, total = (np.concatenate(x) for x in out)
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int32()) for x in (slot, place, limbs)), pa.array(total)], names=["slot", "place", "limb", "total"])


def summed(rows: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], slots: int, places: int) -> list[list[int]]:
    """Totals by slot and place of what ``partial`` makes of each task's rows.
    The driver gets a row per slot, place and limb: the size of the model."""
    totals = [[0] * places for _ in range(slots)]
    for slot, place, limb, total in rows.mapInArrow(partial, PARTIAL).groupBy("slot", "place", "limb").agg(F.sum("total")).collect():
        totals[slot][place] += total << LIMB * limb
    return totals


def long_sum(column: str) -> Column:
    """The exact sum of a column of longs, clipped to 64 bits."""
    return F.least(F.sum(F.col(column).cast("decimal(20,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")
