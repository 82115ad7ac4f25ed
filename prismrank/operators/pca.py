"""Principal components of vectors (A11), fitted by sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismrank.functions import vectors as V
from prismrank.operators.pixels import Pca

#: Components of a vector up to which its covariance, of their square, is summed.
WIDTH = 512


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per row of [x, 1]' [x, 1], summed over a task."""
    held = None
    for batch in batches:
        x = np.array(batch["vec"].to_pylist(), np.float64).reshape(batch.num_rows, -1)
        x = np.hstack([x, np.ones((len(x), 1))])
        held = x.T @ x if held is None else held + x.T @ x
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(held), dtype=np.int32)), pa.array(held.tolist(), pa.list_(pa.float64()))], names=["i", "values"])


def fit(rows: DataFrame, components: int = 3) -> Pca:
    """Of the column ``vec``: components of the covariance, largest first, signs
    fixed by the largest coefficient (ties: the first)."""
    vec = rows.filter("vec is not null").select(V.doubles("vec").alias("vec"))
    width = vec.agg(F.max(F.size("vec"))).first()[0]
    if not width:
        raise ValueError("no vectors")
    if width > WIDTH:
        raise ValueError(f"vectors of {width} components; at most {WIDTH} are summed")
    each = vec.mapInArrow(_sums, "i int, values array<double>").select("i", F.posexplode("values").alias("j", "v"))
    total = np.zeros((width + 1, width + 1))
    for r in each.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # (width + 1)^2 numbers
        total[r.i, r.j] = r.v
    n, mean = total[-1, -1], total[:-1, -1] / total[-1, -1]
    values, vectors = np.linalg.eigh(total[:-1, :-1] / n - np.outer(mean, mean))
    order = np.argsort(values)[::-1][:components]
    found = vectors[:, order].T
    found = found * np.sign(found[np.arange(len(found)), np.abs(found).argmax(1)])[:, None]
    return Pca(tuple(mean), tuple(map(tuple, found)), tuple(values[order]))


def project(rows: DataFrame, state: Pca) -> DataFrame:
    """``rows`` with ``vec`` replaced by its projections."""
    number = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    centred = F.zip_with(V.doubles("vec"), number(state.mean), lambda x, m: x - m)
    return rows.withColumn("vec", centred).withColumn("vec", F.array(*[V.dot(F.col("vec"), number(c)) for c in state.components]))
