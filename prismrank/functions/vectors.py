"""Vector functions on ARRAY<DOUBLE> columns, all inside the JVM.

Every function takes and returns columns; sums run over the array from left to
right.  A null vector gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_FLOOR = 1e-12


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def doubles(v: Column | str) -> Column:
    return col(v).cast("array<double>")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: inside a lambda an
    expression would be computed again for every element."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: x * y))


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def scaled(v: Column | str, factor: Column) -> Column:
    return F.transform(col(v), lambda x: x * factor)


def l2_normalize(v: Column | str, floor: float = NORM_FLOOR) -> Column:
    """V / max(|v|, floor)."""
    v = col(v)
    return let(F.greatest(norm(v), F.lit(floor)), lambda n: F.transform(v, lambda x: x / n))


def cosine(a: Column | str, b: Column | str, floor: float = NORM_FLOOR) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(floor)) * F.greatest(norm(b), F.lit(floor)))


def l2_distance(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(total(F.zip_with(col(a), col(b), lambda x, y: (x - y) * (x - y))))


def similarity(a: Column | str, b: Column | str, metric: str) -> Column:
    """``dot`` takes vectors as they are, ``cosine`` normalizes both."""
    if metric not in ("dot", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    return dot(a, b) if metric == "dot" else cosine(a, b)


def softmax(v: Column | str) -> Column:

    def powers(v: Column) -> Column:
        return let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))

    return let(col(v), lambda v: let(powers(v), lambda p: let(total(p), lambda t: F.transform(p, lambda x: x / t))))


def entropy(w: Column | str, floor: float = 1e-12) -> Column:
    """-sum w ln w, with w floored inside the logarithm."""
    return total(F.transform(col(w), lambda x: -x * F.ln(F.greatest(x, F.lit(floor)))))


def min_max(v: Column | str, least_range: float = 1e-10) -> Column:
    """To [0, 1]; a vector without range becomes uniform, 1 / n each."""

    def scale(v: Column, low: Column, span: Column) -> Column:
        return F.transform(v, lambda x: F.when(span < least_range, 1.0 / F.size(v)).otherwise((x - low) / span))

    return let(col(v), lambda v: let(F.array_min(v), lambda low: let(F.array_max(v) - low, lambda span: scale(v, low, span))))


def weighted_sum(vectors: Column | str, weights: Column | str) -> Column:
    """P13 without the norm: sum of weights[b] * vectors[b]."""
    pairs = F.arrays_zip(col(vectors).alias("v"), col(weights).alias("w"))
    zero = F.transform(F.get(col(vectors), F.lit(0)), lambda x: F.lit(0.0))
    return F.aggregate(pairs, zero, lambda s, p: F.zip_with(s, p["v"], lambda x, y: x + y * p["w"]))


def mean_vector(vectors: Column | str) -> Column:
    return let(col(vectors), lambda v: weighted_sum(v, F.transform(v, lambda x: 1.0 / F.size(v))))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))
