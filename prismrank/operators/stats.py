"""Paired tests (T-1 to T-6, F5).

Test statistics are aggregations.  Tail probabilities need special functions
that SQL does not have; they are computed for a table of a row per comparison.
Resampling draws a number per pair and round from a hash of the pair's id and
sums in the tasks that hold the pairs, so a group may have any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + k * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + k / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1.0) < 1e-16:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularized."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _fraction(a, b, x) / a
    return 1.0 - front * _fraction(b, a, 1 - x) / b


def t_tail(t: float, freedom: float) -> float:
    """Two-sided probability of Student's t."""
    return 1.0 if t == 0 else incomplete_beta(freedom / 2, 0.5, freedom / (freedom + t * t))


def chi2_tail(x: float) -> float:
    """Upper tail for one degree of freedom."""
    return 1.0 if x <= 0 else math.erfc(math.sqrt(x / 2))


def t_probability(t: Column | str, n: Column | str) -> Column:
    """Two-sided p of a t statistic of n pairs.  The function is made on use:
    it needs a session, which workers that import this module do not have."""

    @F.pandas_udf("double")
    def p(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) or b < 2 else t_tail(a, b - 1) for a, b in zip(t, n)], dtype="float64")

    return p(t, n)


def chi2_probability(x: Column | str) -> Column:
    @F.pandas_udf("double")
    def p(x: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) else chi2_tail(a) for a in x], dtype="float64")

    return p(x)


def finite(x: Column) -> Column:
    """F5."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def paired_t(pairs: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """T-1 / T-3: per group n_pairs, t_stat and p_value over finite pairs.
    Null for fewer than two; (0, 1) if all pairs are equal up to rounding."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    rows = pairs.filter(finite(a) & finite(b)).select(*by, (a - b).alias("d"), (F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b)).alias("close"))
    s = rows.groupBy(*by).agg(F.count("d").alias("n_pairs"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd"), F.bool_and("close").alias("same"))
    t = F.when(F.col("n_pairs") < 2, None).when(F.col("same"), 0.0).when(F.col("sd") > 0, F.col("mean_diff") / (F.col("sd") / F.sqrt("n_pairs")))
    return s.withColumn("t_stat", t).withColumn("p_value", t_probability("t_stat", "n_pairs")).drop("sd", "same")


def paired_t_table(fold_rows: DataFrame, reference: str, metrics: list[str], level: float = 0.05) -> DataFrame:
    """T-2 / J8: every other method against ``reference`` over shared folds,
    by metric, with a flag and the direction of the difference."""
    stacked = fold_rows.select("method", "fold_id", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("s")).select("method", "fold_id", "s.*")
    ours = stacked.filter(F.col("method") == reference).select("fold_id", "metric", F.col("v").alias("x"))
    other = stacked.filter(F.col("method") != reference).withColumnRenamed("v", "y")
    out = paired_t(other.join(ours, ["fold_id", "metric"]), "x", "y", ["method", "metric"])
    direction = F.when(F.col("mean_diff") > 0, "better").when(F.col("mean_diff") < 0, "worse").otherwise("equal")
    return out.select(F.lit(reference).alias("reference_method"), F.col("method").alias("compared_method"), "metric", "n_pairs", "t_stat", "p_value", F.coalesce(F.col("p_value") < level, F.lit(False)).alias("significant"), direction.alias("direction"))


def bonferroni(tests: DataFrame, p: str = "p_value") -> DataFrame:
    """min(p * number of tests, 1)."""
    n = F.broadcast(tests.agg(F.count(p).alias("__m")))
    return tests.crossJoin(n).withColumn("p_bonferroni", F.when(F.col(p).isNotNull(), F.least(F.col(p) * F.col("__m"), F.lit(1.0)))).drop("__m")


def mcnemar(pairs: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """T-5: of two 0/1 columns per group: b (only x), c (only y), chi2 with
    continuity correction, p_value."""
    b = F.count(F.when((F.col(x) == 1) & (F.col(y) == 0), 1))
    c = F.count(F.when((F.col(x) == 0) & (F.col(y) == 1), 1))
    s = pairs.groupBy(*by).agg(b.alias("b"), c.alias("c"))
    n = F.col("b") + F.col("c")
    s = s.withColumn("chi2", F.when(n == 0, 0.0).otherwise(F.pow(F.abs(F.col("b") - F.col("c")) - 1, 2) / n))
    return s.withColumn("p_value", chi2_probability("chi2"))


# ---- resampling ---------------------------------------------------------------


def _hashes(seed: int, ids: np.ndarray, n: int) -> np.ndarray:
    """n numbers of 64 bits per id, the same wherever a row lies."""
    x = ids.astype(np.uint64)[:, None] + np.uint64(seed * 0xD1342543DE82EF95 & (1 << 64) - 1)
    x = x * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, n + 1, dtype=np.uint64)[None, :] * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _poisson_table() -> np.ndarray:
    """The Poisson(1) number of each of 2^16 equally likely values."""
    edges, p = [], math.exp(-1)
    for k in range(10):
        edges.append(p + (edges[-1] if edges else 0.0))
        p /= k + 1
    return np.searchsorted(np.array(edges), (np.arange(1 << 16) + 0.5) / (1 << 16), "right").astype(np.float32)


def poisson_weights(seed: int, ids: np.ndarray, rounds: int) -> np.ndarray:
    return _poisson_table()[_hashes(seed, ids, -(-rounds // 4)).view(np.uint16)[:, :rounds]]


def signs(seed: int, ids: np.ndarray, rounds: int) -> np.ndarray:
    bits = np.unpackbits(_hashes(seed, ids, -(-rounds // 64)).view(np.uint8), axis=1)[:, :rounds]
    return 1.0 - 2.0 * bits.astype(np.float32)


def _round_sums(batches: Iterator[pa.RecordBatch], by: int, kinds: pa.Schema, rounds: int, draw, seed: int, step: int = 4096) -> Iterator[pa.RecordBatch]:
    """Per group and round: sums of the drawn numbers times the differences, and
    of the numbers; one row per group of this task's rows."""
    held: dict[tuple, list[np.ndarray]] = {}
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in range(by)))) if by else [()] * batch.num_rows
        at: dict[tuple, list[int]] = {}
        for i, k in enumerate(keys):
            at.setdefault(k, []).append(i)
        d, ids = batch["d"].to_numpy(), batch["__id"].to_numpy().view(np.uint64)
        for k, rows in at.items():
            mine = held.setdefault(k, [np.zeros(rounds), np.zeros(rounds), np.zeros(2)])
            for a in range(0, len(rows), step):
                some = np.array(rows[a : a + step])
                w = draw(seed, ids[some], rounds)
                mine[0] += d[some] @ w.astype(np.float64)
                mine[1] += w.sum(0, dtype=np.float64)
                mine[2] += (d[some].sum(), len(some))
    for k, (x, n, whole) in held.items():
        one = [pa.array([v], kinds.field(i).type) for i, v in enumerate(k)]
        yield pa.RecordBatch.from_arrays([*one, *(pa.array([v.tolist()], pa.list_(pa.float64())) for v in (x, n, whole))], names=kinds.names)


def _rounds(pairs: DataFrame, x: str, y: str, by: list[str], ids: list[str], rounds: int, draw, seed: int) -> DataFrame:
    """by, round, sum (of number times difference), n (of numbers), mean_diff."""
    d = F.col(x).cast("double") - F.col(y).cast("double")
    rows = pairs.filter(finite(F.col(x).cast("double")) & finite(F.col(y).cast("double"))).select(*by, d.alias("d"), F.xxhash64(*by, *ids).alias("__id"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = "".join(f"{c} {kinds[c]}, " for c in by) + "sums array<double>, numbers array<double>, whole array<double>"
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    parts = rows.mapInArrow(lambda it: _round_sums(it, len(by), arrow, rounds, draw, seed), schema)
    mean = parts.groupBy(*by).agg((F.sum(F.get("whole", F.lit(0))) / F.sum(F.get("whole", F.lit(1)))).alias("mean_diff"), F.sum(F.get("whole", F.lit(1))).alias("pairs"))
    each = parts.select(*by, F.posexplode(F.arrays_zip("sums", "numbers")).alias("round", "s"))
    per = each.groupBy(*by, "round").agg(F.sum("s.sums").alias("sum"), F.sum("s.numbers").alias("n"))
    # a row per group, and a row per group and round
    return per.join(F.broadcast(mean), by) if by else per.crossJoin(F.broadcast(mean))


def bootstrap(pairs: DataFrame, x: str, y: str, by: list[str], ids: list[str], rounds: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """T-4 at any size: per group mean_diff, ci_lower and ci_upper (percentiles
    of the rounds' means).  Every pair has a Poisson(1) weight per round, drawn
    from a hash of ``ids`` (columns that tell pairs apart), so the intervals do
    not depend on how rows are dealt; tasks sum, nothing is gathered."""
    r = _rounds(pairs, x, y, by, ids, rounds, poisson_weights, seed).filter("n > 0").withColumn("m", F.col("sum") / F.col("n"))
    tails = F.lit((1 - level) / 2), F.lit((1 + level) / 2)
    return r.groupBy(*by).agg(F.first("mean_diff").alias("mean_diff"), F.percentile("m", tails[0]).alias("ci_lower"), F.percentile("m", tails[1]).alias("ci_upper"))


def permutation(pairs: DataFrame, x: str, y: str, by: list[str], ids: list[str], rounds: int = 1000, seed: int = 42) -> DataFrame:
    """T-6 at any size: two-sided sign-flip test of the mean difference, per
    group: mean_diff, p_value.  Signs are drawn from a hash of ``ids``."""
    r = _rounds(pairs, x, y, by, ids, rounds, signs, seed)
    extreme = F.abs(F.col("sum") / F.col("pairs")) >= F.abs("mean_diff") - 1e-15
    return r.groupBy(*by).agg(F.first("mean_diff").alias("mean_diff"), F.avg(extreme.cast("double")).alias("p_value"))
