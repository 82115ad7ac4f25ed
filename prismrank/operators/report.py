"""Report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample_std(x: Column | str) -> Column:
    """Sample standard deviation; 0 for a single value."""
    return F.when(F.count(x) > 1, F.stddev_samp(x)).otherwise(0.0)


def mean_std_text(mean: Column, std: Column) -> Column:
    """P17: "12.34±0.56", empty unless both are finite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.when(fine(mean) & fine(std), F.format_string("%.2f±%.2f", mean, std)).otherwise("")


def comparison(fold_rows: DataFrame, metrics: list[str], by: str = "method") -> DataFrame:
    """Per method the folds, and mean, spread and text of each metric."""
    aggs = [F.count_distinct("fold_id").alias("num_folds")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), sample_std(m).alias(f"{m}_std")]
    out = fold_rows.groupBy(by).agg(*aggs)
    return out.withColumns({f"{m}_mean_std": mean_std_text(F.col(f"{m}_mean"), F.col(f"{m}_std")) for m in metrics})


def per_class_table(query_rows: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Per method and class, over queries: AP and hits in percent."""
    aggs = [F.count_distinct("fold_id").alias("num_folds"), F.count(F.lit(1)).alias("num_queries")]
    for name, x in {"map": F.col("ap"), **{f"r_at_{k}": F.col(f"hit_at_{k}") for k in ks}}.items():
        aggs += [F.avg(x * 100).alias(f"{name}_mean"), sample_std(x * 100).alias(f"{name}_std")]
    return query_rows.groupBy("method", "query_label").agg(*aggs)


def order_by_names(rows: DataFrame, column: str, names: list[str], *then: str) -> DataFrame:
    """Rows in the order of ``names``; others follow, by their value."""
    at = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(column))
    have = [c for c in then if c in rows.columns]
    return rows.orderBy(F.when(at == 0, len(names) + 1).otherwise(at), column, *have)


def deltas(stages: DataFrame, metrics: list[str], order: str = "stage_order", lead: str = "r_at_1") -> DataFrame:
    """Difference of each metric to the first and to the previous stage;
    redundant if the leading metric did not grow."""
    w = Window.orderBy(order)
    cols = {}
    for m in metrics:
        cols[f"delta_{m}_vs_first"] = F.col(m) - F.first(m).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        cols[f"incremental_delta_{m}"] = F.col(m) - F.coalesce(F.lag(m).over(w), F.col(m))
    out = stages.withColumns(cols)
    return out.withColumn("redundant", (F.col(order) > 1) & (F.col(f"incremental_delta_{lead}") <= 0))


def sweep_summary(cells: DataFrame, robust_range: float = 1.5) -> DataFrame:
    """Per parameter the first value with the largest R@1, its metrics,
    the range of R@1 and whether that is small.  ``cells``: param_name, pos,
    param_value, r_at_1, r_at_10."""
    best = F.max_by(F.struct("param_value", "r_at_1", "r_at_10"), F.struct(F.col("r_at_1"), -F.col("pos")))
    spread = F.max("r_at_1") - F.min("r_at_1")
    tested = F.transform(F.array_sort(F.collect_list(F.struct("pos", "param_value"))), lambda x: x["param_value"])
    out = cells.groupBy("param_name").agg(F.array_join(tested.cast("array<string>"), ", ").alias("tested_values"), best.alias("b"), spread.alias("spread"))
    return out.select(F.col("param_name").alias("param"), "tested_values", F.col("b.param_value").alias("best_value"), F.round("b.r_at_1", 2).alias("best_r_at_1"), F.round("b.r_at_10", 2).alias("best_r_at_10"), F.round("spread", 2).alias("r_at_1_range"), F.when(F.col("spread") < robust_range, "Yes").otherwise("No").alias("robust"))


def timing(rows: DataFrame, component: str, value: str) -> DataFrame:
    """Mean, median, sample spread, 95th percentile (interpolated), share
    of the total of the means, and the bottleneck."""
    per = rows.groupBy(component).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), sample_std(value).alias("std"), F.percentile(value, F.lit(0.95)).alias("p95"))
    whole = Window.partitionBy()
    return per.withColumn("share_pct", 100 * F.col("mean") / F.sum("mean").over(whole)).withColumn("bottleneck", F.row_number().over(Window.orderBy(F.col("mean").desc(), component)) == 1)


def bad_profiles(rows: DataFrame, parts: list[str], total: str, tolerance: float = 0.05) -> DataFrame:
    """Rows whose parts are not all positive or do not add up."""
    s = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    wrong = (F.abs(s - F.col(total)) > tolerance) | (F.least(*[F.col(p) for p in [*parts, total]]) <= 0)
    return rows.filter(F.coalesce(wrong, F.lit(True)))


def seed_summary(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean and sample spread of each metric over seeds, one row each."""
    stacked = rows.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("x")).select("x.*")
    return stacked.groupBy("metric").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), sample_std("v").alias("std"))


def shift_level(x: Column) -> Column:
    """P23."""
    return F.when(x < 0.10, "Low").when(x < 0.20, "Medium").otherwise("High")


def decorate(query_rows: DataFrame, samples: DataFrame) -> DataFrame:
    """Path and class name of the query and of its first hit."""
    q = samples.select(F.col("sample_id").alias("query_id"), F.col("path").alias("query_path"), F.col("label_name").alias("query_label_name"))
    g = samples.select(F.col("sample_id").alias("top1_gallery_id"), F.col("path").alias("top1_gallery_path"), F.col("label_name").alias("top1_label_name"))
    return query_rows.join(q, "query_id", "left").join(g, "top1_gallery_id", "left")


def against_ours(baselines: DataFrame, ours: DataFrame, metrics: list[str]) -> DataFrame:
    """Methods with ours (one row), and each metric's difference and ratio
    to ours."""
    rows = ours.unionByName(baselines, allowMissingColumns=True)
    one = F.broadcast(ours.limit(1).select(*[F.col(m).alias(f"__{m}") for m in metrics]))
    out = rows.crossJoin(one)
    cols = {}
    for m in metrics:
        cols[f"{m}_minus_ours"] = F.col(m) - F.col(f"__{m}")
        cols[f"{m}_ratio"] = F.when(F.col(f"__{m}") != 0, F.col(m) / F.col(f"__{m}"))
    return out.withColumns(cols).drop(*[f"__{m}" for m in metrics])
