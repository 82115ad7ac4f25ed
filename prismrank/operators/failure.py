"""Failures of retrieval: extraction, causes, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismrank.functions import vectors as V

# Names of causes, in the order in which ties are resolved.
CAUSES = ("cloud_cover", "mixed_scene", "rare_class", "seasonal_variation")


def failures(query_rows: DataFrame, threshold_rank: int = 1) -> DataFrame:
    """Queries without a relevant row up to a rank, with the class
    that was found first, its score, the first hit and AP."""
    missed = F.col("first_hit_rank").isNull() | (F.col("first_hit_rank") > threshold_rank)
    return query_rows.filter(missed).select("query_id", F.col("query_label").alias("true_label"), F.col("top1_label").alias("predicted_label"), F.col("top1_score"), "first_hit_rank", F.col("ap").alias("average_precision"))


def cloud(b10: Column, b09: Column, cirrus: float = 0.15, vapor: float = 0.25) -> tuple[Column, Column]:
    """Fires if one of two band means passes its threshold; half the ratio, up
    to 1, is the confidence."""
    score = F.greatest(b10 / cirrus, b09 / vapor)
    return score > 1, F.least(score, F.lit(2.0)) / 2.0


def mixed_pixels(means: Column, stds: Column, threshold: float = 0.7) -> tuple[Column, Column]:
    """Mean over bands of spread / mean inside the image."""
    cv = V.total(F.zip_with(stds, means, lambda s, m: s / (m + 1e-8))) / F.size(means)
    score = F.least(cv, F.lit(1.0))
    return score > threshold, score


def mixed_bands(bands: Column | str, threshold: float = 0.7) -> tuple[Column, Column]:
    """Without pixels: one minus the mean cosine of all pairs of bands."""
    b = V.col(bands)
    unit = F.transform(b, lambda x: V.l2_normalize(x, 1e-8))
    sums = F.transform(unit, lambda x: V.total(F.transform(unit, lambda y: V.dot(x, y))))
    diversity = 1.0 - V.total(sums) / (F.size(b) * F.size(b))
    return diversity > 1.0 - threshold, F.least(diversity / 0.5, F.lit(1.0))


def class_levels(class_counts: DataFrame, percentile: float = 0.2) -> DataFrame:
    """One row: the percentile and the median of the classes' counts."""
    return class_counts.agg(F.percentile("n", F.lit(percentile)).alias("rare_at"), F.median("n").alias("median_n"))


def rare(n: Column, rare_at: Column, median: Column) -> tuple[Column, Column]:
    share = F.when(median > 0, F.greatest(F.lit(0.0), 1.0 - n / median)).otherwise(0.0)
    return n <= rare_at, F.least(share, F.lit(1.0))


def seasonal(distance: Column, spread: Column, threshold: float = 1.5) -> tuple[Column, Column]:
    z = distance / spread
    usable = spread.isNotNull() & (spread >= 1e-8)
    return usable & (z > threshold), F.when(usable, F.least(z / (2 * threshold), F.lit(1.0))).otherwise(0.0)


def class_stats(samples: DataFrame, label: str = "label", vector: str = "vec") -> DataFrame:
    """Centroid of each class and the sample spread of the distances to
    it.  ``samples``: label and vector."""
    dims = samples.select(label, F.posexplode(vector).alias("d", "x")).groupBy(label, "d").agg(F.avg("x").alias("x"))
    centroid = dims.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda p: p["x"]).alias("centroid"))
    far = samples.join(centroid, label).select(label, V.l2_distance(vector, "centroid").alias("far"))
    spread = far.groupBy(label).agg(F.stddev_samp("far").alias("spread"), F.count(F.lit(1)).alias("n"))
    return centroid.join(spread, label)


def choose_cause(fired: dict[str, tuple[Column, Column]]) -> tuple[Column, Column]:
    """The detector that fired with the largest confidence; among equals
    the earlier one; without any a mixed scene at 0.2.  ``fired``: cause ->
    (fires, confidence)."""
    cases = [F.when(F.coalesce(f, F.lit(False)), F.struct(c.cast("double").alias("confidence"), F.lit(-CAUSES.index(name)).alias("place"), F.lit(name).alias("cause"))) for name, (f, c) in fired.items()]
    best = F.array_max(F.filter(F.array(*cases), lambda x: x.isNotNull()))
    return F.coalesce(best["cause"], F.lit("mixed_scene")), F.coalesce(best["confidence"], F.lit(0.2))


def by_cause(cases: DataFrame, causes: DataFrame) -> DataFrame:
    """Count, share, classes and mean confidence of every cause; zeros
    for causes that do not occur.  ``causes``: the dimension, column cause."""
    got = cases.groupBy(F.col("failure_cause").alias("cause")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("true_label")).alias("classes"), F.avg("cause_confidence").alias("conf"))
    all_ = F.broadcast(cases.agg(F.count(F.lit(1)).alias("total")))
    out = causes.join(got, "cause", "left").crossJoin(all_)
    return out.select("cause", F.coalesce("n", F.lit(0)).alias("count"), (F.coalesce("n", F.lit(0)) / F.greatest("total", F.lit(1)) * 100).alias("percentage"), F.coalesce(F.array_join(F.col("classes").cast("array<string>"), ", "), F.lit("")).alias("affected_classes"), F.coalesce("conf", F.lit(0.0)).alias("avg_confidence"))


def by_class(cases: DataFrame, classes: DataFrame) -> DataFrame:
    """Failures of every class, mean rank of the first hit (null if there
    was none), mean AP.  ``classes``: the dimension, column true_label."""
    got = cases.groupBy("true_label").agg(F.count(F.lit(1)).alias("n"), F.avg("first_hit_rank").alias("avg_first_hit_rank"), F.avg("average_precision").alias("ap"))
    return classes.join(got, "true_label", "left").select("true_label", F.coalesce("n", F.lit(0)).alias("n_failures"), "avg_first_hit_rank", F.coalesce("ap", F.lit(0.0)).alias("mean_ap"))


def confusion(cases: DataFrame) -> DataFrame:
    """Failures by true and predicted class, as rows."""
    return cases.groupBy("true_label", "predicted_label").agg(F.count(F.lit(1)).alias("n"))


def confusion_top(cases: DataFrame) -> DataFrame:
    """The class that each class is most often taken for; ties by name."""
    c = confusion(cases)
    r = F.row_number().over(Window.partitionBy("true_label").orderBy(F.col("n").desc(), "predicted_label"))
    return c.withColumn("r", r).filter("r = 1").drop("r")


def confusion_matrix(cases: DataFrame, classes: list) -> DataFrame:
    """As a pivot with a column for every class of a given list."""
    return cases.groupBy("true_label").pivot("predicted_label", classes).agg(F.count(F.lit(1))).na.fill(0)
