"""Attribution of retrieval to bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismrank.functions import vectors as V
from prismrank.operators import graph, kernel


def attribute(samples: DataFrame, sigma: float = 0.5, sample: str = "sample_id") -> DataFrame:
    """Query weights times spectral weights, min-max to [0, 1].
    ``samples``: sample, bands, query and further columns, which stay."""
    graphs = samples.withColumn("affinity", graph.affinity("bands", "query", sigma))
    weights = kernel.spectra(graphs, sample).select(sample, F.col("weights").alias("fiedler"))
    out = samples.join(weights, sample).withColumn("alignment", graph.query_weights("bands", "query", sigma))
    raw = F.zip_with("alignment", "fiedler", lambda a, b: a * b)
    return out.withColumn("raw", raw).withColumn("attribution", V.min_max("raw"))


def class_attribution(rows: DataFrame, label: str = "label", value: str = "attribution") -> DataFrame:
    """Mean and population spread per class and band, and rows."""
    each = rows.select(label, F.posexplode(value).alias("band_pos", "x"))
    return each.groupBy(label, "band_pos").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.count(F.lit(1)).alias("n"))


def group_shares(per_band: DataFrame, bands: DataFrame, label: str = "label") -> DataFrame:
    """Sums over spectral groups, to a total of 1 per class.  ``bands``:
    band_pos, spectral_group."""
    sums = per_band.join(F.broadcast(bands), "band_pos").groupBy(label, "spectral_group").agg(F.sum("mean").alias("s"))
    whole = F.sum("s").over(Window.partitionBy(label))
    return sums.select(label, "spectral_group", (F.col("s") / F.greatest(whole, F.lit(1e-8))).alias("share"))


def preferences(per_band: DataFrame, bands: DataFrame, k: int = 3, label: str = "label", explanations: DataFrame | None = None) -> DataFrame:
    """Per class its k bands with the largest and with the smallest mean
    (ties by position) and their scores, the group with the largest sum, the
    number of samples, and an explanation: that of ``explanations`` (label,
    explanation), or a sentence that names the top bands."""
    named = per_band.join(F.broadcast(bands), "band_pos")
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("mean")).alias("m"), "band_pos", "band")))
    names = lambda a: F.array_join(F.transform(a, lambda x: x["band"]), ", ")
    scores = lambda a: F.transform(a, lambda x: -x["m"])
    rows = named.groupBy(label).agg(ordered.alias("o"), F.max("n").alias("n_samples"))
    sums = named.groupBy(label, "spectral_group").agg(F.sum("mean").alias("s"), F.min("band_pos").alias("p"))
    best = sums.groupBy(label).agg(F.max_by("spectral_group", F.struct("s", -F.col("p"))).alias("dominant_region"))
    top, bottom = F.slice("o", 1, k), F.slice("o", F.greatest(F.size("o") - k + 1, F.lit(1)), F.lit(k))
    out = rows.join(best, label).select(label, names(top).alias("top_bands"), names(bottom).alias("bottom_bands"), "dominant_region", scores(top).alias("top_scores"), scores(bottom).alias("bottom_scores"), "n_samples")
    given = F.lit(None).cast("string")
    if explanations is not None:
        out = out.join(explanations.select(F.col("label").alias(label), F.col("explanation").alias("__given")), label, "left")
        given = F.col("__given")
    plain = F.concat(F.lit("No explanation is given for "), F.col(label).cast("string"), F.lit(". Top bands: "), F.col("top_bands"), F.lit("."))
    return out.withColumn("explanation", F.coalesce(given, plain)).drop("__given")


def domain_shift(a: DataFrame, b: DataFrame, pairs: DataFrame, k: int = 3) -> DataFrame:
    """Per pair of classes of two sensors: cosine, distance and 1 - cosine
    of their attributions over the bands that both have, by name, and the k
    bands that differ most.  ``a``, ``b``: label, band, mean; ``pairs``:
    label_a, label_b (a small table)."""
    both = F.broadcast(pairs).join(a.select(F.col("label").alias("label_a"), "band", F.col("mean").alias("x")), "label_a").join(b.select(F.col("label").alias("label_b"), "band", F.col("mean").alias("y")), ["label_b", "band"])
    most = F.array_sort(F.collect_list(F.struct((-F.abs(F.col("x") - F.col("y"))).alias("d"), "band")))
    s = both.groupBy("label_a", "label_b").agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.sqrt(F.sum((F.col("x") - F.col("y")) * (F.col("x") - F.col("y")))).alias("l2_distance"), most.alias("m"))
    cos = F.col("xy") / F.greatest(F.sqrt("xx") * F.sqrt("yy"), F.lit(1e-12))
    return s.select("label_a", "label_b", cos.alias("cosine_similarity"), "l2_distance", (1 - cos).alias("shift_magnitude"), F.array_join(F.transform(F.slice("m", 1, k), lambda x: x["band"]), ", ").alias("top_shifted_bands"))


def without_band(samples: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Every sample once per dropped band, with that band missing."""
    each = samples.select("*", F.explode(F.sequence(F.lit(0), F.size("bands") - 1)).alias("dropped"))
    keep = F.filter("bands", lambda x, i: i != F.col("dropped"))
    return each.withColumn("bands", keep)
