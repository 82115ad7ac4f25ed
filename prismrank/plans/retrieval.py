"""Entry points for retrieval with the whole pipeline.

Each takes tables of samples and gives a fused vector per sample, which
``search`` ranks; one query shared by all samples is a parameter, not a column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismrank.operators import kernel, ranking
from prismrank.sources import images


def retrieve(samples: DataFrame, config: kernel.Config = kernel.Config()) -> DataFrame:
    """``samples``: sample_id, bands and each one's own ``query``.  sample_id,
    fused, weights, initial_weights, losses, steps."""
    return kernel.run(samples, config).drop("config")


def retrieve_batch(samples: DataFrame, query: list[float], config: kernel.Config = kernel.Config()) -> DataFrame:
    """The same with one query for all samples (sample_id, bands)."""
    return retrieve(samples.withColumn("query", F.array(*[F.lit(float(x)) for x in query])), config)


def encode_bands(cubes: DataFrame, make_encoder: Callable[[], Callable], bands: int, width: int, batch: int = 64) -> DataFrame:
    """sample_id, bands: the encoder's unit vector of every band of decoded cubes
    (``images.decode``).  The encoder is given flat images of height * width."""
    n = F.col("height") * F.col("width")
    each = cubes.select("sample_id", n.alias("n"), "cube", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band_pos"))
    each = each.select(F.struct("sample_id", "band_pos").alias("key"), F.slice("cube", F.col("band_pos") * F.col("n") + 1, F.col("n")).alias("image"))
    vec = images.encode(each, make_encoder, "image", width, batch, "key")
    ordered = F.array_sort(F.collect_list(F.struct("key.band_pos", F.col("vec").cast("array<double>").alias("vec"))))
    return vec.groupBy("key.sample_id").agg(F.transform(ordered, lambda x: x["vec"]).alias("bands"))


def retrieve_from_raw(cubes: DataFrame, text: str, make_encoder: Callable[[], Callable], encode_text: Callable[[str], list[float]], bands: int, width: int, config: kernel.Config = kernel.Config()) -> DataFrame:
    """From decoded cubes and a text: both are encoded (the text once, on the
    driver, to unit length), then ``retrieve_batch``."""
    query = [float(x) for x in encode_text(text)]
    norm = max(sum(x * x for x in query) ** 0.5, 1e-12)
    return retrieve_batch(encode_bands(cubes, make_encoder, bands, width), [x / norm for x in query], config)


def search(asked: DataFrame, gallery: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, gallery_id, sim: the k rows of ``gallery`` that are nearest
    by cosine to each of ``asked`` (both: sample_id, fused)."""
    q = asked.select(F.col("sample_id").alias("query_id"), F.col("fused").alias("query_vec"))
    g = gallery.select(F.col("sample_id").alias("gallery_id"), F.col("fused").alias("gallery_vec"))
    return ranking.top_blocks(q, g, k, "cosine")
