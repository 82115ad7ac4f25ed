"""Seeded fixtures of any size.

Every value is a function of the seed and its row's own numbers, by hashes, so
that a table is the same however it is partitioned, on any cluster, and a part
of it can be made without the rest.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and columns of a patch by the resolution of its bands, in metres.
SIZES = {10: 120, 20: 60, 60: 20}


def uniform(seed: int, tag: str, *of: Column | str) -> Column:
    """In (0, 1): the upper 53 bits of a hash, and half a step."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(tag), *of), 11).cast("double") + 0.5) / 2.0**53


def normal(seed: int, tag: str, *of: Column | str) -> Column:
    """Standard normal by the transform of two uniform values."""
    a, b = uniform(seed, f"{tag}-a", *of), uniform(seed, f"{tag}-b", *of)
    return F.sqrt(-2.0 * F.ln(a)) * F.cos(2 * math.pi * b)


def samples(spark: SparkSession, n: int, bands: int = 13, width: int = 64, classes: int = 10, spread: float = 0.5, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """sample_id, label, bands: vectors around one centre per class and band."""
    rows = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    rows = rows.select(F.col("id").alias("sample_id"), F.pmod(F.xxhash64(F.lit(seed), F.lit("label"), "id"), F.lit(classes)).cast("int").alias("label"))

    def value(b: Column, d: Column) -> Column:
        return normal(seed, "centre", "label", b, d) + spread * normal(seed, "noise", "sample_id", b, d)

    cube = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda d: value(b, d)))
    return rows.select("sample_id", "label", cube.alias("bands"))


def roles(rows: DataFrame, query: float = 0.2, gallery: float = 0.4, seed: int = 42) -> DataFrame:
    """sample_id, label, role by shares."""
    u = uniform(seed, "role", "sample_id")
    return rows.select("sample_id", "label", F.when(u < query, "query").when(u < query + gallery, "gallery").otherwise("train").alias("role"))


def patches(spark: SparkSession, n: int, labels: list[list[str]], resolutions: dict[str, int], tiles: tuple[str, ...] = ("T32", "T33"), seed: int = 42, partitions: int | None = None) -> DataFrame:
    """A row per patch and band: patch_id, tile, labels, band, size and a flat
    image: half noise up to 8000, half a slope from 500 to 3000 over its rows."""
    rows = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    pick = lambda values, i: F.get(F.array(*values), F.pmod(i, F.lit(len(values))).cast("int"))
    tile = pick([F.lit(t) for t in tiles], F.col("id"))
    rows = rows.select("id", tile.alias("tile"), pick([F.array(*[F.lit(x) for x in row]) for row in labels], F.col("id")).alias("labels"))
    name = F.concat_ws("_", "tile", F.floor(F.col("id") / 10).cast("string"), F.pmod("id", F.lit(10)).cast("string"))
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.lit(SIZES[m]).alias("size")) for b, m in resolutions.items()]))
    rows = rows.select("id", name.alias("patch_id"), "tile", "labels", each.alias("b")).select("id", "patch_id", "tile", "labels", "b.band", "b.size")
    slope = lambda i: 500.0 + 2500.0 * F.floor(i / F.col("size")) / (F.col("size") - 1)
    image = F.transform(F.sequence(F.lit(0), F.col("size") * F.col("size") - 1), lambda i: 0.5 * F.floor(8000 * uniform(seed, "pixel", "id", "band", i)) + 0.5 * slope(i))
    return rows.select("patch_id", "tile", "labels", "band", "size", image.alias("image"))
