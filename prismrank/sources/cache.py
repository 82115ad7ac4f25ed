"""Embedding caches that grow.

A cache is a Parquet folder by seed and split with the row's key, the hash of
its content and its vector.  ``extend`` finds by an anti-join which rows it
lacks, by key and content, encodes these alone and appends them; a run that
stops in between leaves no part of a batch, as files appear when the write
commits, and the next run goes on from there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismrank.sources.tables import read_cache

HASH = "content_hash"


def hashed(rows: DataFrame, content: list[str]) -> DataFrame:
    """``rows`` with the hash of their content: a change of any of these
    columns, from or to null as well, makes a row new."""
    return rows.withColumn(HASH, F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256))


def stored(spark: SparkSession, path: str, seed: int, split: str) -> DataFrame | None:
    try:
        return read_cache(spark, path, seed, split)
    except FileNotFoundError:
        return None


def missing(rows: DataFrame, cache: DataFrame | None, key: str, content: list[str]) -> DataFrame:
    """Rows, one per key and content, that the cache does not hold."""
    found = hashed(rows, content).dropDuplicates([key, HASH])
    if cache is None:
        return found
    known = cache.select(F.col(key).alias("__key"), F.col(HASH).alias("__hash")).distinct()
    return found.join(known, F.col(key).eqNullSafe(F.col("__key")) & (F.col(HASH) == F.col("__hash")), "left_anti")


def extend(rows: DataFrame, path: str, seed: int, split: str, encode: Callable[[DataFrame], DataFrame], content: list[str], key: str = "sample_id") -> DataFrame:
    """The cached vectors of ``rows``: what the cache lacks is encoded
    (``encode``: rows with key, content and hash to rows that keep key and hash)
    and appended first.  Vectors of other contents stay in the cache but not in
    the result."""
    spark = rows.sparkSession
    lacking = missing(rows, stored(spark, path, seed, split), key, content)
    encode(lacking).write.mode("append").parquet(f"{path}/seed={seed}/split={split}")
    wanted = hashed(rows, content).select(F.col(key).alias("__key"), F.col(HASH).alias("__hash")).distinct()
    held = read_cache(spark, path, seed, split)
    return held.join(wanted, held[key].eqNullSafe(F.col("__key")) & (held[HASH] == F.col("__hash")), "left_semi")


def prune(spark: SparkSession, path: str, seed: int, split: str, rows: DataFrame, to: str, content: list[str], key: str = "sample_id") -> None:
    """A copy of the cache at ``to`` that holds the contents of ``rows`` alone."""
    wanted = hashed(rows, content).select(key, HASH).distinct()
    read_cache(spark, path, seed, split).join(wanted, [key, HASH], "left_semi").write.mode("overwrite").parquet(f"{to}/seed={seed}/split={split}")
