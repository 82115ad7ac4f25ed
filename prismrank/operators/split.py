"""Splits, folds, caps and samples.

Order inside a class is that of md5(seed:id), so a split depends on the seed
and the ids alone, not on partitions, and can be repeated in any SQL engine.
A rank is the number of rows in the buckets before (of hashes, or of ranges of
ids) and the place in one's own, so no task holds a class or a split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismrank.session import kept

#: Hexadecimal digits of a hash that name its bucket.
DIGITS = 4
#: Rows up to which a sample is ranked in one task.
FEW = 100_000


def hashed(sample: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(sample).cast("string")))


def shuffled(sample: str, label: str | None, seed: int) -> Window:
    by = Window.partitionBy(*([label] if label else []))
    return by.orderBy(hashed(sample, seed), sample)


def _ranked(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``rows`` (with ``__b``, a bucket in the order of ``order``) and ``__r``, the
    rank in the group from 1, and ``__n``, its size."""
    counts = rows.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__c"))
    group = Window.partitionBy(*by)  # a row per bucket, however many there are in it
    before = F.coalesce(F.sum("__c").over(group.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = counts.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col("__b").alias("__kb"), before.alias("__before"), F.sum("__c").over(group).alias("__n"))
    same = F.col("__b") == F.col("__kb")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    own = F.row_number().over(Window.partitionBy(*by, "__b").orderBy(*order))
    return rows.join(ends, same).withColumn("__r", own + F.col("__before")).drop("__b", "__kb", "__before", *[f"__k{i}" for i in range(len(by))])


def placed(rows: DataFrame, by: list[str], sample: str, seed: int) -> DataFrame:
    """``__r`` and ``__n`` of the order by hash in each group of ``by``."""
    hashes = rows.withColumn("__h", F.coalesce(hashed(sample, seed), F.lit("")))
    bucket = F.coalesce(F.conv(F.substring("__h", 1, DIGITS), 16, 10).cast("int"), F.lit(0))
    return _ranked(hashes.withColumn("__b", bucket), by, ["__h", sample]).drop("__h")


def positioned(rows: DataFrame, by: list[str], sample: str) -> DataFrame:
    """``__r`` and ``__n`` of the order by id in each group of ``by``: ranges of
    ids, which Spark chooses, are the buckets.  ``rows``: narrow."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = kept(rows.repartitionByRange(parts, *by, sample).withColumn("__b", F.spark_partition_id()), "ranges")
    return _ranked(ranges, by, [sample])


def stratified_split(rows: DataFrame, train: float, val: float, test: float, sample: str = "sample_id", label: str = "label", seed: int = 42) -> DataFrame:
    """L1: floor(n * train) and floor(n * val) of each class; the rest is test."""
    if min(train, val, test) < 0 or abs(train + val + test - 1) > 1e-8:
        raise ValueError("the shares must be 0 or more and add up to 1")
    r, n = F.col("__r"), F.col("__n")
    a, b = F.floor(n * train), F.floor(n * val)
    return placed(rows, [label], sample, seed).withColumn("split", F.when(r <= a, "train").when(r <= a + b, "val").otherwise("test")).drop("__r", "__n")


def stratified_folds(rows: DataFrame, k: int, sample: str = "sample_id", label: str = "label", seed: int = 42) -> DataFrame:
    """L2: k buckets of each class; the first n % k get one row more."""
    if k < 3:
        raise ValueError("query, gallery and training need three folds at least")
    r, size, more = F.col("__r") - 1, F.floor(F.col("__n") / k), F.col("__n") % k
    long = more * (size + 1)  # rows of the buckets that have one more
    bucket = F.when(r < long, F.floor(r / (size + 1))).otherwise(more + F.floor((r - long) / F.greatest(size, F.lit(1))))
    return placed(rows, [label], sample, seed).withColumn("bucket", bucket.cast("int")).drop("__r", "__n")


def fold_roles(rows: DataFrame, k: int, bucket: str = "bucket") -> DataFrame:
    """L3: per fold i, bucket i asks, bucket i + 1 is the gallery, the rest
    trains.  Every row occurs k times, once per fold; no join."""
    fold = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold_id")
    out = rows.select("*", fold)
    role = F.when(F.col(bucket) == F.col("fold_id"), "query").when(F.col(bucket) == (F.col("fold_id") + 1) % k, "gallery").otherwise("train")
    return out.withColumn("role", role)


def cap_per_class(rows: DataFrame, most: int | None, sample: str = "sample_id", label: str = "label", seed: int = 42, first: bool = False) -> DataFrame:
    """L4: at most so many rows of each class, by hash or the first by id.
    The limit is pushed below the shuffle."""
    if not most or most < 0:
        return rows
    order = Window.partitionBy(label).orderBy(sample) if first else shuffled(sample, label, seed)
    return rows.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= most).drop("__r")


def subset_sizes(n: int, most: int | None, query: int, gallery: int) -> tuple[int, int, int]:
    """Rows kept, queries and gallery rows of n rows."""
    kept = min(n, most) if most else n
    return kept, min(query, kept // 5), min(gallery, kept // 2)


def subset_split(rows: DataFrame, most: int | None, query: int, gallery: int, sample: str = "sample_id", seed: int = 42) -> DataFrame:
    """A sample of ``most`` rows as query, gallery and train.  Only ids are
    ranked; of a small sample only the smallest hashes leave each task."""
    n = rows.count()
    most, q, g = subset_sizes(n, most, query, gallery)
    if most <= FEW:
        few = rows.select(sample, hashed(sample, seed).alias("__h")).orderBy("__h", sample).limit(most)
        ids = few.withColumn("__r", F.row_number().over(Window.orderBy("__h", sample)))
    else:
        ids = placed(rows.select(sample), [], sample, seed).filter(F.col("__r") <= most)
    ids = ids.select(sample, F.when(F.col("__r") <= q, "query").when(F.col("__r") <= q + g, "gallery").otherwise("train").alias("split"))
    return rows.join(ids, sample)


def sample_rows(rows: DataFrame, n: int, sample: str = "sample_id", seed: int = 42) -> DataFrame:
    """N rows by hash."""
    return rows.orderBy(hashed(sample, seed), sample).limit(n)


def first_rows(rows: DataFrame, n: int, sample: str = "sample_id") -> DataFrame:
    """L8."""
    return rows.orderBy(sample).limit(n)


def split_manifest(rows: DataFrame, split: str = "split", sample: str = "sample_id", label: str = "label") -> DataFrame:
    """Position of each row in its split, by id."""
    ids = positioned(rows.select(F.col(split).alias("split"), F.col(sample).alias("dataset_index"), F.col(label).alias("label")), ["split"], "dataset_index")
    return ids.select("split", (F.col("__r") - 1).cast("int").alias("split_position"), "dataset_index", "label")


def fold_manifest(roles: DataFrame, classes: DataFrame, k: int, label: str = "label") -> DataFrame:
    """Rows of each role by fold and class, zero where there are none.
    ``classes``: the class dimension (column ``label``)."""
    grid = classes.select(F.col(label)).distinct().select(label, F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold_id"))
    count = lambda r: F.count(F.when(F.col("role") == r, 1)).alias(f"{r}_count")
    got = roles.groupBy("fold_id", label).agg(count("train"), count("query"), count("gallery"))
    out = grid.join(got, ["fold_id", label], "left")
    return out.select("fold_id", F.col("fold_id").alias("query_fold_id"), ((F.col("fold_id") + 1) % k).alias("gallery_fold_id"), label, *[F.coalesce(f"{r}_count", F.lit(0)).alias(f"{r}_count") for r in ("train", "query", "gallery")])
