"""Readers of metadata, embedding caches, manifests and external results
(S3 to S5, S7 to S12, S16)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismrank.operators import labels as L

#: What a driver table is called and read by.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(spark: SparkSession, folder: str, names: tuple[str, ...] = TABLES) -> None:
    """Temporary views, for SQL."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)


def patches_from_json(spark: SparkSession, path: str, mapping: dict[str, str], keep: list[str]) -> DataFrame:
    """S3: one JSON file per patch with labels and flags; clear patches with a
    kept label, by patch id (the folder's name)."""
    schema = "labels array<string>, acquisition_date string, seasonal_snow string, contains_seasonal_snow string, cloud_or_shadow string, contains_cloud_or_shadow string"
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    rows = rows.withColumn("patch_id", F.element_at(F.split(F.input_file_name(), "/"), -2))
    clear = L.keep_clear(rows, ["contains_seasonal_snow", "seasonal_snow"], ["contains_cloud_or_shadow", "cloud_or_shadow"])
    return L.keep_labelled(clear.filter(F.size("labels") > 0), "labels", mapping, keep)


def patches_from_files(spark: SparkSession, path: str, needed: tuple[str, ...] = ("B01", "B03", "B04")) -> DataFrame:
    """Patches that have B02 and the other needed bands, without labels."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.tif").load(path).select("path")
    parts = files.select(F.regexp_extract("path", r"([^/]+)_(B[0-9A]{2})\.tif$", 1).alias("patch_id"), F.regexp_extract("path", r"_(B[0-9A]{2})\.tif$", 1).alias("band"))
    have = parts.filter("band <> ''").groupBy("patch_id").agg(F.array_sort(F.collect_set("band")).alias("bands"))
    wanted = F.array(*[F.lit(b) for b in ("B02", *needed)])
    return have.filter(F.size(F.array_except(wanted, "bands")) == 0).withColumn("labels", F.array().cast("array<string>"))


def patches(spark: SparkSession, path: str, mapping: dict[str, str], keep: list[str]) -> DataFrame:
    """Patches by their JSON files if there are any, else by their TIFFs."""
    jsons = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(path)
    if jsons.select("path").limit(1).count():
        return patches_from_json(spark, path, mapping, keep).select("patch_id", "labels")
    return patches_from_files(spark, path).select("patch_id", "labels")


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table of patches without snow and clouds; an unknown flag
    keeps its row, as in F1.  The flags are pushed into the scan."""
    clear = "({0} IS NULL OR {0} = false)"
    return spark.read.parquet(path).filter(f"{clear.format('contains_seasonal_snow')} AND {clear.format('contains_cloud_or_shadow')}")


def subsets(rows: DataFrame, manifest: DataFrame) -> dict[str, DataFrame]:
    """Rows of each split, with their ``split_position``."""
    both = rows.join(manifest.select(F.col("dataset_index").alias("sample_id"), "split", "split_position"), "sample_id")
    return {s: both.filter(F.col("split") == s).drop("split") for s in ("train", "val", "test", "query", "gallery")}


def batches(subset: DataFrame, size: int, drop_last: bool = False) -> DataFrame:
    """Batch, rows: the rows of a subset in batches of ``size``
    consecutive positions, each an array of structs in order; a partial last
    batch stays unless ``drop_last``."""
    each = F.array_sort(F.collect_list(F.struct("split_position", *[c for c in subset.columns if c != "split_position"])))
    out = subset.groupBy(F.floor(F.col("split_position") / size).cast("int").alias("batch")).agg(each.alias("rows"))
    return out.filter(F.size("rows") == size) if drop_last else out


def write_cache(rows: DataFrame, path: str, seed: int, split: str) -> None:
    """An embedding cache, partitioned by seed and split."""
    rows.write.mode("overwrite").parquet(f"{path}/seed={seed}/split={split}")


def read_cache(spark: SparkSession, path: str, seed: int, split: str) -> DataFrame:
    """A cache of just this seed and split; another one, or none, is
    an error.  Only its partition is listed."""
    full = f"{path}/seed={seed}/split={split}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(full)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        raise FileNotFoundError(f"no cache of seed {seed} and split {split!r} in {path}")
    return spark.read.parquet(full)


def read_or_build(spark: SparkSession, path: str, seed: int, split: str, build) -> DataFrame:
    """The cache, made by ``build()`` if it is missing."""
    try:
        return read_cache(spark, path, seed, split)
    except FileNotFoundError:
        write_cache(build(), path, seed, split)
        return read_cache(spark, path, seed, split)


def external_results(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Method name -> CSV; a file without the column ``method`` gets the
    name; columns are the union of all."""
    out = None
    for name, path in paths.items():
        rows = spark.read.option("header", True).option("inferSchema", True).csv(path)
        rows = rows if "method" in rows.columns else rows.withColumn("method", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError("no files")
    return out


def first_row(rows: DataFrame, column: str, value: str, order: str) -> DataFrame:
    """The first row, by ``order``, that has the value."""
    return rows.filter(F.col(column) == value).orderBy(order).limit(1)


def mismatches(cache: DataFrame, manifest: DataFrame) -> DataFrame:
    """Positions at which a cache and a split manifest (split_position,
    dataset_index, label) disagree; empty if they are consistent."""
    a = cache.select("split_position", F.col("dataset_index").alias("cache_index"), F.col("label").alias("cache_label"))
    b = manifest.select("split_position", F.col("dataset_index").alias("manifest_index"), F.col("label").alias("manifest_label"))
    both = a.join(b, "split_position", "full_outer")
    return both.filter(~(F.col("cache_index").eqNullSafe(F.col("manifest_index")) & F.col("cache_label").eqNullSafe(F.col("manifest_label"))))


def present(rows: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Rows whose key has a file."""
    return rows.join(files.select(key), key, "left_semi")


def first_per_class(rows: DataFrame, most: int, label: str = "label", sample: str = "sample_id") -> DataFrame:
    """The first rows of every class, by id."""
    r = F.row_number().over(Window.partitionBy(label).orderBy(sample))
    return rows.withColumn("__r", r).filter(F.col("__r") <= most).drop("__r")
