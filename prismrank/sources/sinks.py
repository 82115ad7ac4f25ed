"""Writers (K1 to K6)."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


def union_rows(tables: list[DataFrame]) -> DataFrame:
    """K1: rows of all, columns in the order in which they first occur."""
    if not tables:
        raise ValueError("no tables")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def write_csv(rows: DataFrame, path: str, files: int | None = None) -> None:
    """K1: CSV with a header; a table without rows is an error."""
    if not rows.limit(1).count():
        raise ValueError(f"no rows for {path}")
    (rows.coalesce(files) if files else rows).write.mode("overwrite").option("header", True).csv(path)


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> bool:
    """One small file by the session's file systems; False if it is there and
    must stay."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    if not overwrite and fs.exists(target):
        return False
    out = fs.create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def write_manifest(spark: SparkSession, path: str, payload: dict) -> None:
    """K2."""
    write_text(spark, path, json.dumps(payload, indent=2, sort_keys=True, default=str) + "\n")


def write_bundle(spark: SparkSession, folder: str, tables: dict[str, DataFrame], manifest: dict) -> None:
    """K4: a CSV per table, then the manifest that names them."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
    write_manifest(spark, f"{folder}/manifest.json", manifest | {"tables": sorted(tables)})


def write_templates(spark: SparkSession, folder: str, methods: list[str], columns: list[str], folds: int) -> list[str]:
    """K5: for every method a CSV to be filled in, a row per fold; files that
    are there stay.  Returns what was written."""
    done = []
    for m in methods:
        lines = [",".join(["method", "fold_id", *columns])] + [",".join([m, str(f), *[""] * len(columns)]) for f in range(folds)]
        if write_text(spark, f"{folder}/{m}.csv", "\n".join(lines) + "\n", overwrite=False):
            done.append(m)
    return done


def markdown(rows: DataFrame, digits: int = 2, most: int = 1000) -> str:
    """K6: a report table (a few rows) as Markdown."""
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in rows.limit(most).collect()]) + "\n"


def contribution_text(per_band: DataFrame, title: str = "Band contribution") -> str:
    """K6: mean and spread of every band (rows: band, mean, std), largest first."""
    lines = [f"{r.band:<6} {r['mean']:.4f} +/- {r['std']:.4f}" for r in per_band.orderBy("mean", "band").collect()[::-1]]
    return "\n".join([title, "=" * len(title), *lines]) + "\n"


def class_text(per_class: DataFrame) -> str:
    """K6: a block per class (rows as ``attribution.preferences`` gives them)."""
    blocks = [f"{r[0]}\n  top: {r.top_bands}\n  bottom: {r.bottom_bands}\n  dominant region: {r.dominant_region}" for r in per_class.orderBy(per_class.columns[0]).collect()]
    return "\n".join(blocks) + "\n"


def failure_text(by_cause: DataFrame, failures: int, queries: int) -> str:
    """K6: the share of failures and its causes (rows as ``failure.by_cause``
    gives them)."""
    share = 100 * failures / queries if queries else 0.0
    lines = [f"{r.cause:<20} {r['count']:>6} {r.percentage:6.2f} %" for r in by_cause.orderBy("cause").collect()]
    return "\n".join([f"Failures: {failures} of {queries} queries ({share:.1f} %)", *lines]) + "\n"
