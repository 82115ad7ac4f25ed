"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words in every contract here: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of
    the session.  Only where that is unset and everything runs on this machine
    (tests) a temporary folder is made and set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        option = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = option.get() if option.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may be gone already
        pass


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, removed when the driver exits."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet to the shared folder and read it again; and its
    path.  This cuts the lineage, survives the loss of executors, and keeps the
    columns prunable for later reads."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as it is read from a written table."""
    return written(df, tag)[0]


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] of them), starts[1], ..."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def release_memory() -> None:
    """Give the free memory of this process back.  Python workers are reused by
    later stages; what they keep would count against every one of these."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def only(df: DataFrame, *cols: str) -> DataFrame:
    """The named columns alone: extra columns, however they are called, cannot
    clash with what an operator adds."""
    return df.select(*[F.col(f"`{c}`") for c in cols])


def renamed(df: DataFrame, *needed: str) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns as own_0, own_1, ... and, beside them, the needed
    ones under their names; and the own names.  So that columns of the caller,
    however they are called, cannot clash with what an operator adds."""
    own = [f"own_{i}" for i in range(len(df.columns))]
    held = df.toDF(*own)
    return held.select(*own, *[F.col(own[df.columns.index(c)]).alias(c) for c in needed]), own


#: Rows of a few numbers up to which a table is sent to every executor.
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a written table with narrow rows), marked for broadcast if its
    count is within the bound; otherwise as it is, to be joined by a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df
