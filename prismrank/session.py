"""A session with the settings that the library is tested with, and tables that
are kept for a while."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "prismrank", master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for k, v in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``.  Only
    where it is unset and everything runs on this machine one is made."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and (set_dir := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        found = set_dir.get()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="kept-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _gone(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may be gone already
        pass


def kept(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read again, so that what made it
    runs once and survives lost executors; the files go when the driver exits."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    atexit.register(_gone, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
