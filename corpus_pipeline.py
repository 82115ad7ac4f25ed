"""A corpus pipeline of five stages, each by one of the training-data operators.

Every stage takes the documents that the one before kept, all of them; all but
the last return the columns of ``documents``.  The result of a stage is
written to the shared folder and read again, so a lost executor repeats one
stage at most.

Stages run one after the other in one session, on executors whose memory holds
their heap and their Python workers, so they set the bytes of an Arrow batch to
``BATCH_BYTES`` in the session: texts are long, and 10,000 of them are not.

Defined results: null ids, null sources, repeated rows and columns of any name are
handled by the stages as their docstrings say; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismrank.llm import exactdedup, langid, mixing, nearstage, packing
from prismrank.llm._shared import materialize

BATCH_BYTES = "8m"


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; null texts and texts without a letter have
    none.  The model is fitted on labelled rows that the evaluation does not hold
    out."""
    _small_batches(spark)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    return langid.keep_identified(docs, langid.fit(docs.filter(~held)))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text (A-Z folded, null: empty), that with the largest
    id (null ids rank lowest); of fully repeated rows one."""
    _small_batches(spark)
    return exactdedup.keep_unique(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, a
    similarity of 0.8 or more), that with the smallest id (null ids rank above
    all others); texts without words are one group."""
    _small_batches(spark)
    return nearstage.keep_representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them; a null source is
    one of its own, a null text has no words."""
    _small_batches(spark)
    return mixing.repeat_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 ids; a null text is the end id
    alone."""
    _small_batches(spark)
    return packing.documents_digest(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("pack", pack)]

#: Language models, SimHash and tokens cannot be stated in SQL; tests compare
#: the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
