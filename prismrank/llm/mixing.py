"""Operator 5 (native): mixing sources to target weights by capped water-filling.

Every source has a weight and a capacity, ``max_epochs`` times its size.  The
water level is the number L at which the sum of min(capacity, L * weight) is
the size of the mix: sources whose share would exceed their capacity are
clamped, and what they leave goes to the others in proportion to their weights
until nobody is above.  With sources in order of capacity per weight the level
is one division per source over prefix sums, so the rounds of redistribution
are one window over the table of sources (one row per source).

A document is taken floor(target / source size) times; of what is left to the
target, documents take one further repetition in the order of a seeded hash
until it is used up, the last one in part.  The order is not sorted as a whole:
sizes are summed per source and leading hash bits, so only the one bucket in
which a source's remainder ends has its documents ranked.  Hot sources are
therefore never gathered in a task.

Defined results: a null text has size 0 and is taken 0 words; a null source is
a source of its own, ordered last; null ids are hashed as one id; repeated rows
are documents of their own with equal hash; if all sizes are 0 all targets are
0; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismrank.llm._shared import WORD, materialize, renamed

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 17
#: Leading bits of the 60-bit hash that name a bucket.
BUCKET_BITS = 12
#: Sources (a row of a few numbers each) up to which their table is broadcast.
BROADCAST_SOURCES = 100_000


def measured(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs with ``size`` (words) and ``h`` (a seeded 60-bit hash of doc_id)."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return docs.withColumns({"size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"), "h": F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")})


def water_fill(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sources``: source, source_size.  Adds weight and target."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    s = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    clamped = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(everything) - clamped).cast("double") / open_weight)
    # all sources before the first that its level does not fill are clamped;
    # that level holds for it and for all that follow
    s = s.withColumn("fits", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")))
    s = s.withColumn("level", F.first("fits", ignorenulls=True).over(everything))
    return s.select("source", "source_size", "weight", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def plan(docs: DataFrame, sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """``sizes``: source, size, h of all documents (a small written table).
    ``docs``: the same documents with any further columns.  Adds source_size,
    target, ``epochs`` (whole repetitions), ``extra`` (words of one further
    repetition, 0 to size) and ``before`` (words of the remainder that smaller
    hashes have taken, where this document takes none or a part; else null)."""
    bucket = F.shiftright("h", 60 - bucket_bits)
    per = sizes.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    targets = water_fill(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    targets = targets.withColumn("left_over", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    up_to = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
    per = per.withColumn("up_to", up_to).withColumnRenamed("source", "__of")
    # per source the bucket in which the remainder ends: the first that passes it
    ends = per.join(targets, F.col("__of").eqNullSafe(F.col("source"))).filter("up_to > left_over")
    ends = ends.groupBy(F.col("source")).agg(F.min(F.struct("bucket", (F.col("up_to") - F.col("words")).alias("filled"))).alias("end"))
    ends = ends.select(F.col("source").alias("__of"), F.col("end.bucket").alias("__end"), F.col("end.filled").alias("__filled"))
    known = targets.join(ends, F.col("source").eqNullSafe(F.col("__of")), "left").select(F.col("source").alias("__of"), "source_size", "target", "epochs", F.col("left_over").alias("__left"), "__end", "__filled")
    # a table of sources is broadcast where it is small by count; a join by
    # source would send a hot source's documents to one task
    if sizes.select("source").distinct().count() <= BROADCAST_SOURCES:
        known = F.broadcast(known)
    rows = docs.join(known, F.col("source").eqNullSafe(F.col("__of"))).withColumn("__bucket", bucket).drop("__of")
    inside = F.col("__end").isNotNull() & (F.col("__bucket") == F.col("__end"))
    clear = rows.filter(~inside).withColumn("extra", F.when(F.col("__end").isNull() | (F.col("__bucket") < F.col("__end")), F.col("size")).otherwise(0)).withColumn("before", F.lit(None).cast("long"))
    order = Window.partitionBy("source").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.filter(inside).withColumn("before", F.col("__filled") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    ranked = ranked.withColumn("extra", F.greatest(F.lit(0), F.least("size", F.col("__left") - F.col("before"))))
    return clear.select(*ranked.columns[:-2], "before", "extra").union(ranked.select(*ranked.columns[:-2], "before", "extra")).drop("__left", "__end", "__filled", "__bucket")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, epochs, extra and
    ``taken`` (all words of it that the mix takes)."""
    sizes = materialize(measured(docs.select("doc_id", "source", "text"), seed).drop("text"), "sizes")
    found = plan(sizes, sizes, weights, max_epochs)
    return found.withColumn("taken", F.col("epochs") * F.col("size") + F.col("extra")).drop("h", "before")


def repeat_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """``docs``, with all its columns, each row as often as the mix takes it;
    the document in which a source's remainder ends is taken once more if at
    least half of it is due.  Texts are not shuffled, but for those of the one
    bucket of each source.  Null and empty texts have size 0 and stay as often as
    their source is repeated as a whole; null sources, null ids and repeated rows
    are as in ``mix``; an empty table gives an empty table."""
    inner, own = renamed(docs, "doc_id", "source", "text")
    sizes = materialize(measured(inner.select("doc_id", "source", "text"), seed).drop("text"), "sizes")
    found = plan(measured(inner, seed), sizes, weights, max_epochs)
    times = (F.col("epochs") + F.when((F.col("extra") > 0) & (2 * F.col("extra") >= F.col("size")), 1).otherwise(0)).cast("int")
    out = found.select(*own, times.alias("times")).filter("times > 0").select(*own, F.explode(F.sequence(F.lit(1), "times")).alias("turn"))
    return out.select(*own).toDF(*docs.columns)


def documents_digest(docs: DataFrame) -> DataFrame:
    """The columns that ``op5_source_mixing`` returns."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3 * source_size AS cap, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
t AS (
  SELECT source, source_size, least(cap::DOUBLE, (SELECT level FROM l WHERE level * weight <= cap ORDER BY cap / weight, source NULLS LAST LIMIT 1) * weight) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
r AS (
  SELECT d.*, e.source_size, e.target, e.epochs, floor(e.target - e.epochs * e.source_size)::BIGINT AS left_over,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, left_over - before)))::BIGINT AS taken FROM r
"""
