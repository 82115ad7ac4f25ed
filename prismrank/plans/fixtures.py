"""The driver tables as inputs of the registered queries.

``embeddings`` gives samples: 64 components as 8 bands of 8.  Roles follow from
the id (query 0, gallery 1 to 2, train 3 to 4 of each five), so that any engine
can repeat them; the conditioning vector of a sample is the centroid of its
label's training bands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismrank.functions import vectors as V
from prismrank.operators import graph
from prismrank.sources.tables import table

BANDS, WIDTH = 8, 8


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """sample_id, label, vec (doubles)."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), "label", V.doubles("embedding").alias("vec"))


def query_side(spark: SparkSession, d: str, many: bool = False) -> DataFrame:
    label = F.array(F.col("label"), F.pmod(F.col("label") * 3, F.lit(10))).alias("query_labels") if many else F.col("label").alias("query_label")
    return vectors(spark, d).filter("sample_id % 5 = 0").select(F.col("sample_id").alias("query_id"), label, F.col("vec").alias("query_vec"))


def gallery_side(spark: SparkSession, d: str, many: bool = False) -> DataFrame:
    label = F.array(F.col("label"), F.pmod(F.col("label") * 3, F.lit(10))).alias("gallery_labels") if many else F.col("label").alias("gallery_label")
    return vectors(spark, d).filter("sample_id % 5 <> 0").select(F.col("sample_id").alias("gallery_id"), label, F.col("vec").alias("gallery_vec"))


def roles(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("sample_id") % 5
    return vectors(spark, d).select("sample_id", "label", F.when(m == 0, "query").when(m <= 2, "gallery").otherwise("train").alias("role"))


def samples(spark: SparkSession, d: str) -> DataFrame:
    """sample_id, label, bands."""
    return vectors(spark, d).select("sample_id", "label", graph.split_bands("vec", BANDS, WIDTH).alias("bands"))


def conditioned(spark: SparkSession, d: str) -> DataFrame:
    """samples with ``query``: the label's training centroid over bands."""
    v = vectors(spark, d).filter("sample_id % 5 >= 3").select("label", F.posexplode("vec").alias("p", "x"))
    dims = v.groupBy("label", (F.col("p") % WIDTH).alias("d")).agg(F.avg("x").alias("x"))
    centroid = dims.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda p: p["x"]).alias("query"))
    return samples(spark, d).join(centroid, "label")


# ---- the same in SQL -----------------------------------------------------

SQL_V = "v AS (SELECT vec_id AS sample_id, label, embedding::DOUBLE[] AS e FROM embeddings)"
SQL_PAIRS = (
    SQL_V
    + """, p AS MATERIALIZED (SELECT q.sample_id AS query_id, q.label AS query_label, g.sample_id AS gallery_id, g.label AS gallery_label,
       list_dot_product(q.e, g.e) AS sim, (q.label = g.label)::INT AS rel FROM v q JOIN v g ON q.sample_id % 5 = 0 AND g.sample_id % 5 <> 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, gallery_id) AS rank FROM p),
 a AS (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY rank) AS seen FROM r),
 q AS (SELECT query_id, any_value(query_label) AS query_label, sum(rel) AS num_relevant,
       CASE WHEN sum(rel) > 0 THEN sum(CASE WHEN rel = 1 THEN seen / rank ELSE 0 END) / sum(rel) ELSE 0 END AS ap,
       min(rank) FILTER (WHERE rel = 1) AS first_hit_rank, max(CASE WHEN rank <= 1 THEN rel ELSE 0 END) AS hit_at_1,
       max(CASE WHEN rank <= 5 THEN rel ELSE 0 END) AS hit_at_5, max(CASE WHEN rank <= 10 THEN rel ELSE 0 END) AS hit_at_10,
       max(gallery_id) FILTER (WHERE rank = 1) AS top1_gallery_id, max(gallery_label) FILTER (WHERE rank = 1) AS top1_label, max(sim) AS top1_score
       FROM a GROUP BY query_id)"""
)
#: band rows b (sample_id, label, i, x), conditioning c (label, q), and cosine
#: weights w (sample_id, i, w) of sigma 0.5.
SQL_BANDS = (
    SQL_V
    + """, b AS (SELECT sample_id, label, i, e[1 + 8 * i : 8 + 8 * i] AS x FROM v, (SELECT unnest(range(8))::INT AS i)),
 cd AS (SELECT label, d, avg(x[d + 1]) AS m FROM b, (SELECT unnest(range(8))::INT AS d) WHERE sample_id % 5 >= 3 GROUP BY label, d),
 c AS (SELECT label, list(m ORDER BY d) AS q FROM cd GROUP BY label),
 s AS (SELECT sample_id, i, x, list_cosine_similarity(x, q) / 0.5 AS s FROM b JOIN c USING (label)),
 w AS (SELECT sample_id, i, x, exp(s - max(s) OVER (PARTITION BY sample_id)) / sum(exp(s - m)) OVER (PARTITION BY sample_id) AS w
       FROM (SELECT *, max(s) OVER (PARTITION BY sample_id) AS m FROM s))"""
)
#: normalized affinity edges n (sample_id, i, j, a).
SQL_GRAPH = (
    SQL_BANDS
    + """, raw AS (SELECT y.sample_id, y.i, z.i AS j, greatest(list_cosine_similarity(y.x, z.x), 0) * y.w * z.w AS a FROM w y JOIN w z USING (sample_id)),
 dg AS (SELECT sample_id, i, sum(a) + 1e-8 AS d FROM raw GROUP BY sample_id, i),
 n AS (SELECT raw.sample_id, raw.i, raw.j, raw.a / sqrt(x.d * y.d) AS a FROM raw JOIN dg x ON raw.sample_id = x.sample_id AND raw.i = x.i JOIN dg y ON raw.sample_id = y.sample_id AND raw.j = y.i)"""
)
#: nearest other bands k (sample_id, i, j, d, r), three of each.
SQL_KNN = (
    SQL_BANDS
    + """, k AS (SELECT * FROM (SELECT y.sample_id, y.i, z.i AS j, z.x, list_distance(y.x, z.x) AS d,
       row_number() OVER (PARTITION BY y.sample_id, y.i ORDER BY list_distance(y.x, z.x), z.i) AS r FROM b y JOIN b z ON y.sample_id = z.sample_id AND y.i <> z.i) WHERE r <= 3),
 f AS (SELECT sample_id, list(v ORDER BY d) AS f FROM (SELECT sample_id, d, sum(w * x[d + 1]) AS v FROM w, (SELECT unnest(range(8))::INT AS d) GROUP BY sample_id, d) GROUP BY sample_id)"""
)
