"""Registered queries: labels, pixels, reports, statistics, failures (P, F, G,
T, J, S)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismrank.functions import vectors as V
from prismrank.operators import attribution, failure, graph, labels, pixels, ranking, report, resample, stats
from prismrank.plans import fixtures as X
from prismrank.plans import methods
from prismrank.plans import spectral_sql as Q
from prismrank.plans.registry import query
from prismrank.plans.retrieval_queries import r6
from prismrank.sources import dimensions, tables
from prismrank.sources.tables import table

S = SparkSession

# ---- labels and prompts ----------------------------------------------------

#: A roll-up of part types: the last word by material, as the SQL states it.
MATERIAL = {"STEEL": "METAL", "COPPER": "METAL", "BRASS": "METAL", "NICKEL": "METAL", "TIN": "METAL"}
WORDS = "string_split(p_type, ' ')"
ROLLED = "list_transform(" + WORDS + ", lambda x: CASE WHEN x IN ('STEEL', 'COPPER', 'BRASS', 'NICKEL', 'TIN') THEN 'METAL' ELSE x END)"


@query(f"SELECT p_partkey, list_aggregate({ROLLED}, 'string_agg', ' ') AS rolled, list_contains({ROLLED}, 'METAL') AS kept FROM part")
def p11_label_roll_up(spark: S, d: str) -> DataFrame:
    """The map, then distinct labels in order."""
    out = labels.roll_up(F.split("p_type", " "), MATERIAL)
    return table(spark, d, "part").select("p_partkey", F.array_join(out, " ").alias("rolled"), F.array_contains(labels.roll_up(F.split("p_type", " "), MATERIAL, ["METAL"]), "METAL").alias("kept"))


@query("SELECT doc_id, (quality = 1)::INT AS quality_hot, (toxic = 1)::INT AS toxic_hot FROM labels")
def p12_multi_hot(spark: S, d: str) -> DataFrame:
    """P12."""
    tags = F.array_compact(F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic")))
    hot = labels.multi_hot(tags, ["quality", "toxic"])
    return table(spark, d, "labels").select("doc_id", F.get(hot, F.lit(0)).alias("quality_hot"), F.get(hot, F.lit(1)).alias("toxic_hot"))


@query("SELECT n_nationkey, 'a satellite image of ' || CASE n_name WHEN 'FRANCE' THEN 'la France' ELSE n_name END AS prompt, 'a satellite image of ' || n_name || ' and ' || r_name AS both_ FROM nation JOIN region ON n_regionkey = r_regionkey")
def p10_prompts(spark: S, d: str) -> DataFrame:
    """P10."""
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("n_nationkey", labels.prompt("n_name", {"FRANCE": "la France"}).alias("prompt"), labels.joined_prompt(F.array("n_name", "r_name"), {}).alias("both_"))


@query("SELECT event_id, regexp_replace('T' || user_id || '_' || event_type || '_' || event_id, '_[^_]+_[^_]+$', '') AS tile FROM events")
def p26_tile_id(spark: S, d: str) -> DataFrame:
    """P26."""
    patch = F.concat(F.lit("T"), F.col("user_id"), F.lit("_"), F.col("event_type"), F.lit("_"), F.col("event_id"))
    return table(spark, d, "events").select("event_id", labels.tile_of(patch).alias("tile"))


@query("SELECT c AS class_name, count(event_type) AS n FROM (SELECT DISTINCT event_type AS c FROM events UNION SELECT 'never') LEFT JOIN events ON event_type = c GROUP BY c")
def g1_class_counts(spark: S, d: str) -> DataFrame:
    """G1, with a class that does not occur."""
    e = table(spark, d, "events")
    classes = e.select(F.col("event_type").alias("class_name")).distinct().union(spark.createDataFrame([("never",)], "class_name string"))
    return labels.class_counts(e, classes, "event_type")


@query("SELECT w AS class_name, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS w FROM part) GROUP BY w ORDER BY n DESC, w LIMIT 5")
def g2_most_common_labels(spark: S, d: str) -> DataFrame:
    """G2."""
    return labels.most_common(table(spark, d, "part").select(F.split("p_type", " ").alias("ls")), "ls", 5)


@query("SELECT event_id FROM events WHERE NOT coalesce(value > 50, false)")
def f1_clear_rows(spark: S, d: str) -> DataFrame:
    """the flag is value - 50; a missing or unparsable one keeps the row."""
    rows = table(spark, d, "events").withColumns({"flag": (F.col("value") - 50).cast("string"), "other": F.lit("n/a")})
    return labels.keep_clear(rows, ["flag", "other"]).select("event_id")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def j9_rows_with_files(spark: S, d: str) -> DataFrame:
    """A semi join."""
    files = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return tables.present(table(spark, d, "orders"), files, "o_custkey").select("o_orderkey")


# ---- pixels --------------------------------------------------------------------

PIX = "px AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 1e5 AS nir, l_quantity / 50 AS red, l_discount AS green FROM lineitem)"


def _pixels(spark: S, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 1e5).alias("nir"), (F.col("l_quantity") / 50).alias("red"), F.col("l_discount").alias("green"))


@query(
    """SELECT l_orderkey, l_linenumber, round((least(greatest((nir - red) / (nir + red + 1e-6), -1), 1) + 1) / 2, 6) AS ndvi, round((least(greatest((green - nir) / (green + nir + 1e-6), -1), 1) + 1) / 2, 6) AS ndwi,
 round((least(greatest(1.5 * (nir - red) / (nir + red + 0.5 + 1e-6), -1), 1) + 1) / 2, 6) AS savi FROM px""",
    PIX,
)
def p1_spectral_indices(spark: S, d: str) -> DataFrame:
    """P1."""
    x = pixels.indices(F.col("nir"), F.col("red"), F.col("green"))
    return r6(_pixels(spark, d).select("l_orderkey", "l_linenumber", *[v.alias(k) for k, v in x.items()]))


@query("SELECT l_orderkey, l_linenumber, round(least(greatest(l_extendedprice / CASE WHEN max(l_extendedprice) OVER (PARTITION BY l_orderkey) > 1 THEN 10000 ELSE 1 END, 0), 1), 6) AS price FROM lineitem")
def p5_scale_reflectance(spark: S, d: str) -> DataFrame:
    """P5, by image."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"))
    return r6(pixels.scale_reflectance(rows, ["price"], ["l_orderkey"]).select("l_orderkey", "l_linenumber", "price"))


@query(
    """, q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.02) AS a, quantile_cont(l_extendedprice, 0.98) AS b FROM lineitem GROUP BY 1)
 SELECT l_orderkey, l_linenumber, round(least(greatest((l_extendedprice - a) / (b - a + 1e-8), 0), 1), 6) AS stretched FROM lineitem JOIN q USING (l_returnflag)""",
    "one AS (SELECT 1)",
)
def p7_percentile_stretch(spark: S, d: str) -> DataFrame:
    """P7, by band."""
    return r6(pixels.stretch(table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"]).select("l_orderkey", "l_linenumber", "stretched"))


@query("SELECT count(*) AS n, round(sum(nir), 3) AS s_nir, round(sum(red), 3) AS s_red, round(sum(nir * red), 3) AS nir_red, round(sum(nir * nir), 3) AS nir_nir, round(sum(green * green), 3) AS green_green FROM px", PIX)
def p3_pca_moments(spark: S, d: str) -> DataFrame:
    """The sums that a fit reads, in one aggregation."""
    n, s, p = pixels.moments(_pixels(spark, d), ["nir", "red", "green"])
    row = (n, *[round(float(x), 3) for x in (s[0], s[1], p[0, 1], p[0, 0], p[2, 2])])
    return spark.createDataFrame([row], "n long, s_nir double, s_red double, nir_red double, nir_nir double, green_green double")


PIXEL_PCA = PIX + """, pu AS (SELECT avg(nir) AS a, avg(red) AS b, avg(green) AS c FROM px), pc AS (SELECT l_orderkey, l_linenumber, [nir - a, red - b, green - c] AS x FROM px, pu),
 cv AS MATERIALIZED (SELECT 0 AS sigma, 0 AS sample_id, i, j, avg(x[i + 1] * x[j + 1]) AS a FROM pc, (SELECT unnest(range(3))::INT AS i), (SELECT unnest(range(3))::INT AS j) GROUP BY i, j), """ + Q.axes("cv", 3) + """,
 ew AS (SELECT list(w ORDER BY k) AS w FROM (SELECT k, list(w ORDER BY i) AS w FROM ev GROUP BY k)), pp AS MATERIALIZED (SELECT l_orderkey, l_linenumber, list_dot_product(x, w[1]) AS p1, list_dot_product(x, w[2]) AS p2, list_dot_product(x, w[3]) AS p3 FROM pc, ew)
 SELECT l_orderkey, l_linenumber, round(least(greatest((p1 - min(p1) OVER ()) / (max(p1) OVER () - min(p1) OVER () + 1e-6), 0), 1), 6) AS pc1, round(least(greatest((p2 - min(p2) OVER ()) / (max(p2) OVER () - min(p2) OVER () + 1e-6), 0), 1), 6) AS pc2, round(least(greatest((p3 - min(p3) OVER ()) / (max(p3) OVER () - min(p3) OVER () + 1e-6), 0), 1), 6) AS pc3 FROM pp"""


@query("WITH " + PIXEL_PCA)
def p4_pca_projection(spark: S, d: str) -> DataFrame:
    """P3, P4, A11."""
    rows = _pixels(spark, d)
    state = pixels.fit_pca(rows, ["nir", "red", "green"])
    return r6(pixels.apply_pca(rows, state, ["nir", "red", "green"]).select("l_orderkey", "l_linenumber", "pc1", "pc2", "pc3"))


@query(None)
def p2_image_pca(spark: S, d: str) -> DataFrame:
    """P2 (an eigen-decomposition per image: NumPy tests)."""
    rows = _pixels(spark, d).withColumnRenamed("l_linenumber", "pixel_id")
    return r6(pixels.image_pca(rows, "l_orderkey", ["nir", "red", "green"]))


@query(
    """, t AS (SELECT sample_id, p // 8 AS y, p % 8 AS x, e[p + 1] AS val FROM v, (SELECT unnest(range(64))::INT AS p))
 SELECT sample_id, (y // 2)::INT AS oy, (x // 2)::INT AS ox, round(avg(val), 6) AS value FROM t GROUP BY ALL""",
    X.SQL_V,
)
def p21_token_pooling(spark: S, d: str) -> DataFrame:
    """8 x 8 tokens to 4 x 4 (each output lies between two inputs)."""
    t = X.vectors(spark, d).select("sample_id", F.posexplode("vec").alias("p", "value"))
    t = t.select("sample_id", F.floor(F.col("p") / 8).cast("int").alias("y"), (F.col("p") % 8).alias("x"), F.lit(0).alias("d"), "value")
    return r6(pixels.pool_tokens(t, 8, 4).select("sample_id", "oy", "ox", "value"))


def _axis_sql(name: str, size: int, to: int, corners: bool) -> str:
    """Weights (o, i, w) of one axis by the distance of input and output."""
    at = f"o * {size - 1}.0 / {to - 1}" if corners else f"least(greatest((o + 0.5) * {size}.0 / {to} - 0.5, 0), {size - 1})"
    return f"{name} AS (SELECT o, i, 1 - abs({at} - i) AS w FROM (SELECT unnest(range({to}))::INT AS o), (SELECT unnest(range({size}))::INT AS i) WHERE abs({at} - i) < 1)"


GRID = X.SQL_V + ", px AS (SELECT sample_id, p // 8 AS y, p % 8 AS x, e[p + 1] AS val FROM v, (SELECT unnest(range(64))::INT AS p))"


def _images(spark: S, d: str, height: int = 8, width: int = 8) -> DataFrame:
    return X.vectors(spark, d).select("sample_id", F.lit(height).alias("height"), F.lit(width).alias("width"), F.col("vec").alias("cube"))


TOKENS = X.SQL_V + ", tk AS (SELECT sample_id, p // 16 AS y, p // 4 % 4 AS x, p % 4 AS d, e[p + 1] AS val FROM v, (SELECT unnest(range(64))::INT AS p)), " + _axis_sql("ax", 4, 3, False)


@query(", po AS (SELECT sample_id, a.o AS oy, b.o AS ox, d, sum(val * a.w * b.w) AS z FROM tk JOIN ax a ON a.i = y JOIN ax b ON b.i = x GROUP BY ALL) SELECT sample_id, oy, ox, d::INT AS d, round(z / greatest(sqrt(sum(z * z) OVER (PARTITION BY sample_id, oy, ox)), 1e-12), 6) + 0 AS value FROM po", TOKENS)
def p21_pooled_unit_tokens(spark: S, d: str) -> DataFrame:
    """4 x 4 tokens of four components to 3 x 3, each to unit length."""
    t = X.vectors(spark, d).select("sample_id", F.posexplode("vec").alias("p", "value"))
    t = t.select("sample_id", F.floor(F.col("p") / 16).cast("int").alias("y"), F.floor(F.col("p") / 4 % 4).cast("int").alias("x"), (F.col("p") % 4).alias("d"), "value")
    return r6(pixels.pool_tokens(t, 4, 3, True).select("sample_id", "oy", "ox", "d", "value"))


@query("SELECT sample_id, (a.o * 12 + b.o)::INT AS pixel, round(sum(val * a.w * b.w), 6) + 0 AS value FROM px JOIN ax a ON a.i = y JOIN ax b ON b.i = x GROUP BY sample_id, a.o, b.o", GRID + ", " + _axis_sql("ax", 8, 12, True) + " ")
def s6_resampled_patch(spark: S, d: str) -> DataFrame:
    """Images of 8 x 8 to 12 x 12, corners on corners."""
    return r6(resample.resampled(_images(spark, d), 12, corners=True).select("sample_id", F.posexplode("cube").alias("pixel", "value")))


@query(
    f", rs AS (SELECT sample_id, a.o * 14 + b.o AS pixel, sum(least(greatest(val, 0), 1) * a.w * b.w) AS val FROM px JOIN ax a ON a.i = y JOIN ax b ON b.i = x GROUP BY sample_id, a.o, b.o) SELECT sample_id, 0 AS band_pos, (k * 196 + pixel)::INT AS place, round((val - {list(resample.ENCODER_MEAN)}[k + 1]) / {list(resample.ENCODER_STD)}[k + 1], 6) + 0 AS value FROM rs, (SELECT unnest(range(3))::INT AS k)",
    GRID + ", " + _axis_sql("ax", 8, 14, False),
)
def p5_encoder_input(spark: S, d: str) -> DataFrame:
    """One band, clamped, 8 x 8 to 14 x 14, as three standardized channels."""
    return r6(resample.for_encoder(_images(spark, d), 14).select("sample_id", "band_pos", F.posexplode("cube").alias("place", "value")))


@query("SELECT sample_id, (k * 8 + p)::INT AS place, round(e[8 * [3, 2, 1][k + 1] + p + 1], 6) + 0 AS value FROM v, (SELECT unnest(range(3))::INT AS k), (SELECT unnest(range(8))::INT AS p)", X.SQL_V)
def s14_rgb_bands(spark: S, d: str) -> DataFrame:
    """Three bands of cubes of eight bands of 2 x 4."""
    return r6(resample.select_bands(_images(spark, d, 2, 4)).select("sample_id", F.posexplode("cube").alias("place", "value")))


@query(
    """, t AS (SELECT sample_id, i AS d, x[k + 1] AS val FROM (SELECT sample_id, i, e[1 + 8 * i : 8 + 8 * i] AS x FROM v, (SELECT unnest(range(8))::INT AS i)), (SELECT unnest(range(8))::INT AS k)),
 m AS (SELECT sample_id, d, avg(val) + max(val) AS z FROM t GROUP BY ALL) SELECT sample_id, d, round(z / sqrt(sum(z * z) OVER (PARTITION BY sample_id)), 6) AS value FROM m""",
    X.SQL_V,
)
def p21_descriptor(spark: S, d: str) -> DataFrame:
    """Mean and maximum of tokens, to unit length."""
    t = graph.explode_bands(X.samples(spark, d)).select("sample_id", F.col("band_pos").alias("d"), F.explode("x").alias("value"))
    return r6(pixels.descriptor(t))


@query("SELECT l_returnflag, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_discount), 6) AS l_discount FROM lineitem GROUP BY 1")
def g24_mean_signature(spark: S, d: str) -> DataFrame:
    """G24."""
    return r6(pixels.signature(table(spark, d, "lineitem"), ["l_quantity", "l_discount"], ["l_returnflag"]))


@query("SELECT least(floor(l_quantity / 5), 9)::INT AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1")
def g24_histogram(spark: S, d: str) -> DataFrame:
    """G24."""
    return pixels.histogram(table(spark, d, "lineitem"), "l_quantity", 0.0, 50.0, 10)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount < 0.10 THEN 'Low' WHEN l_discount < 0.20 THEN 'Medium' ELSE 'High' END AS level FROM lineitem")
def p23_shift_level(spark: S, d: str) -> DataFrame:
    """P23."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", report.shift_level(F.col("l_discount")).alias("level"))


# ---- reports -----------------------------------------------------------------------
# methods are shipment flags, folds are years' remainders, metrics are measures

FOLD_SQL = "fr AS (SELECT l_returnflag AS method, (l_orderkey % 5)::INT AS fold_id, avg(l_discount) * 100 AS r_at_1, avg(l_tax) * 100 AS map FROM lineitem GROUP BY 1, 2)"


def _folds(spark: S, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("method"), (F.col("l_orderkey") % 5).cast("int").alias("fold_id")).agg((F.avg("l_discount") * 100).alias("r_at_1"), (F.avg("l_tax") * 100).alias("map"))


@query("SELECT method, count(DISTINCT fold_id) AS num_folds, round(avg(r_at_1), 6) AS r_at_1_mean, round(coalesce(stddev_samp(r_at_1), 0), 6) AS r_at_1_std, printf('%.2f±%.2f', avg(r_at_1), coalesce(stddev_samp(r_at_1), 0)) AS r_at_1_mean_std, round(avg(map), 6) AS map_mean, round(coalesce(stddev_samp(map), 0), 6) AS map_std, printf('%.2f±%.2f', avg(map), coalesce(stddev_samp(map), 0)) AS map_mean_std FROM fr GROUP BY method", FOLD_SQL)
def g4_method_comparison(spark: S, d: str) -> DataFrame:
    """G4, P17."""
    return r6(report.comparison(_folds(spark, d), ["r_at_1", "map"]))


TT = FOLD_SQL + ", st AS (UNPIVOT fr ON r_at_1, map INTO NAME metric VALUE v), pr AS (SELECT o.method, o.metric, a.v - o.v AS d FROM st o JOIN st a ON a.method = 'A' AND o.method <> 'A' AND a.fold_id = o.fold_id AND a.metric = o.metric)"


@query("SELECT 'A' AS reference_method, method AS compared_method, metric, count(*) AS n_pairs, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t_stat, CASE WHEN avg(d) > 0 THEN 'better' WHEN avg(d) < 0 THEN 'worse' ELSE 'equal' END AS direction FROM pr GROUP BY method, metric", TT)
def t2_paired_t_table(spark: S, d: str) -> DataFrame:
    """T-1, T-2, J8 (probabilities: tests)."""
    return r6(stats.paired_t_table(_folds(spark, d), "A", ["r_at_1", "map"]).drop("p_value", "significant"))


#: The tail of t as a share of the integral of a power of the cosine.
TAIL = X.SQL_PAIRS + """, tp AS (SELECT 'k' || k AS test, CASE k WHEN 1 THEN hit_at_1 WHEN 5 THEN hit_at_5 ELSE hit_at_10 END - ap AS dd FROM q, (SELECT unnest([1, 5, 10]) AS k)),
 ts AS (SELECT test, count(*) AS n_pairs, avg(dd) AS mean_diff, avg(dd) / (stddev_samp(dd) / sqrt(count(*))) AS t_stat FROM tp GROUP BY test),
 an AS (SELECT *, atan(abs(t_stat) / sqrt(n_pairs - 1)) AS low FROM ts), sx AS (SELECT (unnest(range(20000)) + 0.5) / 20000 AS g),
 ta AS (SELECT test, any_value(n_pairs) AS n_pairs, any_value(mean_diff) AS mean_diff, any_value(t_stat) AS t_stat, sum((pi() / 2 - low) * cos(low + g * (pi() / 2 - low)) ** (n_pairs - 2)) / sum(pi() / 2 * cos(g * pi() / 2) ** (n_pairs - 2)) AS p FROM an, sx GROUP BY test)"""


@query(" SELECT test, n_pairs, round(mean_diff, 6) AS mean_diff, round(t_stat, 6) AS t_stat, round(p, 6) AS p_value, round(least(p * count(*) OVER (), 1), 6) AS p_bonferroni FROM ta", TAIL)
def t3_bonferroni(spark: S, d: str) -> DataFrame:
    """T-3: p-values of per-query pairs, corrected."""
    rows = ranking.evaluate_blocks(X.query_side(spark, d), X.gallery_side(spark, d))
    pairs = rows.select(F.explode(F.array(*[F.struct(F.lit(f"k{a}").alias("test"), F.col(f"hit_at_{a}").alias("x"), F.col("ap").alias("y")) for a in (1, 5, 10)])).alias("s")).select("s.*")
    return r6(stats.bonferroni(stats.paired_t(pairs, "x", "y", ["test"])))


@query("SELECT query_label, b, c, round(CASE WHEN b + c = 0 THEN 0 ELSE (abs(b - c) - 1) ** 2 / (b + c) END, 6) AS chi2 FROM (SELECT query_label, count(*) FILTER (WHERE hit_at_5 = 1 AND odd = 0) AS b, count(*) FILTER (WHERE hit_at_5 = 0 AND odd = 1) AS c FROM (SELECT *, (query_id // 5 % 2)::INT AS odd FROM q) GROUP BY query_label)", X.SQL_PAIRS)
def t5_mcnemar(spark: S, d: str) -> DataFrame:
    """T-5 (probabilities: tests)."""
    rows = ranking.evaluate_blocks(X.query_side(spark, d), X.gallery_side(spark, d)).withColumn("odd", (F.floor(F.col("query_id") / 5) % 2).cast("int"))
    return r6(stats.mcnemar(rows, "hit_at_5", "odd", ["query_label"]).drop("p_value"))


def _paired_orders(spark: S, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_discount").alias("x"), F.col("l_tax").alias("y"))


ORDER_IDS = ["l_orderkey", "l_linenumber"]


@query(None)
def t4_bootstrap(spark: S, d: str) -> DataFrame:
    """T-4 (seeded resampling: tests)."""
    return r6(stats.bootstrap(_paired_orders(spark, d), "x", "y", ["l_returnflag"], ORDER_IDS, rounds=1000))


@query(None)
def t6_permutation(spark: S, d: str) -> DataFrame:
    """T-6 (seeded: tests)."""
    return r6(stats.permutation(_paired_orders(spark, d), "x", "y", ["l_returnflag"], ORDER_IDS, rounds=1000))


@query("SELECT 'all' AS method, query_label, count(DISTINCT query_id % 2) AS num_folds, count(*) AS num_queries, round(avg(ap * 100), 6) AS map_mean, round(coalesce(stddev_samp(ap * 100), 0), 6) AS map_std, round(avg(hit_at_1 * 100), 6) AS r_at_1_mean, round(coalesce(stddev_samp(hit_at_1 * 100), 0), 6) AS r_at_1_std FROM q GROUP BY query_label", X.SQL_PAIRS)
def g5_per_class_table(spark: S, d: str) -> DataFrame:
    """G5."""
    rows = ranking.evaluate_blocks(X.query_side(spark, d), X.gallery_side(spark, d)).withColumns({"method": F.lit("all"), "fold_id": F.col("query_id") % 2})
    return r6(report.per_class_table(rows, (1,)))


STAGE = "sg AS (SELECT row_number() OVER (ORDER BY n_nationkey)::INT AS stage_order, n_name AS component, (n_nationkey * 37 % 11)::DOUBLE AS r_at_1, (n_nationkey * 17 % 7)::DOUBLE AS r_at_10 FROM nation)"


@query("SELECT stage_order, component, r_at_1, r_at_10, r_at_1 - first(r_at_1) OVER o AS delta_r_at_1_vs_first, r_at_1 - coalesce(lag(r_at_1) OVER o, r_at_1) AS incremental_delta_r_at_1, r_at_10 - first(r_at_10) OVER o AS delta_r_at_10_vs_first, r_at_10 - coalesce(lag(r_at_10) OVER o, r_at_10) AS incremental_delta_r_at_10, stage_order > 1 AND r_at_1 - coalesce(lag(r_at_1) OVER o, r_at_1) <= 0 AS redundant FROM sg WINDOW o AS (ORDER BY stage_order)", STAGE)
def g17_stage_deltas(spark: S, d: str) -> DataFrame:
    """G17."""
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    rows = n.select((k + 1).cast("int").alias("stage_order"), F.col("n_name").alias("component"), (k * 37 % 11).cast("double").alias("r_at_1"), (k * 17 % 7).cast("double").alias("r_at_10"))
    return report.deltas(rows, ["r_at_1", "r_at_10"])


@query(
    """WITH c AS (SELECT r_name AS param_name, (n_nationkey // 5)::INT AS pos, n_nationkey::DOUBLE AS param_value, (n_nationkey * 37 % 11)::DOUBLE AS r_at_1, (n_nationkey * 17 % 7)::DOUBLE AS r_at_10 FROM nation JOIN region ON n_regionkey = r_regionkey),
 b AS (SELECT *, row_number() OVER (PARTITION BY param_name ORDER BY r_at_1 DESC, pos) AS k, max(r_at_1) OVER (PARTITION BY param_name) - min(r_at_1) OVER (PARTITION BY param_name) AS sp, string_agg(param_value::VARCHAR, ', ') OVER (PARTITION BY param_name ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS tested FROM c)
 SELECT param_name AS param, tested AS tested_values, param_value AS best_value, round(r_at_1, 2) AS best_r_at_1, round(r_at_10, 2) AS best_r_at_10, round(sp, 2) AS r_at_1_range, CASE WHEN sp < 1.5 THEN 'Yes' ELSE 'No' END AS robust FROM b WHERE k = 1"""
)
def g18_sweep_summary(spark: S, d: str) -> DataFrame:
    """G18."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey")
    rows = n.select(F.col("r_name").alias("param_name"), F.floor(k / 5).cast("int").alias("pos"), k.cast("double").alias("param_value"), (k * 37 % 11).cast("double").alias("r_at_1"), (k * 17 % 7).cast("double").alias("r_at_10"))
    return report.sweep_summary(rows)


@query("SELECT event_type AS component, n, round(m, 6) AS mean, round(md, 6) AS median, round(sd, 6) AS std, round(q, 6) AS p95, round(100 * m / sum(m) OVER (), 6) AS share_pct, row_number() OVER (ORDER BY m DESC, event_type) = 1 AS bottleneck FROM (SELECT event_type, count(*) AS n, avg(value) AS m, median(value) AS md, coalesce(stddev_samp(value), 0) AS sd, quantile_cont(value, 0.95) AS q FROM events GROUP BY 1)")
def g19_timing_statistics(spark: S, d: str) -> DataFrame:
    """G19."""
    return r6(report.timing(table(spark, d, "events").withColumnRenamed("event_type", "component"), "component", "value"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE abs(l_discount + l_tax - 0.1) > 0.05 OR least(l_discount, l_tax) <= 0")
def g20_bad_profiles(spark: S, d: str) -> DataFrame:
    """Rows whose parts do not add up, or are not positive."""
    rows = table(spark, d, "lineitem").withColumn("total", F.lit(0.1))
    return report.bad_profiles(rows, ["l_discount", "l_tax"], "total").select("l_orderkey", "l_linenumber")


@query("SELECT metric, count(*) AS n, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS std FROM (UNPIVOT (SELECT r_at_1, map FROM fr) ON r_at_1, map INTO NAME metric VALUE v) GROUP BY metric", FOLD_SQL)
def g22_seed_summary(spark: S, d: str) -> DataFrame:
    """G22."""
    return r6(report.seed_summary(_folds(spark, d), ["r_at_1", "map"]))


@query("SELECT method, round(r, 6) AS r_at_1, round(r - o, 6) AS r_at_1_minus_ours, round(r / o, 6) AS r_at_1_ratio FROM (SELECT method, avg(r_at_1) AS r FROM fr GROUP BY method), (SELECT avg(r_at_1) AS o FROM fr WHERE method = 'A')", FOLD_SQL)
def j12_against_ours(spark: S, d: str) -> DataFrame:
    """J12, S12."""
    rows = _folds(spark, d).groupBy("method").agg(F.avg("r_at_1").alias("r_at_1"))
    ours = tables.first_row(rows, "method", "A", "method")
    return r6(report.against_ours(rows.filter("method <> 'A'"), ours, ["r_at_1"]))


@query("SELECT q.query_id, q.top1_gallery_id, 'p/' || q.query_id AS query_path, 'c' || q.query_label AS query_label_name, 'p/' || q.top1_gallery_id AS top1_gallery_path, 'c' || top1_label AS top1_label_name FROM q", X.SQL_PAIRS)
def j10_decorated_rows(spark: S, d: str) -> DataFrame:
    """J10."""
    rows = ranking.evaluate_blocks(X.query_side(spark, d), X.gallery_side(spark, d)).select("query_id", "top1_gallery_id")
    s = X.vectors(spark, d).select("sample_id", F.concat(F.lit("p/"), "sample_id").alias("path"), F.concat(F.lit("c"), "label").alias("label_name"))
    return report.decorate(rows, s)


@query("SELECT coalesce(a.p, b.p) AS split_position, a.i AS cache_index, b.i AS manifest_index FROM (SELECT vec_id AS p, vec_id AS i FROM embeddings) a FULL JOIN (SELECT vec_id + 3 AS p, CASE WHEN (vec_id + 3) % 10 = 0 THEN vec_id + 4 ELSE vec_id + 3 END AS i FROM embeddings) b ON a.p = b.p WHERE a.i IS DISTINCT FROM b.i")
def s16_cache_mismatches(spark: S, d: str) -> DataFrame:
    """A cache of all rows against a manifest of all rows that begins at
    position 3 and has another index at every tenth."""
    cache = X.vectors(spark, d).select(F.col("sample_id").alias("split_position"), F.col("sample_id").alias("dataset_index"), F.lit(0).alias("label"))
    i = F.col("dataset_index") + 3
    manifest = cache.withColumns({"split_position": F.col("split_position") + 3, "dataset_index": F.when(i % 10 == 0, i + 1).otherwise(i)})
    return tables.mismatches(cache, manifest).select("split_position", "cache_index", "manifest_index")


# ---- failures ------------------------------------------------------------------------


def _failures(spark: S, d: str) -> DataFrame:
    gallery = X.gallery_side(spark, d)
    return failure.failures(ranking.with_top_label(ranking.evaluate_blocks(X.query_side(spark, d), gallery), gallery), 5)


@query("SELECT query_id, query_label AS true_label, top1_label AS predicted_label, round(top1_score, 6) AS top1_score, first_hit_rank::INT AS first_hit_rank, round(ap, 6) AS average_precision FROM q WHERE first_hit_rank IS NULL OR first_hit_rank > 5", X.SQL_PAIRS)
def g11_failures(spark: S, d: str) -> DataFrame:
    """G11, F3."""
    return r6(_failures(spark, d))


CENT = X.SQL_V + ", ce AS (SELECT label, d, avg(e[d + 1]) AS m FROM v, (SELECT unnest(range(64))::INT AS d) GROUP BY label, d), cl AS (SELECT label, list(m ORDER BY d) AS c FROM ce GROUP BY label), ds AS (SELECT v.label, sample_id, list_distance(e, c) AS far FROM v JOIN cl USING (label)), sp AS (SELECT label, stddev_samp(far) AS spread, count(*) AS n FROM ds GROUP BY label)"


@query("SELECT label, round(spread, 6) AS spread, n, round(sqrt(list_dot_product(c, c)), 6) AS centroid_norm FROM sp JOIN cl USING (label)", CENT)
def g15_class_statistics(spark: S, d: str) -> DataFrame:
    """G15."""
    s = failure.class_stats(X.vectors(spark, d))
    return r6(s.select("label", "spread", "n", V.norm("centroid").alias("centroid_norm")))


CAUSES = CENT + """, lv AS (SELECT quantile_cont(n, 0.2) AS rare_at, median(n) AS med FROM sp),
 bd AS (SELECT sample_id, i, e[1 + 8 * i : 8 + 8 * i] AS x FROM v, (SELECT unnest(range(8))::INT AS i)),
 dv AS (SELECT y.sample_id, 1 - avg(list_cosine_similarity(y.x, z.x)) AS dv FROM bd y JOIN bd z USING (sample_id) GROUP BY y.sample_id),
 cs AS (SELECT ds.sample_id, ds.label, dv > 0.3 AS mixed, least(dv / 0.5, 1) AS mixed_c, n <= rare_at AS rare, least(CASE WHEN med > 0 THEN greatest(0, 1 - n / med) ELSE 0 END, 1) AS rare_c, far / spread > 1.5 AS seas, least(far / spread / 3, 1) AS seas_c
        FROM ds JOIN sp USING (label) JOIN dv USING (sample_id), lv),
 cu AS (SELECT sample_id, u.cause, u.c, row_number() OVER (PARTITION BY sample_id ORDER BY u.c DESC, u.p) AS k FROM (SELECT sample_id, unnest([{'cause': 'mixed_scene', 'c': mixed_c, 'p': 1, 'f': mixed}, {'cause': 'rare_class', 'c': rare_c, 'p': 2, 'f': rare}, {'cause': 'seasonal_variation', 'c': seas_c, 'p': 3, 'f': seas}]) AS u FROM cs) WHERE u.f),
 cc AS (SELECT cs.sample_id, cs.label, coalesce(cu.cause, 'mixed_scene') AS failure_cause, coalesce(cu.c, 0.2) AS cause_confidence FROM cs LEFT JOIN cu ON cu.sample_id = cs.sample_id AND k = 1)"""


def _causes(spark: S, d: str) -> DataFrame:
    st = failure.class_stats(X.vectors(spark, d))
    levels = failure.class_levels(st.select("n"))
    rows = X.vectors(spark, d).withColumn("bands", graph.split_bands("vec", X.BANDS, X.WIDTH)).join(st, "label").crossJoin(F.broadcast(levels))
    far = V.l2_distance("vec", "centroid")
    cause, confidence = failure.choose_cause({"mixed_scene": failure.mixed_bands("bands"), "rare_class": failure.rare(F.col("n"), F.col("rare_at"), F.col("median_n")), "seasonal_variation": failure.seasonal(far, F.col("spread"))})
    return rows.select("sample_id", "label", cause.alias("failure_cause"), confidence.alias("cause_confidence"))


@query("SELECT sample_id, label, failure_cause, round(cause_confidence, 6) AS cause_confidence FROM cc", CAUSES)
def g13_failure_causes(spark: S, d: str) -> DataFrame:
    """G12, G13."""
    return r6(_causes(spark, d))


@query("SELECT c AS cause, count(failure_cause) AS count, round(count(failure_cause) / (SELECT count(*) FROM cc) * 100, 6) AS percentage, coalesce(string_agg(DISTINCT label::VARCHAR, ', ' ORDER BY label::VARCHAR), '') AS affected_classes, round(coalesce(avg(cause_confidence), 0), 6) AS avg_confidence FROM (SELECT unnest(['cloud_cover', 'mixed_scene', 'rare_class', 'seasonal_variation']) AS c) LEFT JOIN cc ON failure_cause = c GROUP BY c", CAUSES)
def g14_failures_by_cause(spark: S, d: str) -> DataFrame:
    """G14 by cause."""
    dimension = spark.createDataFrame([(c,) for c in failure.CAUSES], "cause string")
    rows = _causes(spark, d).withColumn("true_label", F.col("label").cast("string"))
    return r6(failure.by_cause(rows, dimension))


@query("SELECT l AS true_label, count(query_id) AS n_failures, round(avg(first_hit_rank), 6) AS avg_first_hit_rank, round(coalesce(avg(ap), 0), 6) AS mean_ap FROM (SELECT DISTINCT label AS l FROM v) LEFT JOIN (SELECT * FROM q WHERE first_hit_rank > 5 OR first_hit_rank IS NULL) f ON f.query_label = l GROUP BY l", X.SQL_PAIRS)
def g14_failures_by_class(spark: S, d: str) -> DataFrame:
    """G14 by class."""
    classes = X.vectors(spark, d).select(F.col("label").alias("true_label")).distinct()
    return r6(failure.by_class(_failures(spark, d), classes))


@query("SELECT query_label AS true_label, top1_label AS predicted_label, count(*) AS n FROM q WHERE first_hit_rank > 5 GROUP BY 1, 2", X.SQL_PAIRS)
def g16_confusion(spark: S, d: str) -> DataFrame:
    """G16."""
    return failure.confusion(_failures(spark, d))


@query("SELECT query_label AS true_label, " + ", ".join(f'count(*) FILTER (WHERE top1_label = {k}) AS "{k}"' for k in range(10)) + " FROM q WHERE first_hit_rank > 5 GROUP BY 1", X.SQL_PAIRS)
def g16_confusion_matrix(spark: S, d: str) -> DataFrame:
    """G16 as a pivot."""
    return failure.confusion_matrix(_failures(spark, d), list(range(10)))


@query("SELECT l_orderkey, l_linenumber, greatest(l_discount / 0.15, l_tax / 0.25) > 1 AS cloudy, round(least(greatest(l_discount / 0.15, l_tax / 0.25), 2) / 2, 6) AS confidence FROM lineitem")
def g12_cloud_detector(spark: S, d: str) -> DataFrame:
    """Cloud cover from two band means."""
    fires, confidence = failure.cloud(F.col("l_discount"), F.col("l_tax"))
    return r6(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", fires.alias("cloudy"), confidence.alias("confidence")))


# ---- attribution -----------------------------------------------------------------------


@query(", bs AS (SELECT sample_id, i, cw.w * fw.w AS a FROM cw JOIN fw USING (sigma, sample_id, i)) SELECT sample_id, i AS band_pos, round((a - min(a) OVER o) / (max(a) OVER o - min(a) OVER o), 4) + 0 AS score FROM bs WINDOW o AS (PARTITION BY sample_id)", Q.spectral())
def g7_band_attribution(spark: S, d: str) -> DataFrame:
    """G7, P18."""
    rows = attribution.attribute(X.conditioned(spark, d)).select("sample_id", F.posexplode("attribution").alias("band_pos", "score"))
    return rows.withColumn("score", F.round("score", 4))


AL = X.SQL_BANDS + ", mm AS (SELECT sample_id, label, i, (w - min(w) OVER o) / (max(w) OVER o - min(w) OVER o) AS a FROM w JOIN v USING (sample_id) WINDOW o AS (PARTITION BY sample_id)), pb AS (SELECT label, i AS band_pos, avg(a) AS mean, stddev_pop(a) AS std, count(*) AS n FROM mm GROUP BY label, i), bt AS (SELECT unnest(range(8))::INT AS band_pos, unnest(['B01', 'B02', 'B03', 'B04', 'B05', 'B06', 'B07', 'B08']) AS band, unnest(['Coastal/Aerosol', 'Visible (RGB)', 'Visible (RGB)', 'Visible (RGB)', 'Red-Edge', 'Red-Edge', 'Red-Edge', 'NIR']) AS g), gs AS (SELECT label, g, sum(mean) AS s, min(band_pos) AS p FROM pb JOIN bt USING (band_pos) GROUP BY label, g)"


def _per_band(spark: S, d: str) -> DataFrame:
    rows = X.conditioned(spark, d).select("label", V.min_max(graph.query_weights("bands", "query")).alias("attribution"))
    return attribution.class_attribution(rows)


@query("SELECT label, band_pos, round(mean, 6) AS mean, round(std, 6) AS std, n FROM pb", AL)
def g8_class_attribution(spark: S, d: str) -> DataFrame:
    """G8, P18, over query weights."""
    return r6(_per_band(spark, d))


@query("SELECT label, g AS spectral_group, round(s / greatest(sum(s) OVER (PARTITION BY label), 1e-8), 6) AS share FROM gs", AL)
def g9_spectral_group_shares(spark: S, d: str) -> DataFrame:
    """G9."""
    return r6(attribution.group_shares(_per_band(spark, d), dimensions.band_table(spark, 13)))


@query("SELECT label, (SELECT string_agg(band, ', ' ORDER BY k) FROM z WHERE z.label = x.label AND k <= 3) AS top_bands, (SELECT string_agg(band, ', ' ORDER BY k) FROM z WHERE z.label = x.label AND k > 5) AS bottom_bands, (SELECT g FROM gs WHERE gs.label = x.label ORDER BY s DESC, p LIMIT 1) AS dominant_region FROM (SELECT DISTINCT label FROM pb) x", AL + ", z AS (SELECT label, band, row_number() OVER (PARTITION BY label ORDER BY mean DESC, band_pos) AS k FROM pb JOIN bt USING (band_pos))")
def g10_band_preferences(spark: S, d: str) -> DataFrame:
    """G10."""
    rows = attribution.preferences(_per_band(spark, d), dimensions.band_table(spark, 13))
    return rows.select("label", "top_bands", "bottom_bands", "dominant_region")


@query("SELECT label, n_samples, round(top, 6) AS top, round(low, 6) AS low, 'No explanation is given for ' || label || '. Top bands: ' || tops || '.' AS explanation FROM (SELECT label, any_value(n) AS n_samples, max(mean) AS top, min(mean) AS low, (SELECT string_agg(band, ', ' ORDER BY k) FROM z WHERE z.label = pb.label AND k <= 3) AS tops FROM pb GROUP BY label)", AL + ", z AS (SELECT label, band, row_number() OVER (PARTITION BY label ORDER BY mean DESC, band_pos) AS k FROM pb JOIN bt USING (band_pos))")
def g10_band_scores(spark: S, d: str) -> DataFrame:
    """Scores, samples and explanation."""
    rows = attribution.preferences(_per_band(spark, d), dimensions.band_table(spark, 13))
    return r6(rows.select("label", "n_samples", F.get("top_scores", F.lit(0)).alias("top"), F.element_at("bottom_scores", -1).alias("low"), "explanation"))


@query(
    """SELECT a.label AS label_a, b.label AS label_b, round(sum(a.mean * b.mean) / (sqrt(sum(a.mean * a.mean)) * sqrt(sum(b.mean * b.mean))), 6) AS cosine_similarity, round(sqrt(sum((a.mean - b.mean) ** 2)), 6) AS l2_distance,
 round(1 - sum(a.mean * b.mean) / (sqrt(sum(a.mean * a.mean)) * sqrt(sum(b.mean * b.mean))), 6) AS shift_magnitude, array_to_string((list(bt.band ORDER BY abs(a.mean - b.mean) DESC, bt.band))[1:3], ', ') AS top_shifted_bands
 FROM pb a JOIN pb b ON a.band_pos = b.band_pos AND b.label = (a.label + 1) % 10 JOIN bt ON bt.band_pos = a.band_pos WHERE a.band_pos <> 3 GROUP BY a.label, b.label""",
    AL,
)
def j11_domain_shift(spark: S, d: str) -> DataFrame:
    """Classes against the next one, of a side that lacks one band; bands
    meet by name."""
    rows = _per_band(spark, d).join(F.broadcast(dimensions.band_table(spark, 13)), "band_pos").select("label", "band", "mean")
    pairs = spark.createDataFrame([(k, (k + 1) % 10) for k in range(10)], "label_a int, label_b int")
    return r6(attribution.domain_shift(rows, rows.filter("band <> 'B04'"), pairs))


@query("SELECT dd AS dropped, sample_id, d, round(v / sqrt(sum(v * v) OVER (PARTITION BY dd, sample_id)), 6) AS v FROM (SELECT dd, sample_id, d, avg(x[d + 1]) AS v FROM b, (SELECT unnest(range(8))::INT AS d), (SELECT unnest(range(8))::INT AS dd) WHERE i <> dd GROUP BY ALL)", X.SQL_BANDS)
def g21_leave_one_band_out(spark: S, d: str) -> DataFrame:
    """The mean fusion without each band in turn."""
    out = attribution.without_band(X.samples(spark, d)).select("dropped", "sample_id", graph.mean_fusion("bands").alias("f"))
    return r6(out.select("dropped", "sample_id", F.posexplode("f").alias("d", "v")))


LEFT_OUT = X.SQL_BANDS + """, dr AS (SELECT unnest([NULL, 0, 1, 2, 3, 4, 5, 6, 7])::INT AS dropped),
 ft AS (SELECT dropped, sample_id, label, list(v ORDER BY d) AS f FROM (SELECT dropped, sample_id, any_value(label) AS label, d, avg(x[d + 1]) AS v FROM b, (SELECT unnest(range(8))::INT AS d), dr WHERE dropped IS NULL OR i <> dropped GROUP BY dropped, sample_id, d) GROUP BY ALL),
 pr AS (SELECT q.dropped, q.sample_id AS query_id, (q.label = g.label)::INT AS rel, row_number() OVER (PARTITION BY q.dropped, q.sample_id ORDER BY list_cosine_similarity(q.f, g.f) DESC, g.sample_id) AS rank FROM ft q JOIN ft g ON q.dropped IS NOT DISTINCT FROM g.dropped AND q.sample_id % 5 = 0 AND g.sample_id % 5 IN (1, 2)),
 me AS (SELECT dropped, avg(h1) * 100 AS r1, avg(h10) * 100 AS r10 FROM (SELECT dropped, query_id, max(CASE WHEN rank <= 1 THEN rel ELSE 0 END) AS h1, max(CASE WHEN rank <= 10 THEN rel ELSE 0 END) AS h10 FROM pr GROUP BY ALL) GROUP BY dropped),
 de AS (SELECT me.dropped, me.r1, me.r10, w.r1 - me.r1 AS d1, w.r10 - me.r10 AS d10 FROM me, (SELECT r1, r10 FROM me WHERE dropped IS NULL) w WHERE me.dropped IS NOT NULL)"""


@query("SELECT dropped, round(r1, 6) AS r_at_1, round(r10, 6) AS r_at_10, round(d1, 6) AS delta_r_at_1, round(d10, 6) AS delta_r_at_10, (row_number() OVER (ORDER BY round(d10, 9) DESC, dropped))::INT AS rank FROM de", LEFT_OUT)
def g21_band_importance(spark: S, d: str) -> DataFrame:
    """The mean fusion evaluated again without each band."""
    return r6(methods.leave_one_band_out(X.samples(spark, d), X.roles(spark, d), X.BANDS))


# ---- methods ----------------------------------------------------------------------------


STAGED = Q.refined([(0.5, 0.01, 5)]) + """, wt AS (SELECT 0 AS config, sample_id, i, x, 1.0 AS w FROM b WHERE i IN (1, 2, 3) UNION ALL SELECT 1, sample_id, i, x, 1.0 FROM b UNION ALL SELECT 2, sample_id, i, x, w FROM cw UNION ALL SELECT 3, sample_id, i, x, fw.w FROM fw JOIN b USING (sample_id, i)),
 wf AS (SELECT config, sample_id, list(y ORDER BY d) AS f FROM (SELECT config, sample_id, d, sum(w * x[d + 1]) AS y FROM wt, (SELECT unnest(range(8))::INT AS d) GROUP BY ALL) GROUP BY ALL), """ + Q.unit("(SELECT * FROM wf UNION ALL SELECT 4, sample_id, f FROM rf)", "st") + Q.quality("st") + """,
 sm AS (SELECT config + 1 AS stage_order, ['selected', 'mean', 'affinity', 'fiedler', 'full'][config + 1] AS component, am.* EXCLUDE (config) FROM am)
 SELECT stage_order::INT AS stage_order, component, num_queries, round(r_at_1, 6) AS r_at_1, round(r_at_5, 6) AS r_at_5, round(r_at_10, 6) AS r_at_10, round(map, 6) AS map,
 round(r_at_1 - first(r_at_1) OVER o, 6) AS delta_r_at_1_vs_first, round(r_at_1 - coalesce(lag(r_at_1) OVER o, r_at_1), 6) AS incremental_delta_r_at_1, round(r_at_10 - first(r_at_10) OVER o, 6) AS delta_r_at_10_vs_first, round(r_at_10 - coalesce(lag(r_at_10) OVER o, r_at_10), 6) AS incremental_delta_r_at_10,
 stage_order > 1 AND r_at_1 - coalesce(lag(r_at_1) OVER o, r_at_1) <= 0 AS redundant FROM sm WINDOW o AS (ORDER BY stage_order)"""


@query(STAGED, Q.spectral())
def g23_component_ablation(spark: S, d: str) -> DataFrame:
    """G23, G17 over the five stages."""
    return r6(methods.ablation(X.samples(spark, d), X.roles(spark, d)))


SWEPT = Q.refined([(0.3, 0.01, 5), (0.5, 0.01, 5), (1.0, 0.01, 5), (0.5, 0.01, 1), (0.5, 0.01, 5)]) + Q.quality("rf") + """,
 ce(config, param, pos, value) AS (VALUES (0, 'sigma', 0, 0.3::DOUBLE), (1, 'sigma', 1, 0.5), (2, 'sigma', 2, 1.0), (3, 'num_steps', 0, 1.0), (4, 'num_steps', 1, 5.0)),
 cs AS (SELECT *, row_number() OVER (PARTITION BY param ORDER BY r_at_1 DESC, pos) AS place, max(r_at_1) OVER (PARTITION BY param) - min(r_at_1) OVER (PARTITION BY param) AS spread, string_agg(value::VARCHAR, ', ') OVER (PARTITION BY param ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS tested FROM ce JOIN am USING (config))
 SELECT param, tested AS tested_values, value AS best_value, round(r_at_1, 2) AS best_r_at_1, round(r_at_10, 2) AS best_r_at_10, round(spread, 2) AS r_at_1_range, CASE WHEN spread < 1.5 THEN 'Yes' ELSE 'No' END AS robust FROM cs WHERE place = 1"""


@query(SWEPT, Q.spectral((0.3, 0.5, 1.0)))
def g18_parameter_sweep(spark: S, d: str) -> DataFrame:
    """Steps and sigma, one at a time."""
    return r6(report.sweep_summary(methods.sweep(X.samples(spark, d), X.roles(spark, d), {"sigma": [0.3, 0.5, 1.0], "num_steps": [1, 5]}, ap=False)))


#: config: the fold, and 10 for each method; ``fr``: r_at_1 and map by method and fold.
CROSS = Q.refined([(k, 0.01, 5) for k in range(5)]) + """, cb AS (SELECT sigma, sample_id FROM cw GROUP BY ALL),
 wt AS (SELECT sigma::INT AS config, sample_id, i, x, 1.0 AS w FROM cb JOIN b USING (sample_id) UNION ALL SELECT sigma::INT + 10, sample_id, i, x, w FROM cw),
 wf AS (SELECT config, sample_id, list(y ORDER BY d) AS f FROM (SELECT config, sample_id, d, sum(w * x[d + 1]) AS y FROM wt, (SELECT unnest(range(8))::INT AS d) GROUP BY ALL) GROUP BY ALL), """ + Q.unit("(SELECT * FROM wf UNION ALL SELECT config + 20, sample_id, f FROM rf)", "st") + """,
 lf AS MATERIALIZED (SELECT config, config % 10 AS fold, sample_id, label, f FROM st JOIN v USING (sample_id)),
 pq AS (SELECT q.config, q.sample_id AS query_id, (q.label = g.label)::INT AS rel, row_number() OVER (PARTITION BY q.config, q.sample_id ORDER BY list_dot_product(q.f, g.f) DESC, g.sample_id) AS rank FROM lf q JOIN lf g ON q.config = g.config AND q.sample_id % 5 = q.fold AND g.sample_id % 5 = (q.fold + 1) % 5),
 pz AS (SELECT *, sum(rel) OVER (PARTITION BY config, query_id ORDER BY rank) AS seen FROM pq),
 aq AS (SELECT config, query_id, CASE WHEN sum(rel) > 0 THEN sum(CASE WHEN rel = 1 THEN seen / rank ELSE 0 END) / sum(rel) ELSE 0 END AS ap, max(CASE WHEN rank <= 1 THEN rel ELSE 0 END) AS h1 FROM pz GROUP BY ALL),
 fr AS (SELECT ['mean', 'affinity', 'full'][config // 10 + 1] AS method, config % 10 AS fold_id, avg(h1) * 100 AS r_at_1, avg(ap) * 100 AS map FROM aq GROUP BY config)
 SELECT method, count(DISTINCT fold_id) AS num_folds, round(avg(r_at_1), 6) AS r_at_1_mean, round(coalesce(stddev_samp(r_at_1), 0), 6) AS r_at_1_std, printf('%.2f±%.2f', avg(r_at_1), coalesce(stddev_samp(r_at_1), 0)) AS r_at_1_mean_std, round(avg(map), 6) AS map_mean, round(coalesce(stddev_samp(map), 0), 6) AS map_std, printf('%.2f±%.2f', avg(map), coalesce(stddev_samp(map), 0)) AS map_mean_std FROM fr GROUP BY method"""


@query(CROSS, Q.spectral(query=Q.FOLD_LABEL))
def r17_cross_validation(spark: S, d: str) -> DataFrame:
    """Three methods over five folds."""
    folds = X.vectors(spark, d).select("sample_id", "label", (F.col("sample_id") % 5).cast("int").alias("bucket"))
    rows = methods.cross_validate(X.samples(spark, d), folds, 5, ["mean", "affinity", "full"])
    return r6(report.comparison(methods.fold_metrics(rows), ["r_at_1", "map"]))


PLAIN = X.SQL_BANDS + """, fs AS (SELECT m, sample_id, any_value(label) AS label, list(v ORDER BY d) AS f FROM (SELECT m, sample_id, any_value(label) AS label, d, avg(x[d + 1]) AS v FROM b, (SELECT unnest(range(8))::INT AS d), (SELECT unnest(['index', 'mean', 'selected']) AS m) WHERE CASE m WHEN 'index' THEN i IN (2, 3, 7) WHEN 'selected' THEN i IN (1, 2, 3) ELSE true END GROUP BY m, sample_id, d) GROUP BY m, sample_id),
 pr AS (SELECT q.m, q.sample_id AS query_id, (q.label = g.label)::INT AS rel, row_number() OVER (PARTITION BY q.m, q.sample_id ORDER BY list_cosine_similarity(q.f, g.f) DESC, g.sample_id) AS rank FROM fs q JOIN fs g ON q.m = g.m AND q.sample_id % 5 = 0 AND g.sample_id % 5 IN (1, 2)),
 sn AS (SELECT *, sum(rel) OVER (PARTITION BY m, query_id ORDER BY rank) AS seen FROM pr),
 aq AS (SELECT m, query_id, sum(CASE WHEN rel = 1 THEN seen / rank ELSE 0 END) / greatest(sum(rel), 1) AS ap, max(CASE WHEN rank <= 1 THEN rel ELSE 0 END) AS h1 FROM sn GROUP BY ALL)"""


@query("SELECT m AS method, count(*) AS num_queries, round(avg(h1) * 100, 6) AS r_at_1, round(avg(ap) * 100, 6) AS map FROM aq GROUP BY m", PLAIN)
def r17_plain_baselines(spark: S, d: str) -> DataFrame:
    """The methods without a kernel, an eigenvector or a graph."""
    out = None
    for m in ("selected", "index", "mean"):
        rows = ranking.summary(methods.evaluate_method(X.samples(spark, d), X.roles(spark, d), m), (1,), ["method"])
        out = rows if out is None else out.unionByName(rows)
    return r6(out)


FLAT_PCA = X.SQL_V + """, fx AS (SELECT sample_id, i, e[i + 1] AS x FROM v, (SELECT unnest(range(64))::INT AS i)),
 fm AS (SELECT i, avg(x) AS m FROM fx WHERE sample_id % 5 IN (1, 2) GROUP BY i), fc AS (SELECT sample_id, i, x - m AS x FROM fx JOIN fm USING (i)),
 cv AS MATERIALIZED (SELECT 0 AS sigma, 0 AS sample_id, a.i, b.i AS j, avg(a.x * b.x) AS a FROM fc a JOIN fc b ON a.sample_id = b.sample_id AND a.sample_id % 5 IN (1, 2) GROUP BY a.i, b.i), """ + Q.axes("cv", 3) + """,
 pr AS (SELECT 0 AS config, sample_id, list(z ORDER BY k) AS f FROM (SELECT sample_id, k, sum(x * w) AS z FROM fc JOIN ev USING (i) WHERE sample_id % 5 < 3 GROUP BY ALL) GROUP BY sample_id), """ + Q.unit("pr", "pf") + Q.quality("pf")
SUMMARY = " SELECT num_queries, round(r_at_1, 6) AS r_at_1, round(r_at_5, 6) AS r_at_5, round(r_at_10, 6) AS r_at_10, round(map, 6) AS map FROM am"


@query(SUMMARY, FLAT_PCA)
def a11_embedding_pca(spark: S, d: str) -> DataFrame:
    """Retrieval in three components of the flattened bands, fitted on the
    gallery."""
    return r6(ranking.summary(methods.evaluate_method(X.samples(spark, d), X.roles(spark, d), "pca")))


PROPAGATED = X.SQL_BANDS + """, s3 AS (SELECT 0 AS config, sample_id, list(y ORDER BY d) AS f FROM (SELECT sample_id, d, avg(x[d + 1]) AS y FROM b, (SELECT unnest(range(8))::INT AS d) WHERE i IN (1, 2, 3) GROUP BY ALL) GROUP BY sample_id), """ + Q.unit("s3", "sf") + """,
 sl AS MATERIALIZED (SELECT sample_id, label, f FROM sf JOIN v USING (sample_id)),
 ng AS MATERIALIZED (SELECT src_id, dst_id, s / (sum(s) OVER (PARTITION BY src_id) + 1e-6) AS weight FROM (SELECT x.sample_id AS src_id, y.sample_id AS dst_id, greatest(list_cosine_similarity(x.f, y.f), 0) AS s,
   row_number() OVER (PARTITION BY x.sample_id ORDER BY greatest(list_cosine_similarity(x.f, y.f), 0) DESC, y.sample_id) AS k FROM sl x JOIN sl y ON x.sample_id % 5 IN (1, 2) AND y.sample_id % 5 IN (1, 2) AND x.sample_id <> y.sample_id) WHERE k <= 20),
 dp AS MATERIALIZED (SELECT q.sample_id AS query_id, g.sample_id AS gallery_id, list_dot_product(q.f, g.f) AS sim, (q.label = g.label)::INT AS rel FROM sl q JOIN sl g ON q.sample_id % 5 = 0 AND g.sample_id % 5 IN (1, 2)),
 sp AS (SELECT query_id, src_id AS gallery_id, sum(weight * sim) AS s FROM ng JOIN dp ON dp.gallery_id = ng.dst_id GROUP BY ALL),
 rk AS (SELECT alpha, query_id, rel, row_number() OVER (PARTITION BY alpha, query_id ORDER BY (1 - alpha) * sim + alpha * s DESC, gallery_id) AS rank FROM dp JOIN sp USING (query_id, gallery_id), (SELECT unnest([0.3, 0.5, 0.7])::DOUBLE AS alpha)),
 rs AS (SELECT *, sum(rel) OVER (PARTITION BY alpha, query_id ORDER BY rank) AS seen FROM rk),
 aq AS (SELECT alpha AS config, query_id, CASE WHEN sum(rel) > 0 THEN sum(CASE WHEN rel = 1 THEN seen / rank ELSE 0 END) / sum(rel) ELSE 0 END AS ap, max(CASE WHEN rank <= 1 THEN rel ELSE 0 END) AS h1, max(CASE WHEN rank <= 5 THEN rel ELSE 0 END) AS h5, max(CASE WHEN rank <= 10 THEN rel ELSE 0 END) AS h10 FROM rs GROUP BY ALL),
 al AS (SELECT config, count(*) AS num_queries, avg(h1) * 100 AS r_at_1, avg(h5) * 100 AS r_at_5, avg(h10) * 100 AS r_at_10, avg(ap) * 100 AS map FROM aq GROUP BY config),
 am AS (SELECT * FROM al ORDER BY round(r_at_1, 9) DESC, round(r_at_5, 9) DESC, round(map, 9) DESC, config LIMIT 1)"""


@query(SUMMARY, PROPAGATED)
def r17_propagation(spark: S, d: str) -> DataFrame:
    """The propagation baseline with its best alpha."""
    return r6(ranking.summary(methods.evaluate_method(X.samples(spark, d), X.roles(spark, d), "propagation")))


VOTED = X.SQL_BANDS + """, mf AS MATERIALIZED (SELECT sample_id, label, list(y ORDER BY d) AS f FROM (SELECT sample_id, label, d, avg(x[d + 1]) AS y FROM b, (SELECT unnest(range(8))::INT AS d) GROUP BY ALL) GROUP BY ALL),
 vt AS (SELECT x.sample_id, y.label, sum(exp(-5.5 * (1 - list_cosine_similarity(x.f, y.f)))) AS votes FROM mf x JOIN mf y ON x.sample_id % 5 < 3 AND y.sample_id % 5 >= 3 GROUP BY ALL),
 lo AS (SELECT 0 AS config, x.sample_id, list(list_cosine_similarity(x.f, c.q) + 20 * coalesce(votes, 0) ORDER BY c.label) AS f FROM mf x JOIN c ON x.sample_id % 5 < 3 LEFT JOIN vt ON vt.sample_id = x.sample_id AND vt.label = c.label GROUP BY x.sample_id), """ + Q.unit("lo", "lf2") + Q.quality("lf2")


@query(SUMMARY, VOTED)
def a18_vote_method(spark: S, d: str) -> DataFrame:
    """Retrieval in the space of vote logits."""
    return r6(ranking.summary(methods.evaluate_method(X.samples(spark, d), X.roles(spark, d), "vote")))
