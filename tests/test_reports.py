import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismrank.functions import vectors as V
from prismrank.operators import attribution, failure, labels, pixels, report, stats
from prismrank.sources import dimensions, sinks, tables


def test_tail_probabilities():
    assert stats.t_tail(10.845875, 4) == pytest.approx(4.1008e-4, rel=1e-4)
    for t, df, p in ((1.0, 1, 0.5), (2.776445, 4, 0.05), (12.706205, 1, 0.05), (1.959964, 10**6, 0.05)):
        assert stats.t_tail(t, df) == pytest.approx(p, rel=1e-4)
    assert stats.t_tail(0, 3) == 1.0 and stats.chi2_tail(0) == 1.0 and stats.chi2_tail(3.841459) == pytest.approx(0.05, rel=1e-5)


def test_paired_t(spark):
    rows = [("a", 2.0, 1.0), ("a", 4.0, 2.0), ("a", 6.0, 3.0), ("a", 8.0, 4.0), ("a", None, 1.0), ("a", float("nan"), 1.0), ("a", float("inf"), 1.0), ("b", 1.0, 2.0), ("c", 5.0, 5.0), ("c", 6.0, 6.0)]
    got = {r.g: r for r in stats.paired_t(spark.createDataFrame(rows, "g string, x double, y double"), "x", "y", ["g"]).collect()}
    assert (got["a"].n_pairs, got["a"].t_stat) == (4, pytest.approx(3.872983, abs=1e-6)) and got["a"].p_value == pytest.approx(0.030466, abs=1e-5)
    assert got["b"].t_stat is None and got["b"].p_value is None
    assert (got["c"].t_stat, got["c"].p_value) == (0.0, 1.0)
    table = stats.bonferroni(spark.createDataFrame([(0.01,), (0.4,), (None,), (0.9,)], "p_value double"))
    assert [r.p_bonferroni for r in table.orderBy("p_value").collect()] == [None, pytest.approx(0.03), 1.0, 1.0]


def test_mcnemar(spark):
    rows = [("a", 1, 0)] * 10 + [("a", 0, 1)] * 2 + [("a", 1, 1)] * 5 + [("b", 1, 1), ("c", 1, 0)]
    got = {r.g: r for r in stats.mcnemar(spark.createDataFrame(rows, "g string, x int, y int"), "x", "y", ["g"]).collect()}
    assert got["a"].chi2 == pytest.approx(4.083333, abs=1e-6) and got["a"].p_value == pytest.approx(0.043308, abs=1e-6)
    assert (got["b"].chi2, got["b"].p_value) == (0, 1) and (got["c"].chi2, got["c"].p_value) == (0, 1)


def test_resampling_is_seeded_and_covers_the_mean(spark):
    rng = np.random.default_rng(0)
    rows = [(g, i, float(x), 0.0) for g, mean in (("a", 1), ("b", 0)) for i, x in enumerate(rng.normal(mean, 1, 300))]
    df = spark.createDataFrame(rows, "g string, i int, x double, y double")
    a = {r.g: tuple(r) for r in stats.bootstrap(df, "x", "y", ["g"], ["i"], 1000).collect()}
    for k in (1, 5):  # the same however rows are dealt
        for r in stats.bootstrap(df.repartition(k), "x", "y", ["g"], ["i"], 1000).collect():
            assert tuple(r)[1:] == pytest.approx(a[r.g][1:], abs=1e-12)
    for r in a.values():
        d = np.array([x for g, _, x, _ in rows if g == r[0]])
        classic = np.percentile([rng.choice(d, 300).mean() for _ in range(2000)], (2.5, 97.5))
        assert r[1] == pytest.approx(d.mean()) and r[2:] == pytest.approx(classic, abs=0.025)
    p = {r.g: r for r in stats.permutation(df, "x", "y", ["g"], ["i"], 1000).collect()}
    assert p["a"].p_value == 0 and p["a"].mean_diff == pytest.approx(a["a"][1])
    d = np.array([x for g, _, x, _ in rows if g == "b"])
    flipped = np.abs((rng.choice((-1.0, 1.0), (5000, 300)) * d).mean(1)) >= abs(d.mean())
    assert p["b"].p_value == pytest.approx(flipped.mean(), abs=0.06)
    whole = stats.bootstrap(df, "x", "y", [], ["g", "i"], 50).first()
    assert whole.ci_lower < whole.mean_diff < whole.ci_upper
    assert stats.bootstrap(df.limit(0), "x", "y", ["g"], ["i"], 10).count() == 0


def test_drawn_numbers_have_their_distribution():
    ids = np.arange(20_000, dtype=np.uint64)
    w = stats.poisson_weights(42, ids, 50)
    assert w.shape == (20_000, 50) and np.bincount(w.astype(int).reshape(-1))[:4] / w.size == pytest.approx([np.exp(-1), np.exp(-1), np.exp(-1) / 2, np.exp(-1) / 6], abs=2e-3)
    s = stats.signs(42, ids, 130)
    assert s.shape == (20_000, 130) and abs(s.mean()) < 2e-3 and np.abs(np.corrcoef(s[:, :20].T) - np.eye(20)).max() < 0.04


def test_spread_of_one_value_is_zero(spark):
    df = spark.createDataFrame([("m", 0, 50.0), ("n", 0, 1.0), ("n", 1, 3.0)], "method string, fold_id int, r double")
    got = {r.method: r for r in report.comparison(df, ["r"]).collect()}
    assert got["m"].r_std == 0.0 and got["m"].r_mean_std == "50.00±0.00" and got["n"].r_std == pytest.approx(math.sqrt(2))
    assert spark.range(1).select(report.mean_std_text(F.lit(float("nan")), F.lit(1.0)).alias("t")).first().t == ""


def test_timing_percentiles(spark):
    r = report.timing(spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 5)], "c string, v double"), "c", "v").first()
    assert (r.p95, r.median, r.share_pct, r.bottleneck) == (pytest.approx(4.8), 3, 100, True)


def test_spectral_indices_and_stretch(spark):
    raw = pixels.raw_indices(F.lit(0.6), F.lit(0.2), F.lit(0.3))
    r = spark.range(1).select(*[v.alias(k) for k, v in raw.items()]).first()
    assert (r.ndvi, r.ndwi, r.savi) == pytest.approx((0.499999, -0.333333, 0.461538), abs=1e-5)
    s = pixels.stretch(spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 5)], "v double"), "v").orderBy("v").collect()
    assert [x.stretched for x in s] == pytest.approx([0, (2 - 1.08) / 3.84, 0.5, (4 - 1.08) / 3.84, 1])


def test_pca_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4)) @ rng.normal(size=(4, 4))
    df = spark.createDataFrame([(i % 5, i, *map(float, r)) for i, r in enumerate(x)], "image int, pixel_id int, a double, b double, c double, d double")
    state = pixels.fit_pca(df, ["a", "b", "c", "d"])
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    assert np.allclose(state.variance, values[::-1][:3]) and np.allclose(np.abs(np.array(state.components)), np.abs(vectors[:, ::-1][:, :3].T))
    got = pixels.apply_pca(df, state, ["a", "b", "c", "d"]).orderBy("pixel_id").collect()
    p = (x - x.mean(0)) @ np.array(state.components).T
    assert np.allclose([[r.pc1, r.pc2, r.pc3] for r in got], (p - p.min(0)) / (np.ptp(p, axis=0) + 1e-6), atol=1e-9)
    one = {r.pixel_id: r for r in pixels.image_pca(df, "image", ["a", "b", "c", "d"]).collect()}
    y = x[2::5] - x[2::5].mean(0)
    w = np.linalg.eigh(y.T @ y)[1][:, ::-1][:, 0]
    w = w * np.sign(w[np.abs(w).argmax()])
    p = y @ w
    assert np.allclose([one[i].pc1 for i in range(2, 400, 5)], (p - p.min()) / (np.ptp(p) + 1e-6))


def test_token_pooling_weights():
    for size, to in ((14, 4), (8, 4), (3, 3), (2, 5)):
        rows = pixels.pool_weights(size, to)
        for o in range(to):
            assert sum(w for a, _, w in rows if a == o) == pytest.approx(1)
            assert all(0 <= i < size for a, i, _ in rows if a == o)


def test_labels(spark):
    names = dimensions.LAND_COVER_19
    r = spark.createDataFrame([(["Pastures", "Rice fields", "Permanently irrigated land"],)], "l array<string>").select(labels.roll_up("l", names).alias("o"), labels.multi_hot("l", ["Pastures", "x"]).alias("h")).first()
    assert r.o == ["Pastures", "Arable land"] and r.h == [1, 0]
    kept = set(dimensions.COVER_CLASSES)
    assert all(c in kept or c in set(names.values()) for c in dimensions.COVER_CLASSES) and names["Transitional woodland, shrub"] in kept
    assert dimensions.band_names(12)[10] == "B11" and dimensions.band_index("B10") == 10 and dimensions.rgb_positions() == (3, 2, 1)
    with pytest.raises(KeyError):
        dimensions.band_index("B10", 12)


def test_causes(spark):
    df = spark.createDataFrame([(0.2, 0.1), (0.0, 0.1)], "b10 double, b09 double")
    cause, conf = failure.choose_cause({"cloud_cover": failure.cloud(F.col("b10"), F.col("b09")), "rare_class": failure.rare(F.lit(1), F.lit(2.0), F.lit(3.0))})
    got = df.select(cause.alias("c"), conf.alias("s")).collect()
    assert (got[0].c, got[0].s) == ("cloud_cover", pytest.approx(2 / 3)) and (got[1].c, got[1].s) == ("rare_class", pytest.approx(2 / 3))
    none, low = failure.choose_cause({"cloud_cover": failure.cloud(F.lit(0.0), F.lit(0.0))})
    assert tuple(spark.range(1).select(none, low).first()) == ("mixed_scene", 0.2)


def test_domain_shift_meets_bands_by_name(spark):
    a = spark.createDataFrame([(0, "B01", 1.0), (0, "B10", 5.0), (0, "B11", 2.0)], "label int, band string, mean double")
    b = spark.createDataFrame([(1, "B01", 1.0), (1, "B11", 2.0)], "label int, band string, mean double")
    r = attribution.domain_shift(a, b, spark.createDataFrame([(0, 1)], "label_a int, label_b int")).first()
    assert r.cosine_similarity == pytest.approx(1) and r.l2_distance == 0 and "B10" not in r.top_shifted_bands


def test_sinks_and_sources(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "p int, q string"), spark.createDataFrame([(2.5, 2)], "r double, p int")
    both = sinks.union_rows([a, b])
    assert both.columns == ["p", "q", "r"] and both.count() == 2
    sinks.write_csv(both, f"{tmp_path}/csv", 1)
    with pytest.raises(ValueError):
        sinks.write_csv(both.limit(0), f"{tmp_path}/none")
    back = tables.external_results(spark, {"ours": f"{tmp_path}/csv"})
    assert back.columns == ["p", "q", "r", "method"] and {r.method for r in back.collect()} == {"ours"}
    sinks.write_bundle(spark, f"{tmp_path}/bundle", {"t": a}, {"seed": 1})
    assert '"t"' in (tmp_path / "bundle/manifest.json").read_text()
    assert sinks.write_templates(spark, f"{tmp_path}/tpl", ["m"], ["r"], 2) == ["m"] and sinks.write_templates(spark, f"{tmp_path}/tpl", ["m"], ["r"], 2) == []
    assert "| 2.50 |" in sinks.markdown(b)
    tables.write_cache(a, f"{tmp_path}/cache", 1, "train")
    assert tables.read_cache(spark, f"{tmp_path}/cache", 1, "train").count() == 1
    with pytest.raises(FileNotFoundError):
        tables.read_cache(spark, f"{tmp_path}/cache", 2, "train")
    assert tables.read_or_build(spark, f"{tmp_path}/cache", 2, "val", lambda: b).count() == 1


def test_patch_scans(spark, tmp_path):
    def patch(name, meta, bands=("B02", "B03", "B04", "B01")):
        (tmp_path / "p" / name).mkdir(parents=True)
        for x in bands:
            (tmp_path / "p" / name / f"{name}_{x}.tif").write_bytes(b"x")
        if meta:
            (tmp_path / "p" / name / f"{name}.json").write_text(meta)

    patch("S_1_1", '{"labels": ["Rice fields", "Airports"], "contains_seasonal_snow": "0"}')
    patch("S_1_2", '{"labels": ["Pastures"], "contains_seasonal_snow": "1"}')
    patch("S_1_3", '{"labels": ["Airports"]}')
    patch("S_1_4", '{"labels": ["Pastures"], "contains_cloud_or_shadow": "unknown"}', ("B02",))
    got = {r.patch_id: r.labels for r in tables.patches(spark, f"{tmp_path}/p", dimensions.LAND_COVER_19, list(dimensions.COVER_CLASSES)).collect()}
    assert got == {"S_1_1": ["Arable land"], "S_1_4": ["Pastures"]}
    files = tables.patches_from_files(spark, f"{tmp_path}/p")
    assert {r.patch_id for r in files.collect()} == {"S_1_1", "S_1_2", "S_1_3"}


def test_class_folder_and_encoder_hooks(spark, tmp_path):
    from prismrank.sources import images

    for c in ("A", "B"):
        (tmp_path / c).mkdir()
        (tmp_path / c / "1.tif").write_bytes(np.full((2, 3, 4), 5000 if c == "A" else 20000, np.uint16).tobytes())
    rows = images.class_folder(spark, str(tmp_path), ["A", "B"])
    assert {(r.label, r.label_name) for r in rows.collect()} == {(0, "A"), (1, "B")}
    with pytest.raises(FileNotFoundError):
        images.class_folder(spark, str(tmp_path), ["A", "C"])
    content = spark.read.format("binaryFile").load(f"{tmp_path}/*/*.tif").select("path", "content")
    cubes = images.decode(rows.join(content, "path"), lambda data: np.frombuffer(data, np.uint16).reshape(2, 3, 4), 2)
    px = images.pixel_rows(cubes, 2).join(rows, "sample_id").groupBy("label").agg(F.count("*").alias("n"), F.max("b1").alias("m")).orderBy("label").collect()
    assert [(r.n, r.m) for r in px] == [(12, 0.5), (12, 1.0)]
    vec = images.encode(rows, lambda: lambda names: np.array([[3.0, 4.0 if n == "A" else 0.0] for n in names]), "label_name", 2)
    assert sorted(tuple(np.round(r.vec, 3)) for r in vec.collect()) == [(0.6, 0.8), (1.0, 0.0)]


def test_stream_equals_batch(spark, tmp_path):
    from prismrank.operators import ranking
    from prismrank.streaming.scoring import score_stream

    rng = np.random.default_rng(0)
    q = spark.createDataFrame([(i, 0, rng.normal(size=3).tolist()) for i in range(10)], "query_id long, query_label int, query_vec array<double>")
    g = spark.createDataFrame([(i, 0, rng.normal(size=3).tolist()) for i in range(30)], "gallery_id long, gallery_label int, gallery_vec array<double>")
    q.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(q.schema).parquet(f"{tmp_path}/in")
    score_stream(stream, g, f"{tmp_path}/out", f"{tmp_path}/check", 4).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").select("query_id", "rank", "gallery_id")
    want = ranking.top(ranking.pairs(q, g), 4).select("query_id", "rank", "gallery_id")
    assert got.count() == 40 and got.exceptAll(want).count() == 0


def test_registered_queries_have_names_and_sql(spark):
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 90
    assert e.entry(spark).count() == 1
    assert V.NORM_FLOOR > 0


def test_registered_cross_validation_has_all_folds(spark):
    from prismrank.plans import report_queries

    rows = report_queries.r17_cross_validation(spark, "/root/testdata/sf0.001").collect()
    assert {r.method: r.num_folds for r in rows} == {"mean": 5, "affinity": 5, "full": 5}


def test_registered_resampling_has_1000_rounds(spark, monkeypatch):
    from prismrank.plans import report_queries

    seen = {}
    for name in ("bootstrap", "permutation"):

        def spy(*args, name=name, call=getattr(stats, name), **kw):
            seen[name] = kw.get("rounds")
            return call(*args, **kw)

        monkeypatch.setattr(stats, name, spy)
    for name in ("t4_bootstrap", "t6_permutation"):
        assert getattr(report_queries, name)(spark, "/root/testdata/sf0.001").count() == 3
    assert seen == {"bootstrap": 1000, "permutation": 1000}
