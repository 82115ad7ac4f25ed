import numpy as np
import pytest
from pyspark.sql import functions as F

from prismrank.operators import attribution, graph, kernel, pca, ranking, report, scoring
from prismrank.plans import methods, retrieval
from prismrank.sources import images, sinks, tables

CONFIG = kernel.Config(k=3)


def data(n=60, b=8, d=5, seed=0):
    """Bands have a common part, so that no graph of bands falls apart: its
    spectral vector would not be unique."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(3, b, d)) + 2
    return [(i, i % 3, (centres[i % 3] + rng.normal(size=(b, d))).tolist()) for i in range(n)]


@pytest.fixture(scope="module")
def tables_(spark):
    rows = data()
    samples = spark.createDataFrame(rows, "sample_id long, label int, bands array<array<double>>").repartition(3)
    role = lambda i: "query" if i % 5 == 0 else "gallery" if i % 5 <= 2 else "train"
    roles = spark.createDataFrame([(i, c, role(i)) for i, c, _ in rows], "sample_id long, label int, role string")
    return rows, samples, roles, {r: [x for x in rows if role(x[0]) == r] for r in ("query", "gallery", "train")}


def quality(q, g, ks=(1, 5, 10)):
    """R@k and mAP, in percent, of (label, vector) lists by dot product; ids are
    places."""
    hits, aps = [], []
    for label, v in q:
        order = sorted(range(len(g)), key=lambda k: (-float(np.dot(v, g[k][1])), k))
        rel = np.array([g[k][0] == label for k in order])
        at = np.flatnonzero(rel) + 1
        aps.append((np.arange(1, len(at) + 1) / at).mean() if len(at) else 0.0)
        hits.append([rel[:k].any() for k in ks])
    return [*(100 * np.mean(hits, 0)), 100 * np.mean(aps)]


def unit(x):
    return np.array(x) / np.linalg.norm(x)


def metrics(rows):
    r = ranking.summary(rows).first()
    return [r.r_at_1, r.r_at_5, r.r_at_10, r.map]


def centroids(train):
    return {c: np.mean([b for _, k, x in train if k == c for b in x], 0) for c in {k for _, k, _ in train}}


def test_unknown_methods_and_folds_are_errors():
    methods.check_methods(list(methods.METHODS))
    with pytest.raises(ValueError, match="nothing"):
        methods.check_methods(["mean", "nothing"])
    assert methods.check_folds(None, 5) == [0, 1, 2, 3, 4] and methods.check_folds([3, 1], 5) == [1, 3]
    with pytest.raises(ValueError):
        methods.check_folds([7], 5)


def test_methods_equal_numpy(tables_):
    _, samples, roles, side = tables_
    query = centroids(side["train"])

    def kernel_of(steps):
        return lambda c, x: kernel.pipeline(np.array([x]), query[c][None], kernel.Config(k=3, num_steps=steps))["fused"][0]

    ways = {
        "selected": lambda c, x: unit(np.mean([x[i] for i in (3, 2, 1)], 0)), "index": lambda c, x: unit(np.mean([x[i] for i in (7, 3, 2)], 0)), "mean": lambda c, x: unit(np.mean(x, 0)),
        "fiedler": kernel_of(0), "full": kernel_of(CONFIG.num_steps),
    }
    for name, way in ways.items():
        q, g = ([(c, way(c, x)) for _, c, x in side[r]] for r in ("query", "gallery"))
        assert metrics(methods.evaluate_method(samples, roles, name, CONFIG)) == pytest.approx(quality(q, g)), name


def test_features_from_elsewhere_are_evaluated_alike(tables_):
    _, samples, roles, _ = tables_
    made = samples.select("sample_id", graph.mean_fusion("bands").alias("vec"))
    a, b = (ranking.summary(x).first() for x in (methods.evaluate_features(made, roles, "mean"), methods.evaluate_method(samples, roles, "mean")))
    assert tuple(a) == tuple(b)


def test_pca_of_flattened_bands_equals_numpy(tables_):
    _, samples, roles, side = tables_
    g = np.array([np.ravel(x) for _, _, x in side["gallery"]])
    values, vectors = np.linalg.eigh(np.cov(g.T, bias=True))
    w = vectors[:, ::-1][:, :3]
    place = lambda x: unit((np.ravel(x) - g.mean(0)) @ w)
    q, g2 = ([(c, place(x)) for _, c, x in side[r]] for r in ("query", "gallery"))
    assert metrics(methods.evaluate_method(samples, roles, "pca")) == pytest.approx(quality(q, g2))
    state = pca.fit(samples.join(roles.filter("role = 'gallery'").select("sample_id"), "sample_id").select(F.flatten("bands").alias("vec")), 3)
    assert np.allclose(state.variance, values[::-1][:3]) and np.allclose(np.abs(np.array(state.components) @ w), np.eye(3), atol=1e-6)
    with pytest.raises(ValueError):
        pca.fit(samples.limit(0).select(F.flatten("bands").alias("vec")))


def test_propagation_takes_its_best_alpha(tables_):
    _, samples, roles, side = tables_
    place = lambda x: unit(np.mean([x[i] for i in (3, 2, 1)], 0))
    q, g = ([(c, place(x)) for _, c, x in side[r]] for r in ("query", "gallery"))
    sim = np.maximum(np.array([x for _, x in g]) @ np.array([x for _, x in g]).T, 0)
    np.fill_diagonal(sim, -1)
    near = np.argsort(-sim, axis=1, kind="stable")[:, :20]
    weights = np.zeros_like(sim)
    np.put_along_axis(weights, near, np.take_along_axis(sim, near, 1), 1)
    weights /= weights.sum(1, keepdims=True) + 1e-6
    scores = []
    for a in methods.ALPHAS:
        moved = (1 - a) * np.array([x for _, x in g]) + a * weights @ np.array([x for _, x in g])
        scores.append(quality(q, [(c, v) for (c, _), v in zip(g, moved)]))
    best = max(scores, key=lambda s: (round(s[0], 9), round(s[1], 9), round(s[3], 9)))
    assert metrics(methods.evaluate_method(samples, roles, "propagation")) == pytest.approx(best)


def test_vote_method_equals_numpy(tables_):
    _, samples, roles, side = tables_
    mean = lambda x: unit(np.mean(x, 0))
    text = {c: unit(v) for c, v in centroids(side["train"]).items()}

    def place(x):
        v = mean(x)
        return unit([v @ text[c] + 20 * sum(np.exp(-5.5 * (1 - v @ mean(t))) for _, k, t in side["train"] if k == c) for c in sorted(text)])

    q, g = ([(c, place(x)) for _, c, x in side[r]] for r in ("query", "gallery"))
    assert metrics(methods.evaluate_method(samples, roles, "vote")) == pytest.approx(quality(q, g))


def test_cross_validation_equals_its_folds(tables_, spark):
    rows, samples, _, _ = tables_
    folds = spark.createDataFrame([(i, c, i // 3 % 5) for i, c, _ in rows], "sample_id long, label int, bucket int")
    got = {(r.method, r.fold_id): (r.r_at_1, r.map, r.num_queries) for r in methods.fold_metrics(methods.cross_validate(samples, folds, 5, ["mean", "selected"])).collect()}
    assert len(got) == 10 and {n for _, _, n in got.values()} == {12}
    for fold in range(5):
        q, g = ([(c, unit(np.mean(x, 0))) for i, c, x in rows if i // 3 % 5 == f] for f in (fold, (fold + 1) % 5))
        want = quality(q, g)
        assert got["mean", fold][:2] == pytest.approx((want[0], want[3]))
    some = {(r.method, r.fold_id): (r.r_at_1, r.r_at_10, r.map) for r in methods.fold_metrics(methods.cross_validate(samples, folds, 5, ["full", "vote"], CONFIG, wanted=[1, 3])).collect()}
    assert set(some) == {(m, f) for m in ("full", "vote") for f in (1, 3)}
    role = F.when(F.col("bucket") == 3, "query").when(F.col("bucket") == 4, "gallery").otherwise("train")
    for m in ("full", "vote"):
        one = ranking.summary(methods.evaluate_method(samples, folds.select("sample_id", "label", role.alias("role")), m, CONFIG)).first()
        assert some[m, 3] == pytest.approx((one.r_at_1, one.r_at_10, one.map))


def test_ablation_and_sweep_have_their_cells(tables_):
    _, samples, roles, _ = tables_
    stages = methods.ablation(samples, roles).orderBy("stage_order").collect()
    assert [r.component for r in stages] == list(methods.STAGES)
    for a, b in zip(stages, stages[1:]):
        assert b.incremental_delta_r_at_1 == pytest.approx(b.r_at_1 - a.r_at_1) and b.delta_r_at_10_vs_first == pytest.approx(b.r_at_10 - stages[0].r_at_10)
    cells = {(r.param_name, r.param_value): (r.r_at_1, r.map) for r in methods.sweep(samples, roles, {"sigma": [0.3, 1.0], "num_steps": [0]}, CONFIG).collect()}
    assert set(cells) == {("sigma", 0.3), ("sigma", 1.0), ("num_steps", 0.0)}
    want = ranking.summary(methods.evaluate_method(samples, roles, "full", kernel.Config(k=3, sigma=1.0))).first()
    assert cells["sigma", 1.0] == pytest.approx((want.r_at_1, want.map))


def test_ablation_is_one_evaluation(tables_, monkeypatch):
    """Its stages share the blocks, and one without queries has a row as well."""
    _, samples, roles, _ = tables_
    calls, evaluate = [], ranking.evaluate_blocks
    monkeypatch.setattr(ranking, "evaluate_blocks", lambda *a, **k: calls.append(k) or evaluate(*a, **k))
    stages = methods.ablation(samples, roles, CONFIG).orderBy("stage_order").collect()
    assert [k["groups"] for k in calls] == [(1, 2, 3, 4, 5)]
    for r in (stages[0], stages[4]):
        want = ranking.summary(methods.evaluate_method(samples, roles, r.component, CONFIG)).first()
        assert (r.num_queries, r.r_at_1, r.r_at_10, r.map) == pytest.approx((want.num_queries, want.r_at_1, want.r_at_10, want.map))
    none = methods.ablation(samples, roles.filter("role <> 'query'"), CONFIG).orderBy("stage_order").collect()
    assert [(r.component, r.num_queries, r.map) for r in none] == [(s, 0, None) for s in methods.STAGES]


def test_more_steps_never_raise_the_loss(tables_, spark):
    """A23."""
    from prismrank.plans import retrieval_queries

    rows = retrieval_queries.a23_optimizer_grid(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 9 and all(r.decrease_pct >= 0 for r in rows)
    by = {(r.num_steps, r.lr): r.final_loss for r in rows}
    assert all(by[7, lr] <= by[5, lr] <= by[3, lr] for lr in (0.005, 0.01, 0.02))


def test_attribution_equals_numpy(tables_):
    """G7."""
    rows, samples, _, side = tables_
    query = centroids(side["train"])
    asked = methods.condition(samples, samples.filter("sample_id % 5 > 2"))
    got = {r.sample_id: r.attribution for r in attribution.attribute(asked).collect()}
    assert len(got) == len(rows)
    for i, c, x in rows[:7]:
        e, q = np.array([x]), query[c][None]
        cos = (e[0] @ q[0]) / (np.linalg.norm(e[0], axis=1) * np.linalg.norm(q[0]))
        raw = kernel.softmax(cos[None] / 0.5)[0] * kernel.fiedler_weights(kernel.affinity(e, q, kernel.Config()))[0]
        assert got[i] == pytest.approx((raw - raw.min()) / (raw.max() - raw.min()), abs=1e-6)


def test_entry_points(tables_, spark):
    rows, samples, _, _ = tables_
    shared = [1.0, 0.0, 0.5, 0.0, 0.0]
    got = {r.sample_id: r for r in retrieval.retrieve_batch(samples, shared, CONFIG).collect()}
    for i, _, x in rows[:9]:
        want = kernel.pipeline(np.array([x]), np.array([shared]), CONFIG)
        assert np.allclose(got[i].fused, want["fused"][0]) and np.allclose(got[i].weights, want["weights"][0])
    fused = retrieval.retrieve(samples.withColumn("query", F.array(*[F.lit(v) for v in shared])), CONFIG)
    found = retrieval.search(fused.filter("sample_id < 4"), fused, 3).orderBy("query_id", "rank").collect()
    for q in range(4):
        order = sorted(got, key=lambda k: (-float(np.dot(got[q].fused, got[k].fused)), k))[:3]
        assert [r.gallery_id for r in found if r.query_id == q] == order and order[0] == q


def test_from_raw_images(spark):
    rng = np.random.default_rng(5)
    cubes = rng.uniform(size=(5, 6, 2, 3)).astype(np.float32)
    rows = spark.createDataFrame([(i, 2, 3, c.reshape(-1).tolist()) for i, c in enumerate(cubes)], "sample_id long, height int, width int, cube array<float>").repartition(2)
    weights = rng.normal(size=(6, 4))
    got = {r.sample_id: r for r in retrieval.retrieve_from_raw(rows, "a river", lambda: lambda some: np.array(some) @ weights, lambda text: [len(text), 1, 0, 2], 6, 4, CONFIG).collect()}
    q = unit([7.0, 1, 0, 2])
    for i, c in enumerate(cubes):
        e = (c.reshape(6, 6).astype(float) @ weights).astype(np.float32)
        e = e / np.linalg.norm(e, axis=1, keepdims=True)
        want = kernel.pipeline(e[None].astype(float), q[None], CONFIG)
        assert np.allclose(got[i].fused, want["fused"][0], atol=1e-4)


def test_labels_that_condition(spark):
    r = spark.createDataFrame([(["b", "a"], [0, 1, 1]), ([], [0, 0, 0])], "l array<string>, h array<int>").select(methods.first_label(F.col("l")).alias("a"), methods.strongest_label(F.col("h")).alias("b")).collect()
    assert [tuple(x) for x in r] == [("b", 1), (None, 0)]


def test_fusion_times_feed_the_report(tables_):
    _, samples, _, _ = tables_
    rows = methods.fusion_times(samples.limit(10).withColumn("query", graph.mean_fusion("bands")), ("mean", "full"), 2)
    got = {r.component: r for r in report.timing(rows, "component", "value").collect()}
    assert set(got) == {"mean", "full"} and rows.count() == 4 and all(r.median > 0 for r in got.values())


def test_order_by_names(spark):
    """G6."""
    df = spark.createDataFrame([("z", 1), ("full", 2), ("mean", 2), ("mean", 1), ("a", 0)], "method string, fold int")
    assert [tuple(r) for r in report.order_by_names(df, "method", ["mean", "full"], "fold", "none").collect()] == [("mean", 1), ("mean", 2), ("full", 2), ("a", 0), ("z", 1)]


def test_metadata_keeps_unknown_flags(spark, tmp_path):
    """S7, as F1."""
    rows = [(i, a, b) for i, (a, b) in enumerate([(False, False), (True, False), (False, True), (None, False), (None, None), (True, None)])]
    spark.createDataFrame(rows, "i int, contains_seasonal_snow boolean, contains_cloud_or_shadow boolean").write.parquet(f"{tmp_path}/m")
    assert sorted(r.i for r in tables.metadata(spark, f"{tmp_path}/m").collect()) == [0, 3, 4]


def test_subsets_and_batches(spark):
    """S15, P25."""
    rows = spark.createDataFrame([(i, f"p{i}") for i in range(11)], "sample_id long, path string")
    manifest = spark.createDataFrame([("train" if i < 7 else "test", i if i < 7 else i - 7, i, 0) for i in range(11)], "split string, split_position int, dataset_index long, label int")
    found = tables.subsets(rows, manifest)
    assert found["train"].count() == 7 and found["val"].count() == 0 and found["test"].columns == ["sample_id", "path", "split_position"]
    got = {r.batch: [x.path for x in r.rows] for r in tables.batches(found["train"], 3).collect()}
    assert got == {0: ["p0", "p1", "p2"], 1: ["p3", "p4", "p5"], 2: ["p6"]}
    assert tables.batches(found["train"], 3, drop_last=True).count() == 2


def test_texts_of_reports(spark):
    """K6."""
    bands = spark.createDataFrame([("B01", 0.25, 0.1), ("B02", 0.75, 0.0)], "band string, mean double, std double")
    assert sinks.contribution_text(bands).splitlines()[2:] == ["B02    0.7500 +/- 0.0000", "B01    0.2500 +/- 0.1000"]
    causes = spark.createDataFrame([("rare_class", 3, 75.0), ("cloud_cover", 1, 25.0)], "cause string, count long, percentage double")
    lines = sinks.failure_text(causes, 4, 40).splitlines()
    assert lines[0] == "Failures: 4 of 40 queries (10.0 %)" and lines[1].split() == ["cloud_cover", "1", "25.00", "%"]
    per = spark.createDataFrame([(1, p, m, 9) for p, m in enumerate((0.5, 0.2, 0.9))], "label int, band_pos int, mean double, n long")
    names = spark.createDataFrame([(0, "B01", "x"), (1, "B02", "x"), (2, "B03", "y")], "band_pos int, band string, spectral_group string")
    found = attribution.preferences(per, names, 2, explanations=spark.createDataFrame([(2, "other")], "label int, explanation string"))
    r = found.first()
    assert (r.top_bands, r.bottom_bands, r.dominant_region, r.n_samples) == ("B03, B01", "B01, B02", "y", 9) and r.top_scores == [0.9, 0.5] and "B03, B01" in r.explanation
    assert attribution.preferences(per, names, 2, explanations=spark.createDataFrame([(1, "because")], "label int, explanation string")).first().explanation == "because"
    assert "dominant region: y" in sinks.class_text(found)


def test_p_values_of_the_registered_tests(spark):
    """T-1, T-2, T-5: what the SQL leaves out, by numerical integration."""
    from prismrank.operators import stats

    def t_tail(t, freedom):
        x = np.linspace(0, abs(t), 200_001)
        f = (1 + x * x / freedom) ** (-(freedom + 1) / 2)
        from math import gamma, pi, sqrt

        area = ((f[1:] + f[:-1]) / 2 * np.diff(x)).sum() * gamma((freedom + 1) / 2) / (sqrt(freedom * pi) * gamma(freedom / 2))
        return 1 - 2 * area

    for t, freedom in ((0.5, 4), (2.1, 4), (-3.3, 9), (1.0, 1)):
        assert stats.t_tail(t, freedom) == pytest.approx(t_tail(t, freedom), abs=1e-7)
    rng = np.random.default_rng(2)
    folds = [(m, f, float(70 + k + rng.normal())) for k, m in enumerate(("A", "B", "C")) for f in range(5)]
    got = {r.compared_method: r for r in stats.paired_t_table(spark.createDataFrame(folds, "method string, fold_id int, r double"), "A", ["r"]).collect()}
    for m in "BC":
        d = np.array([x for k, _, x in folds if k == "A"]) - np.array([x for k, _, x in folds if k == m])
        want = t_tail(d.mean() / (d.std(ddof=1) / 5**0.5), 4)
        assert got[m].p_value == pytest.approx(want, abs=1e-6) and got[m].significant == (want < 0.05)


def test_text_scores_and_votes_do_not_depend_on_shards(spark, monkeypatch):
    rng = np.random.default_rng(6)
    image = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(9)], "image_id long, vec array<double>")
    train = spark.createDataFrame([(rng.normal(size=4).tolist(), [i % 3, (i + 1) % 3] if i % 4 else None) for i in range(30)], "vec array<double>, labels array<int>")
    texts = spark.createDataFrame([(c, rng.normal(size=4).tolist()) for c in range(4)], "class_id int, vec array<double>")
    found = []
    for shard in (8192, 7):
        deal = ranking.dealt
        monkeypatch.setattr(ranking, "dealt", lambda q, g, w, s, shard_rows=0, block_rows=0, n=shard, deal=deal: deal(q, g, w, s, n, 4))
        found.append({(r.image_id, r.class_id): r.score for r in scoring.multi_label_scores(image, train, texts).collect()})
        monkeypatch.setattr(ranking, "dealt", deal)
    assert len(found[0]) == 36 and found[0] == pytest.approx(found[1])


def test_images_of_bands_reach_the_encoder(spark):
    cubes = spark.createDataFrame([(1, 1, 2, [1.0, 2.0, 3.0, 4.0])], "sample_id long, height int, width int, cube array<float>")
    got = retrieval.encode_bands(cubes, lambda: lambda some: np.array(some), 2, 2).first().bands
    assert np.allclose(got, [unit([1, 2]), unit([3, 4])]) and images.pixel_rows(cubes, 2).count() == 2
