import numpy as np
import pytest
from pyspark.sql import functions as F

from prismrank.functions import vectors as V
from prismrank.operators import graph, kernel


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def lit(x):
    return F.lit(x) if not isinstance(x, list) else F.array(*[lit(v) for v in x])


def test_hand_computed_values(spark):
    bands, q = lit([[1.0, 0.0], [0.0, 1.0]]), lit([1.0, 0.0])
    w = graph.query_weights(bands, q, 0.5)
    r = one(spark, w.alias("w"), V.entropy(w).alias("h"), graph.fuse(bands, w).alias("f"), V.min_max(lit([0.1, 0.2, 0.7])).alias("m"), V.min_max(lit([2.0, 2.0, 2.0, 2.0])).alias("c"))
    assert r.w == pytest.approx([0.880797, 0.119203], abs=1e-6) and r.h == pytest.approx(0.365334, abs=1e-6)
    assert r.f == pytest.approx([0.990966, 0.134113], abs=1e-6)
    assert r.m == pytest.approx([0, 1 / 6, 1]) and r.c == [0.25] * 4


def test_zero_vectors_have_no_direction(spark):
    r = one(spark, V.l2_normalize(lit([0.0, 0.0])).alias("z"), V.cosine(lit([0.0, 0.0]), lit([1.0, 0.0])).alias("c"))
    assert r.z == [0.0, 0.0] and r.c == 0.0


def cube(n=6, b=8, d=5, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, b, d)), rng.normal(size=(n, d))


@pytest.mark.parametrize("tau", [None, 0.2])
def test_expressions_equal_the_kernel(spark, tau):
    e, q = cube()
    rows = spark.createDataFrame([(i, e[i].tolist(), q[i].tolist()) for i in range(len(e))], "sample_id long, bands array<array<double>>, query array<double>")
    a = graph.affinity("bands", "query", tau=tau)
    got = rows.select("sample_id", a.alias("a"), graph.knn("bands", 3).alias("k")).orderBy("sample_id").collect()
    want = kernel.affinity(e, q, kernel.Config(tau=tau))
    assert np.allclose([r.a for r in got], want, atol=1e-12)
    assert np.allclose(want, want.transpose(0, 2, 1))
    counts = np.zeros(e.shape[:2])
    for i, r in enumerate(got):
        for b, near in enumerate(r.k):
            assert b not in [s.j for s in near] and [s.d for s in near] == sorted(s.d for s in near)
            for s in near:
                counts[i, s.j] += 1
    assert (counts == kernel.neighbour_counts(e, 3)).all()
    for normalized in (True, False):
        lap = rows.withColumn("a", a).select("sample_id", graph.laplacian("a", normalized).alias("l")).orderBy("sample_id").collect()
        assert np.allclose([r.l for r in lap], kernel.laplacian(want, normalized), atol=1e-12)


def test_as_many_neighbours_as_bands_is_an_error(spark):
    e, _ = cube()
    with pytest.raises(ValueError):
        kernel.neighbour_counts(e, 8)
    assert kernel.neighbour_counts(e, 7).sum() == 6 * 8 * 7
    with pytest.raises(Exception, match="needs more than"):
        one(spark, graph.knn(lit([[1.0], [2.0]]), 2).alias("k"))


def test_fiedler_of_a_path():
    path = np.array([[[0, 1, 0], [1, 0, 1], [0, 1, 0]]], float)
    for normalized, spectrum in ((True, [0, 1, 2]), (False, [0, 1, 3])):
        values, _ = kernel.fiedler(path, normalized)
        assert np.allclose(values[0], spectrum)
        assert np.allclose(kernel.fiedler_weights(path, normalized)[0], [0.5, 0, 0.5])


def test_fiedler_separates_two_clusters_and_meets_its_definition():
    a = np.full((13, 13), 0.1)
    a[:6, :6] = a[6:, 6:] = 0.9
    np.fill_diagonal(a, 1.0)
    _, v = kernel.fiedler(a[None])
    assert len(set(np.sign(v[0, :6]))) == 1 and (np.sign(v[0, :6])[0] != np.sign(v[0, 6:])).all()
    rng = np.random.default_rng(4)
    m = rng.uniform(size=(20, 9, 9))
    m = m + m.transpose(0, 2, 1)
    for normalized in (True, False):
        p = kernel.fiedler_properties(m, normalized)
        assert p["residual"].max() < 1e-9 and p["orthogonality"].max() < 1e-9 and np.allclose(p["norm"], 1)
        assert np.allclose(kernel.fiedler_weights(m, normalized).sum(1), 1)


def test_weights_of_a_graph_that_falls_apart_do_not_depend_on_the_solver():
    """Three parts without a link: any vectors of the plane of zero could come
    out; the weights are those of their projection."""
    a = np.zeros((1, 7, 7))
    for part in ([0, 1], [2, 3, 4], [5, 6]):
        a[0, np.ix_(part, part)[0], np.ix_(part, part)[1]] = np.random.default_rng(len(part)).uniform(0.5, 1)
    d = a[0].sum(1)
    plane = np.stack([np.sqrt(d) * np.isin(np.arange(7), p) for p in ([0, 1], [2, 3, 4], [5, 6])], 1)
    plane = plane / np.linalg.norm(plane, axis=0)
    t = np.sqrt(d) / np.linalg.norm(np.sqrt(d))
    w = np.sqrt(np.maximum((plane**2).sum(1) - t**2, 0))
    assert np.allclose(kernel.fiedler_weights(a)[0], w / w.sum())
    turned = np.random.default_rng(1).permutation(7)
    assert np.allclose(kernel.fiedler_weights(a[:, turned][:, :, turned])[0], (w / w.sum())[turned])
    p = kernel.fiedler_properties(a)
    assert p["orthogonality"].max() < 1e-9 and p["gap"].max() < 1e-9 and p["lambda_2"].max() < 1e-9


def slow_refine(e, w, c):
    """One sample, step by step, with numeric gradients of the plain loss."""
    x = np.log(np.maximum(w, 1e-8))
    d = np.linalg.norm(e[:, None] - e[None], axis=2)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, : c.k]

    def loss(z):
        p = kernel.softmax(z)
        f = p @ e
        return c.lambda_m * np.mean([np.mean([np.linalg.norm(f - e[j]) for j in row]) for row in near])

    m, v, history = np.zeros_like(x), np.zeros_like(x), []
    for t in range(c.num_steps):
        history.append(loss(x))
        g = np.array([(loss(x + h) - loss(x - h)) / 2e-6 for h in np.eye(len(x)) * 1e-6])
        g = g * min(1.0, c.grad_clip / (np.linalg.norm(g) + 1e-6))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - c.lr * (m / (1 - 0.9 ** (t + 1))) / (np.sqrt(v / (1 - 0.999 ** (t + 1))) + 1e-8)
        if t and abs(history[-2] - history[-1]) < c.early_stop_tol:
            break
    return kernel.softmax(x), history


@pytest.mark.parametrize("tol", [1e-6, 1e-3])
def test_refinement_equals_a_plain_optimizer(tol):
    e, q = cube(5)
    c = kernel.Config(k=3, early_stop_tol=tol, num_steps=6)
    w = kernel.fiedler_weights(kernel.affinity(e, q, c))
    got, losses, steps = kernel.refine(e, w, c)
    for i in range(len(e)):
        want, history = slow_refine(e[i], w[i], c)
        assert steps[i] == len(history) and np.allclose(losses[i, : steps[i]], history, atol=1e-10)
        assert np.allclose(got[i], want, atol=1e-5)
        assert history[-1] <= history[0] + 1e-12
    assert np.allclose(got.sum(1), 1)


def test_no_steps_leave_the_weights():
    e, q = cube(3)
    r = kernel.pipeline(e, q, kernel.Config(k=3, num_steps=0))
    assert np.allclose(r["weights"], r["initial_weights"]) and r["losses"].shape == (3, 0) and not r["steps"].any()


def test_kernel_on_rows_of_different_shapes(spark):
    a, qa = cube(3, 8, 5)
    b, qb = cube(2, 6, 4, 1)
    rows = [(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate([*zip(a, qa), *zip(b, qb)])]
    df = spark.createDataFrame(rows, "sample_id long, bands array<array<double>>, query array<double>")
    configs = [kernel.Config(k=3), kernel.Config(k=2, num_steps=0)]
    for k in (1, 4):
        got = {(r.sample_id, r.config): r for r in kernel.run(df.repartition(k), configs).collect()}
        assert len(got) == 10
        for n, c in enumerate(configs):
            for at, (e, q) in ((0, (a, qa)), (3, (b, qb))):
                want = kernel.pipeline(e, q, c)
                for i in range(len(e)):
                    assert np.allclose(got[at + i, n].fused, want["fused"][i]) and np.isclose(np.linalg.norm(got[at + i, n].fused), 1)
    assert kernel.run(df.limit(0), configs).count() == 0


def test_bad_parameters():
    for bad in ({"sigma": 0}, {"tau": -1.0}, {"k": 0}, {"num_steps": -1}):
        with pytest.raises(ValueError):
            kernel.Config(**bad)
