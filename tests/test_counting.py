"""Ranks by counting, one pass over alphas and grids, and generated fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismrank.operators import kernel, ranking, scoring
from prismrank.plans import methods
from prismrank.sources import generated


@pytest.fixture(scope="module")
def sides(spark):
    """Generated vectors, rounded so that many scores are equal."""
    rows = generated.samples(spark, 240, 2, 3, classes=5).withColumn("vec", F.transform(F.flatten("bands"), lambda x: F.round(x, 0)))
    q = rows.filter("sample_id % 6 = 0").select(F.col("sample_id").alias("query_id"), F.when(F.col("sample_id") > 200, None).otherwise(F.col("label")).alias("query_label"), F.col("vec").alias("query_vec"))
    g = rows.filter("sample_id % 6 <> 0").select(F.col("sample_id").alias("gallery_id"), F.col("label").alias("gallery_label"), F.col("vec").alias("gallery_vec"))
    return q.cache(), g.cache()


def by_id(df, *more):
    return {tuple(r[c] for c in (*more, "query_id")): (r.num_gallery, r.num_relevant, pytest.approx(r.ap), r.first_hit_rank, r.hit_at_1, r.found_at_5, r.found_at_10, r.top1_gallery_id, pytest.approx(r.top1_score)) for r in df.collect()}


def test_counts_of_shards_equal_the_window_route(spark, sides, monkeypatch):
    q, g = sides
    want = {(r.query_id,): (r.num_gallery, r.num_relevant, r.ap, r.first_hit_rank, r.hit_at_1, r.found_at_5, r.found_at_10, r.top1_gallery_id, r.top1_score) for r in ranking.evaluate(q, g).collect()}
    assert by_id(ranking.evaluate_blocks(q, g)) == want
    assert by_id(ranking.evaluate_blocks(q, g, shard_rows=7, block_rows=3)) == want
    monkeypatch.setattr(ranking, "FEW_TIES", 0)
    monkeypatch.setattr(ranking, "RELEVANT", 5)  # a query's relevant rows in several turns
    monkeypatch.setattr(ranking, "TOGETHER", 1)
    assert by_id(ranking.evaluate_blocks(q, g, shard_rows=20, block_rows=16)) == want


def test_no_scores_of_a_gallery_travel(sides):
    """What leaves a shard's task is as long as its relevant rows."""
    q, g = sides
    how = ranking.Scoring(("query_id",), "dot", False, None)
    a, b = (df.toArrow() for df in (q, g.withColumn("__shard", F.lit(0))))
    head = ["query_id", "query_label"]
    kinds = "query_id long, query_label int, mix int, shard int, rows long, top1_gallery_id long, top1_score double, relevant long, sims binary, ids binary"
    out = ranking._relevant(a, b, how, head, ranking.to_arrow_schema(ranking._parse_datatype_string(kinds)))
    assert out.num_rows == a.num_rows
    for n, sims, ids in zip(out["relevant"].to_pylist(), out["sims"].to_pylist(), out["ids"].to_pylist()):
        assert len(sims) == len(ids) == 8 * n < 8 * b.num_rows / 2


def test_rows_above_counts_ties_by_id():
    rng = np.random.default_rng(3)
    for few in (0, 16):
        ranking.FEW_TIES, held = few, ranking.FEW_TIES
        for _ in range(20):
            sims, ids = rng.integers(0, 6, 30).astype(float), np.sort(rng.choice(90, 30, replace=False))
            at, own = rng.integers(0, 7, 12).astype(float), rng.integers(0, 90, 12)
            want = [sum((s > x) or (s == x and i < o) for s, i in zip(sims, ids)) for x, o in zip(at, own)]
            assert ranking.rows_above(sims, ids, at, own).tolist() == want
        ranking.FEW_TIES = held
    assert ranking.rows_above(np.zeros(0), np.zeros(0, int), np.ones(2), np.ones(2, int)).tolist() == [0, 0]


def test_mixes_of_shards_equal_one_shard(sides):
    q, g = sides
    edges = scoring.gallery_graph(g, 4)
    one = scoring.spread(g, edges)
    mixes = (0.0, 0.3, 1.0)
    a = by_id(ranking.evaluate_blocks(q, one, mixes=mixes), "mix")
    b = by_id(ranking.evaluate_blocks(q, one, mixes=mixes, shard_rows=50), "mix")
    assert len(a) == 3 * q.count() and {k: (v[0], v[1]) for k, v in a.items()} == {k: (v[0], v[1]) for k, v in b.items()}
    # sums of floats may differ in the last place, and so may ranks of near ties
    assert np.mean([x[2].expected for x in a.values()]) == pytest.approx(np.mean([x[2].expected for x in b.values()]), abs=1e-3)
    for k, alpha in enumerate(mixes):
        alone = by_id(ranking.evaluate_blocks(q, scoring.propagated(g, edges, alpha)))
        assert np.mean([v[2].expected for v in alone.values()]) == pytest.approx(np.mean([v[2].expected for key, v in a.items() if key[0] == k]), abs=1e-3)


def test_groups_of_different_sizes(sides):
    q, g = sides
    by = lambda df, c: df.withColumn("fold", F.when(F.col(c) < 60, 0).otherwise(1))
    both = ranking.evaluate_blocks(by(q, "query_id"), by(g, "gallery_id"), by=("fold",), shard_rows=30)
    got = by_id(both, "fold")
    for fold, where in ((0, "{} < 60"), (1, "{} >= 60")):
        want = by_id(ranking.evaluate(q.filter(where.format("query_id")), g.filter(where.format("gallery_id"))))
        assert {k[1:]: v for k, v in got.items() if k[0] == fold} == {k: tuple(x.expected if hasattr(x, "expected") else x for x in v) for k, v in want.items()}


def noting(folder):
    """Passes rows on, and leaves their numbers in files."""

    def run(batches):
        import os
        import uuid

        for b in batches:
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                f.write(str(b.num_rows))
            yield b

    return run


def noted(path):
    return sum(int(f.read_text()) for f in path.iterdir())


def test_a_grid_runs_the_kernel_once(spark, tmp_path, monkeypatch):
    """Each sample of either side enters the kernel once for all cells, and no
    job before the evaluation runs it."""
    run, folder = kernel.run, str(tmp_path)
    monkeypatch.setattr(kernel, "run", lambda some, configs: run(some.mapInArrow(noting(folder), some.schema), configs))
    rows = generated.samples(spark, 60, 5, 4, classes=3)
    role = rows.select("sample_id", "label", F.expr("CASE WHEN sample_id % 5 = 0 THEN 'query' WHEN sample_id % 5 < 3 THEN 'gallery' ELSE 'train' END").alias("role"))
    got = methods.sweep(rows, role, {"sigma": [0.3, 0.5], "num_steps": [1, 5, 7]}).collect()
    assert len(got) == 5 and {r.num_queries for r in got} == {12}
    assert noted(tmp_path) == 12 + 24
    for r in got:
        alone = ranking.summary(methods.evaluate_method(rows, role, "full", kernel.Config(k=3, **{r.param_name: int(r.param_value) if r.param_name == "num_steps" else r.param_value}))).first()
        assert r.map == pytest.approx(alone["map"]) and r.r_at_1 == alone.r_at_1


def test_all_alphas_build_the_graph_once(spark, sides, tmp_path):
    q, g = sides
    edges = scoring.gallery_graph(g, 4)
    schema = "src_id long, dst_id long, weight double"
    found = scoring.search_alpha(q, g, edges.mapInArrow(noting(str(tmp_path)), schema), [0.0, 0.3, 0.7]).collect()
    assert len(found) == 3 and sum(r.best for r in found) == 1
    assert noted(tmp_path) == edges.count()
    with pytest.raises(ValueError):
        scoring.search_alpha(q, g, edges, [0.5, 1.5])


def test_generated_rows_do_not_depend_on_partitions(spark):
    a, b = ([tuple(r) for r in generated.samples(spark, 50, 3, 4, partitions=p).orderBy("sample_id").collect()] for p in (1, 7))
    assert a == b and len({r[1] for r in a}) > 1
    x = np.array([r[2] for r in generated.samples(spark, 400, 4, 16, classes=1, spread=1.0).collect()])
    noise = x - x.mean(0)
    assert abs(noise.std() - 1) < 0.05 and abs(noise.mean()) < 1e-9 and np.isfinite(x).all()
    assert generated.samples(spark, 20, 2, 2, seed=1).collect() != generated.samples(spark, 20, 2, 2, seed=2).collect()
    patches = generated.patches(spark, 12, [["A"], ["B", "C"]], {"B02": 10, "B05": 20, "B01": 60})
    assert patches.count() == 36
    one = patches.filter("patch_id = 'T33_0_1' AND band = 'B05'").first()
    assert len(one.image) == 3600 and one.labels == ["B", "C"] and 250 <= min(one.image) and max(one.image) <= 5500
    shares = generated.roles(generated.samples(spark, 1000, 1, 1)).groupBy("role").count().collect()
    assert {r.role: round(r["count"] / 1000, 1) for r in shares} == {"query": 0.2, "gallery": 0.4, "train": 0.4}
