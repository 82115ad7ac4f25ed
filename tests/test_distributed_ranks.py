"""Splits, percentiles and components that no task holds as a whole."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismrank.operators import pixels, split
from prismrank.sources import cache

ROWS = [(i, None if i % 11 == 0 else i % 3 if i % 2 else 0) for i in range(400)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "sample_id long, label int").repartition(5)


def in_order(label):
    return sorted((i for i, c in ROWS if c == label), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))


def test_ranks_equal_a_sort_of_each_class(rows):
    got = {(r.label, r["__r"]): (r.sample_id, r["__n"]) for r in split.placed(rows, ["label"], "sample_id", 42).collect()}
    assert len(got) == 400
    for label in (None, 0, 1, 2):
        order = in_order(label)
        assert [got[label, k + 1] for k in range(len(order))] == [(i, len(order)) for i in order]


def test_buckets_hold_many_rows_too(rows, monkeypatch):
    monkeypatch.setattr(split, "DIGITS", 1)
    got = {(r.label, r["__r"]): r.sample_id for r in split.placed(rows, ["label"], "sample_id", 42).collect()}
    assert all(got[label, k + 1] == i for label in (None, 0, 1, 2) for k, i in enumerate(in_order(label)))


def test_splits_folds_and_subsets(rows, monkeypatch):
    folds = {r.sample_id: r.bucket for r in split.stratified_folds(rows, 7).collect()}
    parts = {r.sample_id: r.split for r in split.stratified_split(rows, 0.6, 0.3, 0.1).collect()}
    for label in (None, 0, 1, 2):
        order = in_order(label)
        assert [folds[i] for i in order] == [k for k, ids in enumerate(np.array_split(order, 7)) for _ in ids]
        a, b = int(len(order) * 0.6), int(len(order) * 0.3)
        assert [parts[i] for i in order] == ["train"] * a + ["val"] * b + ["test"] * (len(order) - a - b)
    few = split.stratified_folds(rows.filter("sample_id < 4"), 5)
    assert few.count() == 4 and {r.bucket for r in few.filter("label = 0").collect()} <= {0, 1, 2, 3}
    want = {most: {(r.sample_id, r.split) for r in split.subset_split(rows, most, 30, 60).collect()} for most in (None, 100)}
    monkeypatch.setattr(split, "FEW", 0)
    for most, some in want.items():
        assert {(r.sample_id, r.split) for r in split.subset_split(rows, most, 30, 60).collect()} == some
    assert len(want[None]) == 400 and len(want[100]) == 100


def test_positions_by_id(rows):
    some = rows.withColumn("split", F.when(F.col("sample_id") % 7 == 0, "val").otherwise("train"))
    got = {(r.split, r.split_position): r.dataset_index for r in split.split_manifest(some).collect()}
    for name, ids in (("val", range(0, 400, 7)), ("train", [i for i in range(400) if i % 7])):
        assert [got[name, k] for k in range(len(ids))] == list(ids)


def test_percentiles_of_large_groups_are_exact(spark):
    rng = np.random.default_rng(4)
    groups = {"normal": rng.normal(size=3000), "skewed": np.exp(rng.normal(size=2500) * 9), "equal": np.full(1500, 2.5), "two": np.repeat([1.0, -1e308], 900), "few": rng.normal(size=12), "huge": np.r_[rng.normal(size=900), 1.7e308, -1.7e308], None: rng.integers(0, 3, 1200).astype(float)}
    rows = spark.createDataFrame([(k, float(v)) for k, x in groups.items() for v in x] + [("few", None), ("few", float("nan"))], "g string, v double").repartition(4)
    shares = [0.0, 0.02, 0.5, 0.98, 1.0]
    got = {r.g: r["__q"] for r in pixels.percentiles(rows, "v", shares, ["g"], held=100, bins=16).collect()}
    assert got.keys() == groups.keys()
    for k, x in groups.items():
        assert got[k] == pytest.approx(np.quantile(x, shares).tolist(), rel=1e-12), k
    whole = pixels.percentiles(rows.filter("g = 'normal'"), "v", shares, [], held=100, bins=8).first()["__q"]
    assert whole == pytest.approx(np.quantile(groups["normal"], shares).tolist())
    a, b = ({(r.g, r.v): r.stretched for r in pixels.stretch(rows.filter("g IN ('normal', 'skewed')"), "v", ["g"], held=h).collect()} for h in (50, 10**6))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_components_of_each_image_equal_numpy(spark):
    rng = np.random.default_rng(5)
    images = {1: rng.normal(size=(50, 4)) @ rng.normal(size=(4, 4)) + 1000, 2: rng.random((9, 4)), 3: rng.random((1, 4)), None: rng.random((30, 4)) * [1, 5, 9, 2]}
    names = ["a", "b", "c", "d"]
    rows = spark.createDataFrame([(i, k, *map(float, p)) for i, x in images.items() for k, p in enumerate(x)], "image int, pixel_id int, a double, b double, c double, d double").repartition(5)
    got = {(r.image, r.pixel_id): (r.pc1, r.pc2) for r in pixels.image_pca(rows, "image", names, 2).collect()}
    assert len(got) == sum(map(len, images.values()))
    for i, x in images.items():
        y = x - x.mean(0)
        w = np.linalg.eigh(y.T @ y / max(len(x) - 1, 1))[1][:, ::-1][:, :2]
        w = w * np.sign(w[np.abs(w).argmax(0), [0, 1]])
        p = y @ w
        want = np.clip((p - p.min(0)) / (np.ptp(p, axis=0) + 1e-6), 0, 1)
        assert np.allclose([got[i, k] for k in range(len(x))], want, atol=1e-6)


def test_a_cache_encodes_what_it_lacks(spark, tmp_path):
    path, log = str(tmp_path / "cache"), tmp_path / "log"
    log.mkdir()
    folder = str(log)

    def encode(some):
        def run(batches):
            import os
            import uuid

            import pyarrow as pa

            for b in batches:
                if b.num_rows:
                    with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                        f.write(str(b.num_rows))
                yield pa.RecordBatch.from_arrays([b["sample_id"], b["content_hash"], pa.array([[float(len(x or ""))] for x in b["image"].to_pylist()])], names=["sample_id", "content_hash", "vec"])

        return some.mapInArrow(run, "sample_id long, content_hash string, vec array<double>")

    def encoded():
        n = sum(int(f.read_text()) for f in log.iterdir())
        for f in log.iterdir():
            f.unlink()
        return n

    def images(pairs):
        return spark.createDataFrame(pairs, "sample_id long, image string").repartition(3)

    first = [(i, "x" * i) for i in range(100)] + [(None, "null"), (7, "x" * 7)]
    got = cache.extend(images(first), path, 1, "train", encode, ["image"])
    assert got.count() == 101 and encoded() == 101
    more = first + [(i, "y" * i) for i in range(100, 110)]  # a tenth is new
    got = cache.extend(images(more), path, 1, "train", encode, ["image"])
    assert got.count() == 111 and encoded() == 10
    changed = [(i, "z" * 500 if i < 3 else x) for i, x in more if i is not None] + [(200, None)]
    got = cache.extend(images(changed), path, 1, "train", encode, ["image"])
    assert encoded() == 4 and got.count() == 111
    assert {r.sample_id: r.vec for r in got.collect()}[1] == [500.0]
    assert cache.extend(images(changed), path, 1, "train", encode, ["image"]).count() == 111 and encoded() == 0
    assert cache.extend(images(changed), path, 2, "train", encode, ["image"]).count() == 111 and encoded() == 111  # another seed
    cache.prune(spark, path, 1, "train", images(changed), str(tmp_path / "small"), ["image"])
    assert spark.read.parquet(str(tmp_path / "small")).count() == 111
