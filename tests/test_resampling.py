import numpy as np
import pytest
from pyspark.errors import PySparkException

from prismrank.operators import resample

CUBES = "sample_id long, height int, width int, cube array<double>"


def by_hand(x, height, width, corners):
    """Bilinear interpolation, one output cell after the other."""
    h, w = x.shape
    out = np.zeros((height, width))
    for i in range(height):
        for j in range(width):
            at = []
            for o, n, to in ((i, h, height), (j, w, width)):
                p = (o * (n - 1) / (to - 1) if to > 1 else 0.0) if corners else min(max((o + 0.5) * n / to - 0.5, 0), n - 1)
                a = min(int(p), n - 1)
                at.append((a, min(a + 1, n - 1), p - a))
            (a, b, u), (c, d, v) = at
            out[i, j] = (1 - u) * ((1 - v) * x[a, c] + v * x[a, d]) + u * ((1 - v) * x[b, c] + v * x[b, d])
    return out


@pytest.mark.parametrize("corners", [False, True])
def test_resampling_equals_interpolation_by_hand(spark, corners):
    rng = np.random.default_rng(1)
    cubes = {i: rng.random((2, h, w)) for i, (h, w) in enumerate([(4, 4), (3, 7), (1, 5), (12, 12), (1, 1), (20, 6)])}
    rows = [(i, *x.shape[1:], x.reshape(-1).tolist()) for i, x in cubes.items()] + [(99, 2, 2, None)]
    got = {r.sample_id: r for r in resample.resampled(spark.createDataFrame(rows, CUBES).repartition(3), 6, 9, corners).collect()}
    assert got[99].cube is None and len(got) == 7
    for i, x in cubes.items():
        assert (got[i].height, got[i].width) == (6, 9)
        assert np.allclose(np.array(got[i].cube).reshape(2, 6, 9), [by_hand(b, 6, 9, corners) for b in x])
    bad = spark.createDataFrame([(1, 2, 2, [1.0] * 5)], CUBES)
    with pytest.raises(PySparkException):
        resample.resampled(bad, 4).collect()


def test_bands_of_three_resolutions_are_stacked(spark):
    rng = np.random.default_rng(2)
    sizes = {"B01": 2, "B02": 12, "B05": 6}
    files = {(p, b): (rng.random((n, n)) * 20000).astype(np.float32) for p in (1, 2) for b, n in sizes.items()}
    reader = lambda data: np.frombuffer(data, np.float32).reshape(int((len(data) / 4) ** 0.5), -1)
    rows = spark.createDataFrame([(p, b, bytearray(x.tobytes())) for (p, b), x in files.items()] + [(1, "B99", bytearray(b"xx"))], "sample_id long, band string, content binary").repartition(4)
    got = resample.stacked(rows, reader, ("B02", "B01", "B05"), 12).collect()
    assert len(got) == 2
    for r in got:
        want = [np.clip(by_hand(files[r.sample_id, b], 12, 12, True) / 10000, 0, 1) for b in ("B02", "B01", "B05")]
        assert np.allclose(np.array(r.cube).reshape(3, 12, 12), want, atol=1e-5)
    with pytest.raises(PySparkException, match="patch 2"):
        resample.stacked(rows.filter("NOT (sample_id = 2 AND band = 'B01')"), reader, ("B02", "B01", "B05"), 12).collect()


def test_encoder_input_equals_numpy(spark):
    rng = np.random.default_rng(3)
    cubes = {1: rng.random((2, 5, 5)), 2: rng.random((2, 5, 5)) * 12000 - 100}
    rows = spark.createDataFrame([(i, 5, 5, x.reshape(-1).tolist()) for i, x in cubes.items()], CUBES)
    got = resample.for_encoder(rows, 7).collect()
    assert sorted((r.sample_id, r.band_pos) for r in got) == [(1, 0), (1, 1), (2, 0), (2, 1)]
    for r in got:
        x = cubes[r.sample_id]
        band = by_hand(np.clip(x / (10000 if x.max() > 1 else 1), 0, 1)[r.band_pos], 7, 7, False)
        want = [(band - m) / s for m, s in zip(resample.ENCODER_MEAN, resample.ENCODER_STD)]
        assert np.allclose(np.array(r.cube).reshape(3, 7, 7), want)


def test_bands_of_a_cube(spark):
    x = np.arange(5 * 2 * 3, dtype=float).reshape(5, 2, 3)
    rows = spark.createDataFrame([(1, 2, 3, x.reshape(-1).tolist())], CUBES)
    assert resample.select_bands(rows, (3, 2, 1)).first().cube == x[[3, 2, 1]].reshape(-1).tolist()
    with pytest.raises(PySparkException, match="lacks"):
        resample.select_bands(rows, (3, 5)).collect()
    each = resample.replicated(rows).orderBy("band_pos").collect()
    assert [r.cube for r in each] == [np.repeat(x[[b]], 3, 0).reshape(-1).tolist() for b in range(5)]


def test_pooled_tokens_have_unit_length(spark):
    from prismrank.operators import pixels

    x = np.random.default_rng(6).normal(size=(14, 14, 5))
    rows = spark.createDataFrame([(1, i, j, k, float(x[i, j, k])) for i in range(14) for j in range(14) for k in range(5)], "sample_id long, y int, x int, d int, value double")
    got = {(r.oy, r.ox, r.d): r.value for r in pixels.pool_tokens(rows, 14, 4, True).collect()}
    want = np.stack([by_hand(x[:, :, k], 4, 4, False) for k in range(5)], 2)
    want = want / np.linalg.norm(want, axis=2, keepdims=True)
    assert len(got) == 80 and all(got[i, j, k] == pytest.approx(want[i, j, k]) for i, j, k in got)
