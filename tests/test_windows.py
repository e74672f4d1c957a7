"""Window filters at large kernel sizes on images of many tiles, against plain numpy."""

import numpy as np
import pytest
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import functions as F

from quarry.operators import raster as RA
from quarry.operators import windows as WI

PAD = {"replicate": "edge", "reflect101": "reflect", "reflect": "symmetric"}


def stitched(spark, rows=37, cols=33):
    """An image laid out of the 8 × 8 channels of the embeddings table."""
    from conftest import SMALL
    e = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").select("embedding").collect()
    t = [np.clip(np.floor((np.array(x[0], float) + 0.6) * 212.5), 0, 255).reshape(8, 8) for x in e]
    return np.block([[t[(i * cols + j) % len(t)] for j in range(cols)] for i in range(rows)])[:-3, :-5]


def frame(spark, images):
    rows = [(k, 0, y, x, int(v)) for k, m in enumerate(images) for (y, x), v in np.ndenumerate(m)]
    return spark.createDataFrame(rows, "img bigint, ch int, y int, x int, v int")


def pixels(df, images):
    out = [np.full(m.shape, np.nan) for m in images]
    n = 0
    for r in df.collect():
        out[r.img][r.y, r.x] = r.v
        n += 1
    assert n == sum(m.size for m in images)
    return out


@pytest.fixture(scope="module")
def images(spark):
    return [stitched(spark), np.arange(35.0).reshape(5, 7) % 11, np.array([[7.0]])]


@pytest.fixture(scope="module")
def df(spark, images):
    return frame(spark, images).repartition(8).persist()


def test_adaptive_mean_at_199(df, images):
    got = pixels(RA.adaptive_threshold(df, 199, 5.0, "mean"), images)
    for g, m in zip(got, images):
        p = np.pad(m, 99, mode="edge")
        mean = np.array([[w.sum() for w in line] for line in sliding_window_view(p, (199, 199))]) / (199.0 * 199) \
            if m.size < 100 else WI.box(p, 199) / (199.0 * 199)
        assert (g == np.where(m > mean - 5.0, 255, 0)).all()
    p = np.pad(images[0], 99, mode="edge")  # the sums themselves, at some places
    s = WI.box(p, 199)
    for y, x in ((0, 0), (100, 37), (292, 258)):
        assert s[y, x] == p[y: y + 199, x: x + 199].sum()


def test_median_at_11(df, images):
    out = RA.median_blur(df, 11)
    assert dict(out.dtypes)["v"] == "int"
    for g, m in zip(pixels(out, images), images):
        w = sliding_window_view(np.pad(m, 5, mode="edge"), (11, 11))
        assert (g == np.median(w, axis=(2, 3))).all()


@pytest.mark.parametrize("kind, radius, times", [("dilate", 1, 2), ("erode", 7, 3), ("dilate", 60, 1)])
def test_extrema(df, images, kind, radius, times):
    r = radius * times
    fill = np.inf if kind == "erode" else -np.inf
    for g, m in zip(pixels(RA.morph(df, kind, radius, times), images), images):
        a = np.pad(m, r, constant_values=fill)
        for axis in (0, 1):
            w = sliding_window_view(a, 2 * r + 1, axis=axis)
            a = w.min(-1) if kind == "erode" else w.max(-1)
        assert (g == a).all()


@pytest.mark.parametrize("border", sorted(PAD))
@pytest.mark.parametrize("tile", [None, 16])
def test_sums_at_every_border(df, images, border, tile):
    got = pixels(WI.windowed(df, "sum", 4, border, tile), images)
    for g, m in zip(got, images):
        j = [WI.mapped(np.arange(-4, n + 4), n, border) for n in m.shape]
        a = m[np.ix_(*j)]
        if min(m.shape) > 4:
            assert (a == np.pad(m, 4, mode=PAD[border])).all()
        assert (g == sliding_window_view(a, (9, 9)).sum(axis=(2, 3))).all()


def test_real_values_and_no_rows(spark):
    d = spark.createDataFrame([(1, 0, 0, 0, 0.5), (1, 0, 0, 1, -2.25), (1, 0, 0, 2, 7.0)], "img bigint, ch int, y int, x int, v double")
    got = sorted((r.x, r.v) for r in RA.median_blur(d, 3).collect())
    assert got == [(0, 0.5), (1, 0.5), (2, 7.0)]
    assert sorted((r.x, r.v) for r in RA.morph(d, "erode", 1).collect()) == [(0, -2.25), (1, -2.25), (2, -2.25)]
    assert RA.median_blur(d.filter(F.col("img") > 9), 3).count() == 0
