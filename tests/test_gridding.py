"""Gridded transforms against direct ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringelake.operators import gridding, imaging, simulation

PIXEL = 1e-10


def table(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(float(a), float(b), float(c), float(d), float(s)) for a, b, c, d, s in zip(*rng.uniform(-3e9, 3e9, (2, n)), *rng.normal(size=(2, n)), rng.uniform(0.1, 1, n), strict=True)]
    return spark.createDataFrame([*rows, (None, 1.0, 1.0, 1.0, 1.0), (1.0, 1.0, 1.0, 1.0, 0.0)], "u double, v double, vis_re double, vis_im double, sigma double")


@pytest.mark.parametrize("n", [15, 16])
@pytest.mark.parametrize("kernel, oversample, error", [("kaiser", 2, 1e-6), ("cubic", 8, 1e-2), ("gauss", 8, 1e-2), ("pill", 32, 1e-1)])
def test_dirty_images_and_models_by_every_kernel(spark, n, kernel, oversample, error):
    vis, grid = table(spark), gridding.Grid(n, PIXEL, oversample, kernel)
    want = imaging.dirty_image(imaging.normal_sums(vis, n, PIXEL))
    assert np.abs(gridding.dirty_image(vis, grid) - want).max() < error * np.abs(want).max()
    image = np.random.default_rng(3).uniform(size=(n, n))
    both = simulation.image_visibilities(vis.select("u", "v").dropna(), image, PIXEL)
    for r in gridding.model_visibilities(both, image, grid, "mod").collect():
        assert abs(complex(r.vis_re, r.vis_im) - complex(r.mod_re, r.mod_im)) < error * image.sum()


@pytest.mark.parametrize("n", [9, 12])
@pytest.mark.parametrize("weighting", ["natural", "uniform"])
def test_normal_sums(spark, n, weighting):
    vis = table(spark)
    a, b = imaging.normal_sums(vis, n, PIXEL, weighting), gridding.normal_sums(vis, n, PIXEL, weighting)
    assert np.allclose(a.dirty, b.dirty, atol=1e-7 * np.abs(a.dirty).max()) and np.allclose(a.spread, b.spread, atol=1e-7 * a.weight)
    assert a.count == b.count == 400 and np.isclose(a.weight, b.weight) and np.isclose(a.power, b.power)


def closures(spark, kind, n=60):
    rng = np.random.default_rng(5)
    legs = len(imaging.DATA[kind][1])
    columns = [*imaging.DATA[kind][0], *[c for leg in imaging.DATA[kind][1] for c in leg]]
    data = [rng.uniform(0.5, 2, n) for _ in columns[: len(columns) - 2 * legs]]
    return spark.createDataFrame(list(zip(*(x.tolist() for x in (*data, *rng.uniform(-3e9, 3e9, (2 * legs, n)))), strict=True)), ", ".join(f"{c} double" for c in columns))


@pytest.mark.parametrize("kind", list(imaging.DATA))
def test_chi_squares_and_gradients(spark, kind):
    rows = closures(spark, kind).cache()
    image = np.random.default_rng(4).uniform(0.1, 1, (12, 12))
    value, slope = imaging.data_term(rows, kind, 12, PIXEL)(image)
    got, gradient = gridding.data_term(rows, kind, gridding.Grid(12, PIXEL))(image)
    assert abs(got - value) < 1e-2 * value
    assert np.linalg.norm(gradient - slope) < 1e-2 * np.linalg.norm(slope)


def test_empty_tables_and_limits(spark):
    none = table(spark).filter("u > 1e30")
    assert gridding.cell_sums(none, gridding.Grid(8, PIXEL)).count() == 0 and not gridding.dirty_image(none, gridding.Grid(8, PIXEL)).any()
    assert gridding.normal_sums(none, 8, PIXEL).count == 0
    assert gridding.data_term(none, "vis", gridding.Grid(8, PIXEL))(np.ones((8, 8)))[0] == 0.0
    with pytest.raises(ValueError):
        gridding.Grid(10_000, PIXEL).cells
    far = table(spark).select((F.col("u") * 50).alias("u"), "v", "vis_re", "vis_im", "sigma")  # beyond the grid's range: frequencies wrap, as they do in the sum itself
    assert np.allclose(gridding.dirty_image(far, gridding.Grid(8, PIXEL, width=12)), imaging.dirty_image(imaging.normal_sums(far, 8, PIXEL)), atol=1e-7)


def test_the_image_of_its_own_visibilities_has_no_misfit(spark):
    y, x = np.indices((16, 16))
    image = np.exp(-((x - 6) ** 2 + (y - 9) ** 2) / 8.0)
    points = table(spark, 600).select("u", "v").dropna()
    vis = gridding.model_visibilities(points, image, gridding.Grid(16, PIXEL, width=12)).withColumn("sigma", F.lit(0.01))
    sums = gridding.normal_sums(vis, 16, PIXEL)
    assert abs(sums.chisq(image)[0]) < 1e-7 * sums.power / sums.count and sums.chisq(image * 1.1)[0] > 1e-3 * sums.power / sums.count
