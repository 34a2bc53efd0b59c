"""Imaging, models and raster operators against direct sums and known sources."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringelake.functions.bessel import jn
from fringelake.operators import imaging, models, raster
from fringelake.operators import simulation

PIXEL = 1e-10
UV = "u double, v double"


def points(spark, n=300, reach=3e9, seed=1):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(float(a), float(b)) for a, b in rng.uniform(-reach, reach, (n, 2))], UV)


def test_bessel_functions():
    z = np.array([0.0, 0.5, 2.404825557695773, 10.0, 150.0, 199.0, 201.0, 1000.0])
    assert jn(0, z[:1])[0] == 1.0 and abs(jn(0, z[2:3])[0]) < 1e-14 and abs(jn(1, z[1:2])[0] - 0.2422684576748739) < 1e-14
    for n in (1, 2, 5):  # J(n-1) + J(n+1) = 2 n / z J(n)
        assert np.allclose(jn(n - 1, z[1:]) + jn(n + 1, z[1:]), 2 * n / z[1:] * jn(n, z[1:]), atol=1e-9)
    assert np.allclose(jn(3, -z), -jn(3, z)) and np.allclose(jn(-2, z), jn(2, z))


def direct(f, u, v, reach, n=401):
    """The transform of brightness f(x, y) over a fine grid."""
    x = np.linspace(-reach, reach, n)
    b = f(x[None, :], x[:, None])
    b = b / b.sum()
    return np.exp(2j * np.pi * v * x) @ b @ np.exp(2j * np.pi * u * x)


def test_models_against_direct_transforms():
    u, v = np.array([1e9, -0.7e9, 0.3e9]), np.array([0.2e9, 1.1e9, -0.9e9])
    size = lambda x, y: np.hypot(x, y)
    shapes = {
        models.Component("disk", 2.0, d=4e-10): lambda x, y: (size(x, y) <= 2e-10).astype(float),
        models.Component("gauss", 2.0, major=3e-10, minor=1e-10, angle=0.4): lambda x, y: np.exp(-4 * np.log(2) * (((x * np.sin(0.4) + y * np.cos(0.4)) / 3e-10) ** 2 + ((x * np.cos(0.4) - y * np.sin(0.4)) / 1e-10) ** 2)),
        models.Component("circ_gauss", 2.0, fwhm=2e-10): lambda x, y: np.exp(-4 * np.log(2) * (size(x, y) / 2e-10) ** 2),
        models.Component("crescent", 2.0, d=4e-10, fr=0.5, fo=0.6, ff=0.25, angle=0.7): lambda x, y: np.where(size(x, y) > 2e-10, 0.0, np.where(size(x - 0.6e-10 * np.sin(0.7), y - 0.6e-10 * np.cos(0.7)) <= 1e-10, 0.25, 1.0)),
    }
    for c, f in shapes.items():
        got = models.sample(c, u, v)
        for k in range(3):
            assert abs(got[k] - 2 * direct(f, u[k], v[k], 6e-10)) < 0.02, c.kind
    moved = models.sample(models.Component("point", 1.5, x=1e-10, y=-2e-10), u, v)
    assert np.allclose(moved, 1.5 * np.exp(2j * np.pi * (u * 1e-10 - v * 2e-10)))
    ring = models.sample(models.Component("ring", 1.0, d=4e-10), u, v)
    t = np.arange(3600) * 2 * np.pi / 3600
    beta = (0.3 - 0.2j, 0.1j)
    bright = 1 + 2 * np.real(sum(b * np.exp(1j * m * t) for m, b in enumerate(beta, 1)))
    # Ring modes are transformed with the opposite sign of the exponent.
    want = [np.mean(np.exp(2j * np.pi * 2e-10 * (a * np.sin(t) + b * np.cos(t)))) for a, b in zip(u, v, strict=True)]
    modes = [np.mean(bright * np.exp(-2j * np.pi * 2e-10 * (a * np.sin(t) + b * np.cos(t)))) for a, b in zip(u, v, strict=True)]
    assert np.allclose(ring, want) and np.allclose(models.sample(models.Component("mring", 1.0, d=4e-10, beta=beta), u, v), modes)
    thick = models.sample(models.Component("thick_ring", 1.0, d=4e-10, alpha=1e-10), u, v)
    assert np.allclose(thick, ring * np.exp(-((np.pi * 1e-10) ** 2) * (u**2 + v**2) / (4 * np.log(2))))
    with pytest.raises(ValueError):
        models.Component("star", 1.0)


def test_model_tables(spark):
    parts = [models.Component("disk", 1.0, d=2e-10), models.Component("point", 0.5)]
    table = spark.createDataFrame([(1e9, 0.0), (None, 1.0), (0.0, 0.0)], UV)
    got = models.model_visibilities(table, parts, "mod").collect()
    assert got[1]["mod_re"] is None and abs(got[2]["mod_re"] - 1.5) < 1e-12
    assert abs(got[0]["mod_re"] - 0.5 - sum(models.sample(c, np.array([1e9]), np.array([0.0])).real[0] for c in parts[:1])) < 1e-12
    assert models.model_visibilities(table.filter("false"), parts).count() == 0


def source(n=12):
    image = raster.gauss(np.zeros((n, n)), PIXEL, 1.0, 4e-10, 2.5e-10, 0.5, 1e-10, -1e-10)
    return raster.gauss(image, PIXEL, 0.5, 2e-10, 2e-10, 0.0, -2e-10, 2e-10)


def observed(spark, image, noise=0.0, n=300):
    vis = simulation.image_visibilities(points(spark, n), image, PIXEL).withColumn("sigma", F.lit(0.01))
    if noise:
        vis = vis.withColumns({c: F.col(c) + noise * F.sin(F.lit(1e3) * F.col("u") / 1e9 + k) for k, c in enumerate(("vis_re", "vis_im"))})
    return vis.persist()


def test_sums_hold_the_whole_least_squares_term(spark):
    image = source()
    vis = observed(spark, image, 0.02)
    sums = imaging.normal_sums(vis, 12, PIXEL)
    other = image + np.random.default_rng(2).normal(0, 0.01, image.shape)
    direct_term = imaging.data_term(vis, "vis", 12, PIXEL)
    (a, ga), (b, gb) = sums.chisq(other), direct_term(other)
    assert abs(a - b) < 1e-8 * b and np.allclose(ga, gb, rtol=1e-7, atol=1e-7 * np.abs(gb).max())
    assert sums.count == 300 and abs(sums.weight - 300 / 0.01**2) < 1e-3
    rows = vis.collect()
    x = imaging.positions(12, PIXEL)
    want = np.mean([np.real((r["vis_re"] + 1j * r["vis_im"]) * np.exp(-2j * np.pi * (r["u"] * x[None, :] + r["v"] * x[:, None]))) for r in rows], axis=0)
    assert np.allclose(imaging.dirty_image(sums), want)
    empty = imaging.normal_sums(vis.filter("false"), 12, PIXEL)
    assert empty.count == 0 and not imaging.dirty_image(empty).any() and not imaging.clean(empty)[0].any()


def test_clean_finds_points(spark):
    image = np.zeros((16, 16))
    image[4, 5], image[10, 9] = 1.0, 0.4
    sums = imaging.normal_sums(observed(spark, image), 16, PIXEL)
    found, left = imaging.clean(sums, 800, 0.2)
    assert np.abs(found - image).max() < 0.02 and np.abs(left).max() < 0.02
    mask = np.zeros((16, 16), bool)
    mask[10, 9] = True
    assert set(zip(*np.nonzero(imaging.clean(sums, 50, 0.2, mask)[0]), strict=True)) == {(10, 9)}
    assert abs(imaging.restore(found, left, 2.0).sum() - found.sum() - left.sum()) < 0.1


def test_regularised_image(spark):
    image = source()
    sums = imaging.normal_sums(observed(spark, image), 12, PIXEL)
    prior = np.full(image.shape, image.sum() / image.size)
    got = imaging.make_image([(1.0, sums.chisq), (1e-3, imaging.entropy(prior)), (1e-3, imaging.total_variation(image.sum()))], prior, 400)
    seen = 1 / 3e9 / PIXEL  # pixels that the longest baseline resolves
    assert sums.chisq(got)[0] < 1.0 and raster.find_shift(raster.blur_circular(image, seen), raster.blur_circular(got, seen))[2] > 0.99 and (got > 0).all()


@pytest.mark.parametrize("kind", sorted(imaging.DATA))
def test_gradients_of_data_terms(spark, kind):
    image, rng = source(), np.random.default_rng(3)
    legs = len(imaging.DATA[kind][1])
    base = rng.uniform(-2e9, 2e9, (40, legs, 2))
    names = [c for leg in imaging.DATA[kind][1] for c in leg]
    data = {"vis": 3, "bispec": 3}.get(kind, 2)
    rows = [(*(float(x) for x in rng.uniform(0.2, 1.0, data - 1)), 0.3, *(float(x) for x in b.ravel())) for b in base]
    table = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in (*imaging.DATA[kind][0], *names))).persist()
    term = imaging.data_term(table, kind, 12, PIXEL)
    value, slope = term(image)
    assert value > 0
    for i, j in ((5, 6), (3, 3)):
        step = np.zeros(image.shape)
        step[i, j] = 1e-5
        assert abs((term(image + step)[0] - term(image - step)[0]) / 2e-5 - slope[i, j]) < 1e-3 * np.abs(slope).max()
    assert imaging.data_term(table.filter("false"), kind, 12, PIXEL)(image)[0] == 0.0


@pytest.mark.parametrize("term", [imaging.entropy(np.full((5, 5), 0.04)), imaging.sparsity(1.0), imaging.total_variation(1.0), imaging.total_variation(1.0, True), imaging.total_flux(0.7), imaging.centred(1.0)])
def test_gradients_of_image_terms(term):
    x = np.random.default_rng(4).uniform(0.02, 0.1, (5, 5))
    slope = term(x)[1]
    for i, j in ((0, 0), (2, 3), (4, 4)):
        step = np.zeros((5, 5))
        step[i, j] = 1e-6
        assert abs((term(x + step)[0] - term(x - step)[0]) / 2e-6 - slope[i, j]) < 1e-5 * max(1, abs(slope[i, j]))


def test_gaussian_fit(spark):
    k = math.sqrt(8 * math.log(2))
    c = models.Component("gauss", 2.0, x=1e-10, y=-0.5e-10, major=4e-10, minor=2e-10, angle=0.6)
    vis = models.model_visibilities(points(spark, 400, 1.5e9), [c]).withColumn("sigma", F.lit(0.01)).persist()
    got = imaging.fit_gaussian(vis, {"flux": 1.5, "x": 0.0, "y": 0.0, "a": (3e-10 / k) ** 2, "b": (3e-10 / k) ** 2, "c": 0.0})
    assert abs(got["flux"] - 2) < 1e-4 and abs(got["x"] - 1e-10) < 1e-14 and abs(got["major"] - 4e-10) < 1e-14 and abs(got["minor"] - 2e-10) < 1e-14
    assert abs(got["angle"] - 0.6) < 1e-4 and got["chisq"] < 1e-6
    with pytest.raises(ValueError):
        imaging.fit_gaussian(vis.filter("false"), {k: 0.0 for k in imaging.GAUSSIAN})
    beam = imaging.clean_beam(vis)
    assert beam["major"] >= beam["minor"] > 0


def test_raster_geometry():
    rng = np.random.default_rng(5)
    a = rng.uniform(0, 1, (7, 9))
    assert raster.pad(a, 9, 13).shape == (9, 13) and raster.pad(a, 9, 13).sum() == a.sum()
    assert np.allclose(raster.shift(a, 2, -1)[2:, :-1], a[:-2, 1:]) and np.allclose(raster.shift_fourier(raster.pad(a, 15, 17), 2, 1), raster.pad(a, 15, 17)[np.ix_(np.r_[-2:13], np.r_[-1:16])], atol=1e-9)
    assert np.allclose(raster.regrid(a, 7, 9, 1.0), a) and np.allclose(raster.resample(a, 7, 9, 1.0), a)
    assert abs(raster.resample(a, 4, 5, 2.0).sum() - a.sum()) < 1e-9 and np.allclose(raster.resample(raster.resample(a, 14, 18, 0.5), 7, 9, 2.0), a)
    assert np.allclose(raster.regrid(np.full((8, 8), 1.0), 4, 4, 1.5)[1:3, 1:3], 2.25)
    square = rng.uniform(0, 1, (8, 8))
    assert np.allclose(raster.rotate(square, np.pi / 2), np.rot90(square)) and np.allclose(raster.rotate(square, np.pi), np.rot90(square, 2))
    off = raster.shift(raster.gauss(np.zeros((15, 15)), 1.0, 1.0, 3.0, 3.0, 0.0), 3, -2)
    assert np.allclose(raster.centroid(raster.centre(off)), 0, atol=0.05)
    assert raster.find_shift(off, raster.shift(off, -3, 4))[:2] == (3, -4)
    with pytest.raises(ValueError):
        raster.pad(a, 3, 3)


def test_raster_filters():
    point = np.zeros((21, 21))
    point[10, 10] = 1.0
    for got in (raster.blur_circular(point, 4.0), raster.blur_gaussian(point, 4.0, 4.0, 0.3)):
        assert abs(got.sum() - 1) < 1e-3 and abs(got[10, 12] / got[10, 10] - 0.5) < 1e-9 and np.allclose(got, got.T)
    long = raster.blur_gaussian(point, 6.0, 2.0, 0.0)
    assert long[13, 10] > 100 * long[10, 13]
    assert abs(raster.blur_circular(point, 4.0, "butter").sum() - 1) < 0.05
    slope = np.add.outer(2.0 * np.arange(6), np.arange(6))
    assert np.allclose(raster.gradient(slope, "x")[1:-1, 1:-1], 16) and np.allclose(raster.gradient(slope, "y")[1:-1, 1:-1], 8) and np.allclose(raster.gradient(slope)[1:-1, 1:-1], math.hypot(16, 8))


def test_ring_features():
    image = raster.ring(np.zeros((64, 64)), 1.0, 1.0, 18.0, 6.0, 0.5, 1.0)
    d, _, w, _, angle, asym, floor, *_ = raster.ring_features(raster.shift(image, 3, -2), 1.0)
    assert abs(d - 36) < 0.6 and abs(w - 6) < 0.5 and abs(angle - 1.0) < 0.1 and abs(asym - 0.25) < 0.03 and floor < 0.01


def test_columns_of_images(spark):
    a = raster.gauss(np.zeros((8, 8)), 1.0, 1.0, 3.0, 3.0, 0.0)
    images = spark.createDataFrame([(0, a.ravel().tolist(), raster.shift(a, 1, 2).ravel().tolist()), (1, None, None), (2, [1.0, None] * 32, [1.0] * 64)], "image_id int, pix array<double>, other array<double>")
    blurred = {r["image_id"]: r["pix"] for r in raster.each(images, raster.blur_circular, 8, 2.0).collect()}
    assert np.allclose(blurred[0], raster.blur_circular(a, 2.0).ravel()) and blurred[1] is None and blurred[2] is None
    r = raster.align(images.filter("image_id < 2"), 8).collect()
    assert len(r) == 1 and (r[0]["down"], r[0]["right"]) == (-1.0, -2.0) and abs(r[0]["nxcorr"] - 1) < 1e-9 and r[0]["rssd"] < 1e-12


def test_spectra_order_and_survey(spark):
    images = spark.createDataFrame([(0, k, rf, [2.0 * rf**-0.7, 3.0 * rf**1.1, 0.0]) for k, rf in enumerate((1.0, 2.0, 4.0))], "movie_id int, image_id int, rf double, pix array<double>")
    got = {r["i"]: r for r in raster.spectral_index(images).collect()}
    assert len(got) == 2 and abs(got[0]["index"] + 0.7) < 1e-12 and abs(got[1]["index"] - 1.1) < 1e-12 and abs(got[0]["log_flux"] - math.log(2)) < 1e-12
    order = [r["value"] for r in raster.by_mean_brightness(images).filter("image_id = 0").orderBy("place").collect()]
    assert order == [3.0, 2.0, 0.0]
    table = raster.survey(spark, {"a": [1, 2], "b": [0.5, 1.5, 2.5]}, lambda p: {"c": p["a"] * p["b"]}, "c double")
    assert sorted((r["a"], r["b"], r["c"]) for r in table.collect()) == [(a, b, a * b) for a in (1, 2) for b in (0.5, 1.5, 2.5)]
    assert raster.survey(spark, {"a": []}, lambda p: p, "c double").count() == 0
