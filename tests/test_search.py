"""Populations of source models: chi-squares of all kinds, a planted source that descent misses, and a known posterior."""

import numpy as np
import pytest

from fringelake.operators import imaging, models, search
from fringelake.operators.models import Component, sample

TRUE = [Component("circ_gauss", 1.0, fwhm=4e-11), Component("point", 0.6, x=1.7e-10, y=-1.2e-10)]


def table(spark, components=TRUE, noise=0.02, rows=150, seed=1):
    rng = np.random.default_rng(seed)
    u, v = rng.uniform(-8e9, 8e9, (2, rows))
    z = sum(sample(c, u, v) for c in components) + noise * (rng.normal(size=rows) + 1j * rng.normal(size=rows))
    data = [*zip(u.tolist(), v.tolist(), z.real.tolist(), z.imag.tolist(), [noise] * rows), (None, 1.0, 1.0, 1.0, 1.0), (1.0, 1.0, 1.0, 1.0, 0.0)]
    return spark.createDataFrame(data, "u double, v double, vis_re double, vis_im double, sigma double").repartition(3).cache()


FREE = [(0, "flux"), (0, "fwhm"), (1, "flux"), (1, "x"), (1, "y")]
VECTORS = np.array([[1.0, 4e-11, 0.6, 1.7e-10, -1.2e-10], [0.8, 2e-11, 0.5, 0.0, 0.0], [0.0, 1e-11, 0.0, 0.0, 0.0]])


def test_chisquares_are_those_of_each_vector(spark):
    vis = table(spark)
    got = search.Population(vis, "vis", TRUE, FREE).chisq(VECTORS)
    rows = np.array([tuple(r) for r in vis.dropna().filter("sigma > 0").collect()])
    u, v, re, im, s = rows.T
    for chi, p in zip(got, VECTORS, strict=True):
        model = sample(Component("circ_gauss", p[0], fwhm=p[1]), u, v) + sample(Component("point", p[2], x=p[3], y=p[4]), u, v)
        assert np.isclose(chi, (np.abs(re + 1j * im - model) ** 2 / s**2).mean() / 2)
    with pytest.raises(ValueError):
        search.Population(vis.filter("u > 1e30"), "vis", TRUE, FREE).chisq(VECTORS)


@pytest.mark.parametrize("kind", ["cphase", "bispec", "logcamp", "camp"])
def test_closure_kinds_agree_with_the_image_term(spark, kind):
    """A point on a pixel is an image of one pixel."""
    n, pixel = 5, 1e-10
    rng = np.random.default_rng(3)
    columns, legs = imaging.DATA[kind]
    names = [*columns, *[c for leg in legs for c in leg]]
    rows = [[*rng.uniform(0.5, 1.5, len(columns)).tolist(), *rng.uniform(-3e9, 3e9, 2 * len(legs)).tolist()] for _ in range(40)]
    closed = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names))
    image = np.zeros((n, n))
    image[1, 3], image[2, 2] = 0.7, 1.1
    at = imaging.positions(n, pixel)
    parts = [Component("point", 0.7, x=float(at[3]), y=float(at[1])), Component("point", 1.1, x=float(at[2]), y=float(at[2]))]
    got = search.Population(closed, kind, parts, [(0, "flux")]).chisq(np.array([[0.7], [0.2]]))
    assert np.isclose(got[0], imaging.data_term(closed, kind, n, pixel)(image)[0])
    assert not np.isclose(got[0], got[1])


BOUNDS = [(0.1, 3.0), (1e-12, 3e-10), (0.1, 3.0), (-4e-10, 4e-10), (-4e-10, 4e-10)]


def test_finds_what_descent_misses(spark):
    vis = table(spark)
    start = [Component("circ_gauss", 0.5, fwhm=1.5e-10), Component("point", 0.3, x=-2.5e-10, y=2.5e-10)]
    _, stuck = models.fit_components(vis, start, FREE, [1.0, 1e-10, 1.0, 1e-10, 1e-10])
    assert stuck > 20
    best, chi, path = search.search_components(vis, "vis", start, FREE, BOUNDS, members=40, rounds=70, seed=2)
    assert all(b <= a for a, b in zip(path, path[1:])) and chi == path[-1]
    fitted, chi = models.fit_components(vis, best, FREE, [1.0, 1e-10, 1.0, 1e-10, 1e-10])
    assert chi < 1.3
    assert abs(fitted[1].x - 1.7e-10) < 3e-12 and abs(fitted[1].y + 1.2e-10) < 3e-12 and abs(fitted[0].flux - 1) < 0.03


def test_from_closure_phases_alone(spark):
    """Two points: phases of triangles tell their distance and the ratio of their fluxes."""
    rng = np.random.default_rng(6)
    parts = [Component("point", 1.0), Component("point", 0.5, x=1.1e-10, y=0.8e-10)]
    rows = []
    for _ in range(200):
        a, b = rng.uniform(-6e9, 6e9, (2, 2))
        legs = [a, b, -a - b]
        z = np.prod([sum(sample(c, np.array([u]), np.array([v])) for c in parts) for u, v in legs])
        rows.append([float(np.degrees(np.angle(z)) + rng.normal()), 1.0, *np.array(legs).ravel().tolist()])
    cphase = spark.createDataFrame(rows, "cphase double, sigmacp double, u1 double, v1 double, u2 double, v2 double, u3 double, v3 double").cache()
    best, chi, _ = search.search_components(cphase, "cphase", parts, [(1, "flux"), (1, "x"), (1, "y")], [(0.05, 0.95), (-3e-10, 3e-10), (-3e-10, 3e-10)], members=30, rounds=120)
    assert chi < 1.5 and abs(best[1].x - 1.1e-10) < 3e-12 and abs(best[1].flux - 0.5) < 0.03


def test_samples_have_the_width_that_linear_theory_gives(spark):
    """The flux of one point is known to sigma / sqrt(real data)."""
    rows, noise = 100, 0.2
    vis = table(spark, [Component("point", 1.0)], noise, rows, 4)
    rng = np.random.default_rng(0)
    start = 1 + 0.02 * rng.normal(size=(10, 1))
    got = search.sample_components(vis, "vis", [Component("point", 1.0)], [(0, "flux")], [(0.0, 2.0)], start, 2 * rows, rounds=60)[10:]
    mean = vis.dropna().filter("sigma > 0").selectExpr("avg(vis_re) m").first()["m"]
    assert got.shape == (50, 10, 1) and abs(got.mean() - mean) < 0.3 * noise / np.sqrt(rows) * 2 and 0.7 < got.std() / (noise / np.sqrt(rows)) < 1.4
