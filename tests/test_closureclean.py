"""CLEAN on closures: derivatives against differences, and planted points found from closure phases alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringelake.operators import closure, closureclean, gridding, simulation

PIXEL, N = 1e-10, 16


def planted():
    image = np.zeros((N, N))
    image[8, 8], image[4, 11], image[12, 6] = 1.0, 0.4, 0.25
    return image


@pytest.fixture(scope="module")
def vis(spark):
    rng = np.random.default_rng(3)
    rows = []
    for t in range(25):
        at = {s: rng.uniform(-2.2e9, 2.2e9, 2) for s in "ABCDEF"}
        for i, a in enumerate("ABCDEF"):
            for b in "ABCDEF"[i + 1 :]:
                rows.append((float(t), a, b, *map(float, at[a] - at[b]), 0.01))
    points = spark.createDataFrame(rows, "time double, t1 string, t2 string, u double, v double, sigma double")
    z = simulation.image_visibilities(points, planted(), PIXEL)
    # Gains of each station and time: closures do not see their phases.
    phase = lambda s: F.pmod(F.xxhash64(s, "time"), F.lit(1000)) / 100.0
    turn = phase("t1") - phase("t2")
    return z.withColumns({"vis_re": F.col("vis_re") * F.cos(turn) - F.col("vis_im") * F.sin(turn), "vis_im": F.col("vis_re") * F.sin(turn) + F.col("vis_im") * F.cos(turn)}).cache()


def tables(vis, kind):
    return (closure.bispectra(vis) if kind == "bispec" else closure.closure_phases(vis)).repartition(4).cache()


@pytest.mark.parametrize("kind", ["bispec", "cphase"])
def test_derivatives(vis, kind):
    rng = np.random.default_rng(5)
    columns, legs = closureclean.DATA[kind]
    rows = tables(vis, kind).select(*columns, *[c for leg in legs for c in leg])
    image, grid = planted() + 0.01 * rng.uniform(size=(N, N)), gridding.Grid(N, PIXEL, width=12)
    misfit, p, q, count = closureclean.derivatives(rows, kind, image, grid)
    assert count == rows.count()
    for at in ((3, 4), (8, 8), (15, 0)):
        h = 1e-4
        ends = []
        for d in (-h, h):
            moved = image.copy()
            moved[at] += d
            ends.append(closureclean.derivatives(rows, kind, moved, grid)[0])
        assert np.isclose((ends[1] - ends[0]) / (2 * h), p[at], rtol=1e-4, atol=1e-6 * abs(p).max())
        if kind == "bispec":
            assert np.isclose((ends[0] + ends[1] - 2 * misfit) / h**2 / 2, q[at], rtol=1e-3)
        else:
            assert q[at] > 0


def test_planted_points_from_closure_phases_alone(vis):
    image, history = closureclean.clean_closures(tables(vis, "cphase"), "cphase", N, PIXEL, steps=60, gain=0.3)
    found = sorted(zip(*np.unravel_index(np.argsort(image.ravel())[-3:], image.shape), strict=True))
    assert [tuple(map(int, x)) for x in found] == [(4, 11), (8, 8), (12, 6)]
    assert history[-1] < 0.02 * history[0]
    scale = image[8, 8]
    assert abs(image[4, 11] / scale - 0.4) < 0.08 and abs(image[12, 6] / scale - 0.25) < 0.08


def test_planted_points_and_flux_from_bispectra(vis):
    image, history = closureclean.clean_closures(tables(vis, "bispec"), "bispec", N, PIXEL, steps=60, gain=0.3, weights="uniform")
    found = sorted(zip(*np.unravel_index(np.argsort(image.ravel())[-3:], image.shape), strict=True))
    assert [tuple(map(int, x)) for x in found] == [(4, 11), (8, 8), (12, 6)] and history[-1] < 0.02 * history[0]
    assert abs(image.sum() - 1.65) < 0.1


def test_masks_signs_and_empty_tables(vis):
    rows = tables(vis, "cphase")
    mask = np.zeros((N, N), bool)
    mask[4, 11] = True
    image, history = closureclean.clean_closures(rows, "cphase", N, PIXEL, steps=3, mask=mask)
    assert image[8, 8] == 1.0 and image[4, 11] > 0 and np.count_nonzero(image) == 2 and len(history) == 3
    none = rows.filter("time < 0")
    assert closureclean.clean_closures(none, "cphase", N, PIXEL, steps=2)[1] == []
    assert closureclean.clean_closures(closure.bispectra(vis.filter("time < 0")), "bispec", N, PIXEL)[1] == []
    with pytest.raises(ValueError):
        closureclean.clean_closures(rows, "camp", N, PIXEL)
