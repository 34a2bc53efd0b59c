"""Polarised and spectral imaging: gradients against differences, planted shares, angles and spectra found again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringelake.operators import gridding, jointimaging, simulation

PIXEL, N = 1e-10, 10


def truth():
    y, x = np.indices((N, N))
    i = np.exp(-((x - 4.5) ** 2 + (y - 4.5) ** 2) / 6) + 1e-3
    return {"I": i, "m": 0.1 + 0.05 * x / N + 0.2 * y / N, "chi": 0.3 + 0.08 * x - 0.05 * y, "alpha": -1.0 + 0.15 * x, "beta": 0.1 * np.ones((N, N)), "V": 0.05 - 0.01 * y}


def points(spark, n=250, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(float(a), float(b), int(k % 3)) for k, (a, b) in enumerate(rng.uniform(-4e9, 4e9, (n, 2)))]
    return spark.createDataFrame(rows, "u double, v double, f int").repartition(4).cache()


def full(spark, uv, r, logs=(0.0,)):
    images = jointimaging.Blocks(r, (), logs).images(r)
    parts = []
    for f in range(len(logs)):
        own = uv.filter(F.col("f") == f) if len(logs) > 1 else uv
        for name, image in (("vis", images["I", f]), ("qvis", images["P", f].real), ("uvis", images["P", f].imag), ("vvis", images["V", f])):
            own = simulation.image_visibilities(own, image, PIXEL).withColumnsRenamed({"vis_re": f"_{name}_re", "vis_im": f"_{name}_im"})
        parts.append(own.withColumnsRenamed({f"_{n}_{p}": f"{n}_{p}" for n in ("vis", "qvis", "uvis", "vvis") for p in ("re", "im")}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumns({"sigma": F.lit(0.02), "qsigma": F.lit(0.01), "usigma": F.lit(0.015), "vsigma": F.lit(0.01)}).cache()


@pytest.mark.parametrize("solve", [("I", "m", "chi", "V"), ("I", "alpha", "beta", "m", "chi")])
def test_gradients_through_all_changes_of_variables(spark, solve):
    logs = (-0.2, 0.0, 0.3)
    vis = full(spark, points(spark), truth(), logs)
    rng = np.random.default_rng(4)
    start = {k: x * rng.uniform(0.8, 1.2, x.shape) for k, x in truth().items()}
    blocks = jointimaging.Blocks(start, solve, logs, [(0.5, jointimaging.polarised_total_variation()), (0.1, jointimaging.smooth(("m",)))])
    rows = {k: jointimaging.data_rows(vis, k, F.col("f")) for k in ("vis", "pvis", "m", "vvis")}
    f, z = blocks.objective(jointimaging.block_term(rows, gridding.Grid(N, PIXEL, width=12))), blocks.pack()
    _, slope = f(z)
    for _ in range(4):
        way = rng.normal(size=len(z))
        way /= np.linalg.norm(way)
        h = 1e-5
        want = (f(z + h * way)[0] - f(z - h * way)[0]) / (2 * h)
        assert np.isclose(slope @ way, want, rtol=1e-4, atol=1e-4 * np.linalg.norm(slope))


def test_planted_polarisation_is_found(spark):
    r = truth()
    vis = full(spark, points(spark, 400), r)
    start = {"I": r["I"], "m": np.full((N, N), 0.15), "chi": np.zeros((N, N)), "V": r["V"]}
    got = jointimaging.solve({"pvis": jointimaging.data_rows(vis, "pvis")}, gridding.Grid(N, PIXEL), jointimaging.Blocks(start, ("m", "chi")), 45)
    bright = r["I"] > 0.3
    assert np.abs(got["m"] - r["m"])[bright].max() < 0.06 and np.abs(np.angle(np.exp(2j * (got["chi"] - r["chi"]))))[bright].max() < 0.15


def test_planted_spectrum_is_found(spark):
    r, logs = truth(), (-0.3, 0.0, 0.3)
    vis = full(spark, points(spark, 700), r, logs)
    start = {"I": np.full((N, N), r["I"].mean()), "alpha": np.zeros((N, N))}
    true = {"I": r["I"], "alpha": r["alpha"]}
    images = jointimaging.Blocks(true, (), logs).images(true)
    parts = [simulation.image_visibilities(vis.select("u", "v", "f").filter(F.col("f") == f), images["I", f], PIXEL) for f in range(3)]
    data = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("sigma", F.lit(0.01)).cache()
    blocks = jointimaging.Blocks(start, ("I", "alpha"), logs, [(1e-3, jointimaging.smooth(("alpha",)))])
    got = jointimaging.solve({"vis": jointimaging.data_rows(data, "vis", F.col("f"))}, gridding.Grid(N, PIXEL), blocks, 80)
    bright = r["I"] > 0.3
    assert np.abs(got["I"] - r["I"])[bright].max() < 0.03 and np.abs(got["alpha"] - r["alpha"])[bright].max() < 0.15


def test_empty_tables_and_nulls(spark):
    vis = full(spark, points(spark, 30), truth())
    none = {"pvis": jointimaging.data_rows(vis.filter("u > 1e30"), "pvis")}
    r = truth()
    value, slopes = jointimaging.block_term(none, gridding.Grid(N, PIXEL))(jointimaging.Blocks(r, ()).images(r))
    assert value == 0.0 and not any(x.any() for x in slopes.values())
    holes = vis.withColumn("qvis_re", F.when(F.col("u") > 0, F.col("qvis_re")))
    assert jointimaging.data_rows(holes, "pvis").count() == vis.filter("u > 0").count()
