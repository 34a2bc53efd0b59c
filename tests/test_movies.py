"""Movies, polarised images, time-resolved and polarised imaging, generic fits, selections and merges."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringelake.operators import closure, imaging, models, movies, raster, simulation, tables

PIXEL = 1e-10


def uv(spark, n, frame=0, seed=1):
    rng = np.random.default_rng(seed + frame)
    return spark.createDataFrame([(float(a), float(b), frame) for a, b in rng.uniform(-3e9, 3e9, (n, 2))], "u double, v double, frame int")


def test_movie_from_visibilities(spark):
    n = 10
    truth = [raster.gauss(np.full((n, n), 1e-4), PIXEL, 1.0, 3e-10, 3e-10, 0.0, x0=k * 1e-10) for k in (-1, 0, 1)]
    vis = None
    for k, image in enumerate(truth):
        one = simulation.image_visibilities(uv(spark, 120, k), image, PIXEL).withColumn("sigma", F.lit(0.01))
        vis = one if vis is None else vis.unionByName(one)
    vis = vis.persist()
    sums = imaging.frame_sums(vis, n, PIXEL, "frame")
    alone = imaging.normal_sums(vis.filter("frame = 1"), n, PIXEL)
    assert sorted(sums) == [0, 1, 2] and np.allclose(sums[1].dirty, alone.dirty) and sums[1].count == 120
    flux = truth[0].sum()
    got = imaging.make_movie(sums, np.full((n, n), flux / n**2), [(1e-3, imaging.entropy(np.full((n, n), flux / n**2)))], 0.1)
    for k in range(3):
        assert sums[k].chisq(got[k])[0] < 1.0 and raster.find_shift(raster.blur_circular(truth[k], 3.3), raster.blur_circular(got[k], 3.3))[:2] == (0, 0)
    assert raster.centroid(got[0])[1] > raster.centroid(got[2])[1] + 1


def test_signed_image(spark):
    n = 10
    q = raster.gauss(np.zeros((n, n)), PIXEL, 1.0, 4e-10, 4e-10, 0.0, 1.5e-10) - raster.gauss(np.zeros((n, n)), PIXEL, 1.0, 4e-10, 4e-10, 0.0, -1.5e-10)
    vis = simulation.image_visibilities(uv(spark, 300), q, PIXEL).selectExpr("u", "v", "vis_re qvis_re", "vis_im qvis_im", "0.01 qsigma")
    sums = imaging.normal_sums(vis.withColumn("qsigma", F.col("qsigma").cast("double")), n, PIXEL, data="qvis", sigma="qsigma")
    got = imaging.make_signed_image([(1.0, sums.chisq), (1e-4, imaging.total_variation(1.0))], np.zeros((n, n)))
    assert raster.find_shift(raster.blur_circular(q, 3.3), raster.blur_circular(got, 3.3))[2] > 0.98


def test_generic_fit(spark):
    truth = [models.Component("ring", 2.0, d=4e-10, x=0.5e-10), models.Component("point", 0.7, x=-2e-10)]
    vis = models.model_visibilities(uv(spark, 300), truth).withColumn("sigma", F.lit(0.01))
    start = [models.Component("ring", 1.7, d=4.3e-10), models.Component("point", 0.5, x=-2e-10)]
    got, chi = models.fit_components(vis, start, [(0, "flux"), (0, "d"), (0, "x"), (1, "flux")], [1.0, 1e-10, 1e-10, 1.0])
    assert abs(got[0].flux - 2) < 1e-5 and abs(got[0].d - 4e-10) < 1e-15 and abs(got[0].x - 0.5e-10) < 1e-15 and abs(got[1].flux - 0.7) < 1e-5 and chi < 1e-6
    with pytest.raises(ValueError):
        models.fit_components(vis.filter("false"), start, [(0, "flux")], [1.0])


def movie(spark):
    return spark.createDataFrame([("a", k, 2.0 * k, [float(k), 10.0 * k]) for k in range(4)] + [("b", 0, 1.0, [5.0, 6.0])], "movie_id string, frame int, t double, pix array<double>")


def test_frames_between(spark):
    times = spark.createDataFrame([("a", t) for t in (-1.0, 0.0, 3.0, 6.0, 7.0)] + [("b", 1.0), ("b", 2.0)], "movie_id string, time double")
    got = {(r["movie_id"], r["time"]): r["pix"] for r in movies.frame_between(movie(spark), times).collect()}
    assert got == {("a", -1.0): None, ("a", 0.0): [0.0, 0.0], ("a", 3.0): [1.5, 15.0], ("a", 6.0): [3.0, 30.0], ("a", 7.0): None, ("b", 1.0): [5.0, 6.0], ("b", 2.0): None}
    around = {(r["movie_id"], r["time"]): r["pix"] for r in movies.frame_between(movie(spark), times, repeat=True).collect()}
    assert around["a", -1.0] == [2.5, 25.0] and around["a", 7.0] == [0.5, 5.0] and around["b", 2.0] == [5.0, 6.0]


def test_movie_operators(spark):
    m = movie(spark)
    assert movies.offset_time(m, 1.0).filter("frame = 1").first()["t"] == 3.0
    assert {r["movie_id"]: r["pix"] for r in movies.mean_frame(m).collect()} == {"a": [1.5, 15.0], "b": [5.0, 6.0]}
    got = {(r["movie_id"], r["frame"]): r["pix"] for r in movies.blur_time(m, 2.0).collect()}
    s = 2.0 / math.sqrt(8 * math.log(2))
    d = np.subtract.outer(np.arange(4), np.arange(4))
    w = np.where(np.abs(d) <= int(4 * s + 0.5), np.exp(-(d**2) / (2 * s**2)), 0)
    assert len(got) == 5 and np.allclose([got["a", k][0] for k in range(4)], (w @ np.arange(4.0)) / w.sum(1)) and got["b", 0] == [5.0, 6.0]
    images = spark.createDataFrame([(57848.5, [1.0]), (57848.25, [2.0])], "mjd double, pix array<double>")
    assert [(r["frame"], r["t"], r["pix"]) for r in movies.numbered(images).orderBy("frame").collect()] == [(0, 6.0, [2.0]), (1, 12.0, [1.0])]


def test_polarised_images(spark):
    images = spark.createDataFrame([(0, [2.0, 0.0], [0.6, 0.0], [0.8, 0.0], [0.5, 0.0])], "image_id int, i array<double>, q array<double>, u array<double>, v array<double>")
    circ = movies.circular_products(images)
    r = circ.first()
    assert (r["rr"][0], r["ll"][0], r["lr_im"][0]) == (2.5, 1.5, -0.8)
    back = movies.stokes_products(circ.drop("i", "q", "u", "v")).first()
    assert np.allclose([back[c][0] for c in "iquv"], [2.0, 0.6, 0.8, 0.5])
    f = movies.fractions(images).first()
    assert abs(f["m"][0] - 0.5) < 1e-12 and f["m"][1] is None and abs(f["chi"][0] - math.atan2(0.8, 0.6) / 2) < 1e-12 and f["vfrac"][0] == 0.25
    colour = spark.createDataFrame([([2.0], [1.5], [0.5])], "pix array<double>, alpha array<double>, beta array<double>")
    assert abs(movies.at_frequency(colour, 2.0, 1.0).first()["pix"][0] - 2 * 2 ** (1.5 + 0.5 * math.log(2))) < 1e-12
    rng = np.random.default_rng(1)
    q, u = rng.normal(size=(2, 9, 9))
    e, b = movies.modes(q, u)
    assert abs((e**2 + b**2).sum() - (q**2 + u**2).sum()) < 1e-9  # a turn keeps power


def test_scattering_screen():
    n, scale = 256, 8.0
    d = [np.mean((np.roll(p, 8, 1) - p) ** 2) for p in (movies.screen(n, 1.0, scale, 1.0, 60.0, seed=k) for k in range(20))]
    assert abs(np.mean(d) - 1) < 0.1
    image = raster.gauss(np.zeros((64, 64)), 1.0, 1.0, 12.0, 12.0, 0.0)
    y, x = np.mgrid[:64, :64]
    assert np.allclose(movies.scattered(image, np.zeros((64, 64)), 1.0, 2.0), image)
    tilted = movies.scattered(image, 0.5 * x.astype(float), 1.0, 2.0)  # a gradient of a half moves by two pixels
    assert np.allclose(tilted[5:-5, 5:-5], np.roll(image, -2, 1)[5:-5, 5:-5])


VIS = "time double, tint double, t1 string, t2 string, tau1 double, tau2 double, u double, v double, vis_re double, vis_im double, sigma double"


def table(spark, times=(0.0, 1.0), sites="ABCD", sigma=0.1, seed=1):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(t, 10.0, a, b, 0.1, 0.2, float(10 * (ord(b) - ord(a))), 0.0, *(float(x) for x in rng.normal(1, 0.3, 2)), sigma) for t in times for i, a in enumerate(sites) for b in sites[i + 1 :]], VIS)


def test_one_triangle_and_quadrangle(spark):
    vis = table(spark, (0.0,))
    z = {(r["t1"], r["t2"]): complex(r["vis_re"], r["vis_im"]) for r in vis.collect()}
    z |= {(b, a): x.conjugate() for (a, b), x in z.items()}
    phases = closure.closure_phases(vis)
    for order in (("A", "B", "C"), ("C", "A", "B"), ("B", "A", "C")):
        (r,) = closure.one_triangle(phases, *order).collect()
        a, b, c = order
        assert abs(np.exp(1j * np.radians(r["cphase"])) - np.exp(1j * np.angle(z[a, b] * z[b, c] * z[c, a]))) < 1e-9
    amps = closure.closure_amplitudes(vis, "max", "camp", debias=False)
    for order in (("A", "B", "C", "D"), ("A", "D", "C", "B"), ("B", "C", "D", "A"), ("C", "A", "B", "D")):
        a, b, c, d = order
        rows = closure.one_quadrangle(amps, *order).collect()
        for r in rows:
            assert abs(r["camp"] - abs(z[a, b] * z[c, d] / z[a, d] / z[b, c])) < 1e-9
    assert closure.one_quadrangle(amps, "A", "B", "C", "D").count() == 1
    assert closure.minimal_triangles(phases, vis).count() == closure.closure_phases(vis, minimal=True).count() == 3


def test_triangles_without_short_sides(spark):
    vis = table(spark, (0.0,)).withColumn("u", F.when((F.col("t1") == "A") & (F.col("t2") == "B"), 0.1).otherwise(F.col("u")))
    assert sorted((r["t1"], r["t2"], r["t3"]) for r in closure.triangles_without_short(vis, 1.0, minimal=False).collect()) == [("A", "C", "D"), ("B", "C", "D")]
    assert [(r["t1"], r["t2"], r["t3"]) for r in closure.triangles_without_short(vis, 1.0).collect()] == [("A", "C", "D")]


def test_merging_and_common_rows(spark):
    one, two = table(spark), table(spark, (1.0, 2.0), sigma=0.05, seed=2)
    merged = tables.merge_observations([(two, 57850), (one, 57849)])
    assert merged.count() == 24 and sorted({r["time"] for r in merged.select("time").collect()}) == [0.0, 1.0, 25.0, 26.0]
    same = tables.merge_observations([(one, 57849), (two, 57849)])
    assert same.count() == 18 and {r["sigma"] for r in same.filter("time = 1").collect()} == {0.05}
    assert tables.common_rows(one, two, 0.01).count() == 6 and tables.common_rows(one, two, 0.01, "uvdist").count() == 12
    assert tables.common_rows(one.unionByName(one), two, 0.01, once=True).count() == 6
    later = two.withColumn("time", F.col("time") - 1.0)
    assert tables.common_rows(one, later, 0.01, "gmst").count() == 12 and tables.common_rows(one, later, 0.01, "gmst", offset=3.0).count() == 0
    stations = spark.createDataFrame([("A", 0.0, 0.0, 0.0), ("B", 5.0, 0.0, 0.0), ("C", 9.0, 0.0, 0.0)], "site string, x double, y double, z double")
    assert {r["site"]: r["cluster"] for r in tables.station_clusters(stations, 6.0).collect()} == {"A": 0, "B": 0, "C": 1}
    assert tables.merge_stations(stations, stations).count() == 3


def test_simulator_files(spark, tmp_path):
    (tmp_path / "i.txt").write_text("# x\n0.5 A B 1e9 2e9 1.0 0.5 0.1\n0.5,A,C,1e9,2e9,2.0,0.5,0.1\n")
    (tmp_path / "q.txt").write_text("0.5 A B 1e9 2e9 0.25 0.0 0.2\n")
    got = {r["t2"]: r for r in tables.joined_products(spark, {"i": str(tmp_path / "i.txt"), "q": str(tmp_path / "q.txt")}).collect()}
    assert (got["B"]["vis_re"], got["B"]["qvis_re"], got["B"]["qsigma"], got["C"]["vis_re"], got["C"]["qvis_re"]) == (1.0, 0.25, 0.2, 2.0, None)
