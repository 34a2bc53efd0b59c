"""Operators against values computed by hand or by plain code, apart from any SQL."""

import cmath
import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from fringelake.operators import chisquares, closure, geometry, images, polarimetry, simulation, tables
from fringelake.operators import visibility as V

VIS = "time double, tint double, t1 string, t2 string, tau1 double, tau2 double, u double, v double, vis_re double, vis_im double, sigma double"
STOKES = VIS + ", qvis_re double, qvis_im double, uvis_re double, uvis_im double, vvis_re double, vvis_im double, qsigma double, usigma double, vsigma double"


def row(t, a, b, z, s=0.1, u=1.0, v=2.0):
    return (t, 10.0, a, b, 0.1, 0.2, u, v, z.real, z.imag, s)


def stokes(spark):
    i, q, u, v = 3 + 1j, 0.4 - 0.2j, 0.1 + 0.3j, -0.2 + 0.1j
    return i, q, u, v, spark.createDataFrame([(*row(0.0, "A", "B", i), q.real, q.imag, u.real, u.imag, v.real, v.imag, 0.2, 0.3, 0.4)], STOKES)


def test_polarimetric_quantities(spark):
    i, q, u, v, vis = stokes(spark)
    want = {"p": q + 1j * u, "m": (q + 1j * u) / i, "rr": i + v, "ll": i - v, "rl": q + 1j * u, "lr": q - 1j * u, "rrll": (i + v) / (i - v)}
    twice = 2 * math.atan2(1.0, 2.0)
    want |= {"e": math.cos(twice) * q + math.sin(twice) * u, "b": -math.sin(twice) * q + math.cos(twice) * u}
    circ = polarimetry.switch(vis, "circ")
    for family, z in want.items():
        for table, polrep in ((vis, "stokes"), (circ, "circ")):
            r = polarimetry.unpack(table, family, polrep).first()
            assert abs(complex(r["re"], r["im"]) - z) < 1e-12 and abs(r["amp"] - abs(z)) < 1e-12
            assert abs(r["phase"] - math.degrees(cmath.phase(z))) < 1e-8 and abs(r["snr"] * r["sigma"] - abs(z)) < 1e-12
    back = polarimetry.switch(circ, "stokes").first()
    assert abs(complex(back["uvis_re"], back["uvis_im"]) - u) < 1e-12 and abs(back["sigma"] - 0.5 * math.sqrt(2 * (0.01 + 0.16))) < 1e-12


def test_a_missing_hand_is_replaced(spark):
    *_, vis = stokes(spark)
    circ = polarimetry.switch(vis, "circ").withColumns({"rrvis_re": F.lit(None).cast("double"), "rrvis_im": F.lit(None).cast("double")})
    r, left = polarimetry.switch(circ, "stokes").first(), circ.first()
    assert (r["vis_re"], r["vis_im"], r["sigma"]) == (left["llvis_re"], left["llvis_im"], left["llsigma"])
    alone = vis.withColumns({"vvis_re": F.lit(None).cast("double"), "vvis_im": F.lit(None).cast("double")})
    one = polarimetry.switch(alone, "circ", "R").first()
    assert one["rrvis_re"] == 3.0 and one["llvis_re"] is None and one["rrsigma"] == 0.1


def test_conjugates_exchange_cross_hands(spark):
    *_, vis = stokes(spark)
    circ = polarimetry.switch(vis, "circ")
    own, other = sorted(V.conjugates(circ).collect(), key=lambda r: r["t1"])
    assert (other["t1"], other["tau1"], other["u"]) == ("B", 0.2, -1.0)
    assert (other["rlvis_re"], other["rlvis_im"]) == (own["lrvis_re"], -own["lrvis_im"]) and (other["rrvis_re"], other["rrvis_im"]) == (own["rrvis_re"], -own["rrvis_im"])


def test_gains_of_absent_and_single_stations(spark):
    vis = spark.createDataFrame([row(1.0, "A", "B", 1 + 1j), row(1.0, "A", "C", 2 + 0j), row(9.0, "A", "B", 1 + 0j)], VIS)
    gains = spark.createDataFrame([("A", 0.0, 2.0, 0.0), ("A", 2.0, 4.0, 2.0), ("B", 5.0, 0.0, 1.0)], "site string, time double, g_re double, g_im double")
    got = {(r["time"], r["t2"]): r for r in V.apply_gains(vis, gains).collect()}
    g = 3 + 1j
    z = (1 + 1j) * g * (-1j)
    assert abs(complex(got[1.0, "B"]["vis_re"], got[1.0, "B"]["vis_im"]) - z) < 1e-12 and abs(got[1.0, "B"]["sigma"] - 0.1 * abs(g)) < 1e-12
    assert abs(complex(got[1.0, "C"]["vis_re"], got[1.0, "C"]["vis_im"]) - 2 * g) < 1e-12
    assert got[9.0, "B"]["vis_re"] is None


def test_moving_average_is_at_the_middle(spark):
    vis = spark.createDataFrame([row(t / 3600, "A", "B", complex(t)) for t in (0.0, 50.0, 100.0, 150.0)], VIS)
    got = sorted((round(r["time"] * 3600, 6), r["vis_re"], r["n"]) for r in V.moving(vis, 100).collect())
    assert got == [(-50.0, 0.0, 1), (0.0, 25.0, 2), (50.0, 75.0, 2), (100.0, 125.0, 2)]


def test_scan_intervals_have_a_margin(spark):
    vis = spark.createDataFrame([row(t, "A", "B", 1 + 0j) for t in (0.999995, 1.0, 2.0, 2.000005, 2.1)], VIS)
    scans = spark.createDataFrame([(0, 1.0, 2.0)], "scan_id long, t_start double, t_stop double")
    assert sorted(r["time"] for r in V.in_scans(vis, scans).collect()) == [0.999995, 1.0, 2.0, 2.000005]


def array(spark, n=6, lost=()):
    rng = np.random.default_rng(3)
    z = {(a, b): complex(*rng.normal(2, 1, 2)) for a, b in itertools.combinations("ABCDEF"[:n], 2) if (a, b) not in lost}
    return z, spark.createDataFrame([row(0.0, a, b, x, 0.3) for (a, b), x in z.items()], VIS)


def amplitude(z, a, b, debias):
    x = abs(z[min(a, b), max(a, b)])
    return (math.sqrt(x * x - 0.09) if x > 0.3 else 0.3) if debias else x


def test_all_quadrangles(spark):
    z, vis = array(spark, lost={("B", "D")})
    want = {}
    for s in itertools.combinations("ABCDEF", 4):
        for q in (s, (s[0], s[2], s[1], s[3]), (s[0], s[1], s[3], s[2])):
            legs = [(q[0], q[1]), (q[2], q[3]), (q[0], q[3]), (q[1], q[2])]
            if all((min(x), max(x)) in z for x in legs):
                a = [amplitude(z, *x, True) for x in legs]
                want[q] = a[0] * a[1] / (a[2] * a[3]) / (1 + 0.09 / a[2] ** 2 + 0.09 / a[3] ** 2)
    got = {(r["t1"], r["t2"], r["t3"], r["t4"]): r["camp"] for r in closure.closure_amplitudes(vis).collect()}
    assert got.keys() == want.keys() and all(abs(got[q] - want[q]) < 1e-9 for q in want)


def test_minimal_quadrangles(spark):
    for n in (3, 4, 5, 6):
        z, vis = array(spark, n)
        got = closure.closure_amplitudes(vis, "min", "logcamp", debias=False).collect()
        assert len(got) == n * (n - 3) // 2  # independent closure amplitudes of n stations
        names = "ABCDEF"[:n]
        index = {k: i for i, k in enumerate(itertools.combinations(names, 2))}
        rows = np.zeros((len(got), len(index)))
        for i, r in enumerate(got):
            q = [r[f"t{k}"] for k in "1234"]
            for (a, b), sign in (((0, 1), 1), ((2, 3), 1), ((0, 3), -1), ((1, 2), -1)):
                rows[i, index[min(q[a], q[b]), max(q[a], q[b])]] += sign
        assert len(got) == 0 or np.linalg.matrix_rank(rows) == len(got)


def test_chi_squares(spark):
    z, vis = array(spark, 5)
    m = {k: x * cmath.exp(0.1j * i) * (1 + 0.02 * i) for i, (k, x) in enumerate(z.items())}
    table = vis.join(spark.createDataFrame([(a, b, x.real, x.imag) for (a, b), x in m.items()], "t1 string, t2 string, mod_re double, mod_im double"), ["t1", "t2"])
    n = len(z)
    first = lambda d: d.first()["chisq"]
    assert abs(first(chisquares.visibilities(table)) - sum(abs(z[k] - m[k]) ** 2 for k in z) / 0.09 / 2 / n) < 1e-9
    assert abs(first(chisquares.amplitudes(table)) - sum((abs(z[k]) - abs(m[k])) ** 2 for k in z) / 0.09 / n) < 1e-9
    assert abs(first(chisquares.amplitudes(table, log=True)) - sum((math.log(abs(z[k])) - math.log(abs(m[k]))) ** 2 * abs(z[k]) ** 2 for k in z) / 0.09 / n) < 1e-9
    tri = list(itertools.combinations("ABCDE", 3))
    b = lambda y, t: y[t[0], t[1]] * y[t[1], t[2]] * y[t[0], t[2]].conjugate()
    rel = lambda t: 0.09 * sum(1 / abs(z[k]) ** 2 for k in itertools.combinations(t, 2))
    assert abs(first(chisquares.bispectrum(table)) - sum(abs(b(z, t) - b(m, t)) ** 2 / (abs(b(z, t)) ** 2 * rel(t)) for t in tri) / 2 / len(tri)) < 1e-9
    assert abs(first(chisquares.closure_phase(table)) - 2 * sum((1 - math.cos(cmath.phase(b(z, t)) - cmath.phase(b(m, t)))) / rel(t) for t in tri) / len(tri)) < 1e-9


def test_uv_of_an_equatorial_baseline(spark):
    source = geometry.Source(ra=0.0, dec=0.0, frequency=geometry.LIGHT, mjd=57854)  # wavelengths of a metre
    stations = spark.createDataFrame([("A", 0.0, 1000.0, 0.0, 1.0), ("B", 0.0, 0.0, 500.0, 1.0)], "site string, x double, y double, z double, sefd double")
    vis = spark.createDataFrame([row(0.0, "A", "B", 1 + 0j)], VIS)
    r = geometry.recompute_uv(vis, stations, source).first()
    angle = vis.select(geometry.theta(geometry.gmst(F.col("time"), 57854), source).alias("a")).first()["a"]
    assert abs(r["u"] - 1000 * math.cos(angle)) < 1e-6 and abs(r["v"] + 500) < 1e-6


def test_sidereal_time(spark):
    # At J2000 (2000-01-01 12:00 UT1) mean sidereal time is 18.697374558 h; a day gains 0.0657098244 h.
    got = spark.range(1).select(geometry.gmst(F.lit(12.0), 51544).alias("a"), geometry.gmst(F.lit(12.0), 51545).alias("b"), geometry.utc(geometry.gmst(F.lit(7.5), 51544), 51544).alias("c")).first()
    assert abs(got["a"] - 18.697374558) < 1e-5 and abs(got["b"] - got["a"] - 0.0657098244) < 1e-6 and abs(got["c"] - 7.5) < 1e-4


def test_image_transform_and_gaussian(spark):
    rng = np.random.default_rng(1)
    picture = rng.random((3, 5))
    vis = spark.createDataFrame([row(0.0, "A", "B", 0j, u=1e8, v=-3e8), row(1.0, "A", "B", 0j, u=2e9, v=1e9)], VIS)
    for r in simulation.image_visibilities(vis, picture, 1e-10).collect():
        want = sum(picture[j, i] * cmath.exp(2j * math.pi * (r["u"] * (2 - i) * 1e-10 + r["v"] * (1 - j) * 1e-10)) for j in range(3) for i in range(5))
        assert abs(complex(r["vis_re"], r["vis_im"]) - want) < 1e-9
    re, im = simulation.gaussian(2.0, 1e-10, 1e-10, 0.3)
    r = vis.select(re.alias("re"), im.alias("im"), (V.gaussian_model(2.0, 1e-10)).alias("round")).first()
    assert abs(r["re"] - r["round"]) < 1e-9 and r["im"] == 0


def test_noise_is_gaussian_and_repeatable(spark):
    vis = spark.range(20000).select((F.col("id") / 3600).alias("time"), F.lit("A").alias("t1"), F.lit("B").alias("t2"), F.lit(0.0).alias("vis_re"), F.lit(0.0).alias("vis_im"), F.lit(2.0).alias("sigma"))
    r = simulation.add_noise(vis, 1).agg(F.avg("vis_re").alias("m"), F.stddev("vis_re").alias("s"), F.stddev("vis_im").alias("t"), F.corr("vis_re", "vis_im").alias("c")).first()
    assert abs(r["m"]) < 0.06 and abs(r["s"] - 2) < 0.05 and abs(r["t"] - 2) < 0.05 and abs(r["c"]) < 0.03
    one, two = (sorted(r["vis_re"] for r in simulation.add_noise(t, 1).collect()) for t in (vis, vis.repartition(7)))
    assert one == two


def test_image_terms(spark):
    rng = np.random.default_rng(2)
    n, flux, psize, beam = 4, 1.5, 0.5, 2.0
    x, p = rng.random(16) + 0.1, rng.random(16) + 0.1
    got = images.priors(spark.createDataFrame([(1, x.tolist(), p.tolist())], "image_id int, pix array<double>, prior array<double>"), n, flux, psize, beam, alpha=2.0).first()
    im = np.pad(x.reshape(n, n), ((0, 1), (0, 1)))
    dx, dy = im[:n, 1:] - im[:n, :n], im[1:, :n] - im[:n, :n]
    yy, xx = (np.indices((n, n)) - (n - 1) / 2) * psize
    pic = x.reshape(n, n)
    x0, y0 = (pic * xx).sum() / flux, (pic * yy).sum() / flux
    a = 2.0
    want = {
        "flux": -((x.sum() - flux) ** 2) / flux**2, "simple": -(x * np.log(x / p)).sum() / flux, "gs": (x - p - x * np.log(x / p)).sum() / flux, "l1": -x.sum() / flux,
        "tv": -np.sqrt(dx**2 + dy**2).sum() / (flux * psize / beam), "tv2": -(dx**2 + dy**2).sum() / (psize**4 * flux**2 / beam**4), "patch": -0.5 * ((x - p) ** 2).sum() / flux**2,
        "compact": -(pic * ((xx - x0) ** 2 + (yy - y0) ** 2)).sum() / (flux * beam**2), "compact2": -(pic**2 * (xx**2 + yy**2)).sum() / (flux**2 * beam**2),
        "la": -(2 / np.pi * (1 + a) / a * np.arctan(np.pi * a / 2 * x / flux)).sum() / ((1 / (1 + a) + (beam / psize) ** 2 * a) / (a + 1 / (1 + a))),
        "cm": -((pic * psize * (2 - np.indices((n, n))[1])).sum() ** 2 + (pic * psize * (2 - np.indices((n, n))[0])).sum() ** 2) / (beam**2 * flux**2),
    }
    assert all(abs(got[k] - v) < 1e-9 * max(1, abs(v)) for k, v in want.items())


def test_arrangement(spark):
    vis = spark.createDataFrame([row(0.0, "B", "A", 1 + 2j), row(0.0, "A", "C", 3 + 0j), row(0.5, "A", "B", 1 + 0j)], VIS)
    r = tables.canonical(vis).filter("time = 0 and t2 = 'B'").first()
    assert (r["t1"], r["tau1"], r["u"], r["vis_im"]) == ("A", 0.2, -1.0, -2.0)
    assert sorted((r["t1"], r["t2"], r["n"]) for r in tables.baseline_groups(vis).collect()) == [("A", "B", 2), ("A", "C", 1)]
    assert sorted(r["n"] for r in tables.time_groups(vis, 1800.0).collect()) == [1, 2]
    assert tables.merge(vis, vis.drop("sigma")).filter("sigma is null").count() == 3


def test_empty_tables(spark):
    vis = spark.createDataFrame([], VIS)
    assert closure.closure_amplitudes(vis).count() == closure.closure_amplitudes(vis, "min").count() == tables.canonical(vis).count() == 0
    assert simulation.image_visibilities(vis, np.ones((2, 2)), 1.0).count() == 0 and V.dirty_beam(vis, 4, 1.0).filter("value is not null").count() == 0
