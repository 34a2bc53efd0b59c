"""Solvers against gains and leakages that were put in."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringelake.functions.minimise import lbfgs
from fringelake.operators import calibration, jones

SITES = ("A", "B", "C", "D")


def test_lbfgs_finds_a_curved_valley():
    f = lambda x: (100 * (x[1] - x[0] ** 2) ** 2 + (1 - x[0]) ** 2, np.array([-400 * x[0] * (x[1] - x[0] ** 2) - 2 * (1 - x[0]), 200 * (x[1] - x[0] ** 2)]))
    assert np.allclose(lbfgs(f, np.array([-1.2, 1.0]), 500, tolerance=1e-16), [1, 1], atol=1e-4)


def corrupted(spark, gains, sigma=1e-3, repeats=20):
    rng = np.random.default_rng(1)
    rows = []
    for scan in (0, 1):
        for k in range(repeats):
            for i in range(4):
                for j in range(i + 1, 4):
                    m = complex(*rng.normal(1, 0.3, 2))
                    z = gains[scan][i] * np.conj(gains[scan][j]) * m
                    rows.append((scan, scan + k * 1e-3, SITES[i], SITES[j], float(z.real), float(z.imag), m.real, m.imag, sigma))
    return spark.createDataFrame(rows, "scan_id long, time double, t1 string, t2 string, vis_re double, vis_im double, mod_re double, mod_im double, sigma double")


@pytest.mark.parametrize("method", ["both", "phase", "amp"])
def test_self_calibration_takes_gains_out(spark, method):
    rng = np.random.default_rng(2)
    gains = np.exp((rng.normal(0, 0.1, (2, 4)) if method != "phase" else 0) + 1j * (rng.normal(0, 0.4, (2, 4)) if method != "amp" else 0))
    vis = corrupted(spark, gains)
    found = calibration.self_calibrate(vis, method)
    assert found.count() == 8
    for r in calibration.apply_scan_gains(vis, found).collect():
        assert abs(complex(r["vis_re"], r["vis_im"]) - complex(r["mod_re"], r["mod_im"])) < 2e-3
    fixed = calibration.self_calibrate(vis, method, sites=["A"])
    assert {r["site"] for r in fixed.collect()} == {"A"}


def test_self_calibration_without_usable_rows(spark):
    vis = corrupted(spark, np.ones((2, 4)))
    assert calibration.self_calibrate(vis.filter("false")).count() == 0
    assert calibration.self_calibrate(vis.withColumn("mod_re", F.lit(None).cast("double"))).count() == 0
    assert calibration.self_calibrate(vis, sites=[]).count() == 0


def test_network_calibration(spark):
    rng = np.random.default_rng(4)
    gains = np.exp(rng.normal(0, 0.1, (2, 4)) + 1j * rng.normal(0, 0.2, (2, 4)))
    gains[:, 2:] = 1.0  # C and D stand alone
    rows, truth = [], {}
    for scan in (0, 1):
        for k in range(5):
            far = {s: complex(*rng.normal(1, 0.5, 2)) for s in ("C", "D")}
            apart = complex(*rng.normal(1, 0.5, 2))
            for i, j in ((0, 1), (0, 2), (1, 2), (0, 3), (1, 3), (2, 3)):
                m = 2.0 + 0j if (i, j) == (0, 1) else apart if i == 2 else far[SITES[j]]
                z = gains[scan][i] * np.conj(gains[scan][j]) * m
                truth[scan, k, SITES[i], SITES[j]] = m
                a, b, z = (SITES[j], SITES[i], z.conjugate()) if k % 2 else (SITES[i], SITES[j], z)
                rows.append((scan, float(k), a, b, float(z.real), float(z.imag), 1e-3))
    vis = spark.createDataFrame(rows, "scan_id long, time double, t1 string, t2 string, vis_re double, vis_im double, sigma double")
    found = calibration.network_calibrate(vis, spark.createDataFrame([("A", 1), ("B", 1)], "site string, cluster int"), 2.0)
    assert {r["site"] for r in found.collect()} == {"A", "B"}
    for r in calibration.apply_scan_gains(vis, found).filter("(t1 = 'A' and t2 = 'B') or (t1 = 'B' and t2 = 'A')").collect():
        assert abs(complex(r["vis_re"], r["vis_im"]) - 2.0) < 0.01
    # The common phase and gain of A and B against the rest are not seen: only their product with each other is.
    fixed = {(r["scan_id"], r["site"]): complex(r["g_re"], r["g_im"]) for r in found.collect()}
    for scan in (0, 1):
        assert abs(fixed[scan, "A"] / fixed[scan, "B"] - gains[scan][0] / gains[scan][1]) < 0.01
    alone = calibration.network_calibrate(vis, spark.createDataFrame([("A", 1)], "site string, cluster int"), 2.0)
    assert alone.count() == 0


def test_hand_ratios(spark):
    ratio = np.exp(np.array([0.1, -0.05, 0.02, 0.0]) + 0.3j * np.array([1, -1, 0.5, 0]))
    vis = corrupted(spark, np.array([ratio, ratio])).selectExpr("scan_id", "t1", "t2", "vis_re rrvis_re", "vis_im rrvis_im", "mod_re llvis_re", "mod_im llvis_im", "sigma rrsigma")
    found = {r["site"]: complex(r["g_re"], r["g_im"]) for r in calibration.hand_ratios(vis).filter("scan_id = 0").collect()}
    assert abs(found["A"] * np.conj(found["B"]) - ratio[0] * np.conj(ratio[1])) < 1e-3


def circular(spark, rows):
    return spark.createDataFrame(rows, "time double, t1 string, t2 string, " + ", ".join(f"{h}vis_{x} double" for h in jones.HANDS for x in ("re", "im")) + ", " + ", ".join(f"{h}sigma double" for h in jones.HANDS))


def test_jones_matrices(spark):
    rng = np.random.default_rng(5)
    v = {(t, a, b): rng.normal(size=(2, 2)) + 1j * rng.normal(size=(2, 2)) for t in (0.0, 1.0) for a, b in (("A", "B"), ("B", "C"))}
    parts = lambda m: [float(x) for z in m.ravel() for x in (z.real, z.imag)]
    vis = circular(spark, [(*k, *parts(m), 1.0, 2.0, 3.0, 4.0) for k, m in v.items()])
    numbers = {(s, t): (rng.normal(1, 0.1, 4), rng.normal(0, 0.1, 4), float(rng.normal())) for s in "ABC" for t in (0.0, 1.0)}
    stations = spark.createDataFrame([(s, t, *map(float, g), *map(float, d), f) for (s, t), (g, d, f) in numbers.items()], "site string, time double, r_re double, r_im double, l_re double, l_im double, dr_re double, dr_im double, dl_re double, dl_im double, feed double")

    def matrix(s, t):
        g, d, f = numbers[s, t]
        r, left, dr, dl = complex(*g[:2]), complex(*g[2:]), complex(*d[:2]), complex(*d[2:])
        return np.diag([r, left]) @ np.array([[1, dr], [dl, 1]]) @ np.diag([np.exp(-1j * f), np.exp(1j * f)])

    j = jones.matrices(stations)
    broken = jones.apply(vis, j, errors=True)
    for r in broken.collect():
        one, two = matrix(r["t1"], r["time"]), matrix(r["t2"], r["time"])
        want = one @ v[r["time"], r["t1"], r["t2"]] @ two.conj().T
        got = np.array([[complex(r["rrvis_re"], r["rrvis_im"]), complex(r["rlvis_re"], r["rlvis_im"])], [complex(r["lrvis_re"], r["lrvis_im"]), complex(r["llvis_re"], r["llvis_im"])]])
        assert np.allclose(got, want)
        var = np.abs(one) ** 2 @ np.array([[1, 4], [9, 16]]) @ (np.abs(two) ** 2).T
        assert np.allclose([[r["rrsigma"], r["rlsigma"]], [r["lrsigma"], r["llsigma"]]], np.sqrt(var))
    for r in jones.apply(broken, jones.invert(j)).collect():
        assert np.allclose([r[f"{h}vis_{x}"] for h in jones.HANDS for x in ("re", "im")], parts(v[r["time"], r["t1"], r["t2"]]))


@pytest.mark.parametrize("turned", [False, True])
def test_leakages(spark, turned):
    rng = np.random.default_rng(6)
    d = {s: (complex(*rng.normal(0, 0.05, 2)), complex(*rng.normal(0, 0.05, 2))) for s in SITES}
    rows = []
    for k in range(30):
        for i in range(4):
            for j in range(i + 1, 4):
                a, b = SITES[i], SITES[j]
                rr, ll, rl, lr = (complex(*rng.normal(0, 1, 2)) for _ in range(4))
                f1, f2 = rng.normal(0, 1, 2) if turned else (0.0, 0.0)
                rl1 = rl + d[a][0] * np.exp(2j * f1) * ll + np.conj(d[b][1] * np.exp(-2j * f2)) * rr
                lr1 = lr + d[a][1] * np.exp(-2j * f1) * rr + np.conj(d[b][0] * np.exp(2j * f2)) * ll
                rows.append((a, b, *(float(x) for z in (rl1, lr1, rr, ll, rl, lr) for x in (z.real, z.imag)), 0.1, 0.2, float(f1), float(f2)))
    names = [f"{n}_{x}" for n in ("rlvis", "lrvis", "modrr", "modll", "modrl", "modlr") for x in ("re", "im")]
    circ = spark.createDataFrame(rows, "t1 string, t2 string, " + ", ".join(f"{n} double" for n in names) + ", rlsigma double, lrsigma double, turn1 double, turn2 double")
    found = calibration.leakages(circ if turned else circ.drop("turn1", "turn2")).collect()
    for r in found:
        assert abs(complex(r["dr_re"], r["dr_im"]) - d[r["site"]][0]) < 1e-9 and abs(complex(r["dl_re"], r["dl_im"]) - d[r["site"]][1]) < 1e-9
    assert len(found) == 4 and calibration.leakages(circ.filter("false")).count() == 0


def test_gain_tables(spark):
    rows = [("A", t, 0.5 + 0.1 * k, 0.0, 1.0, 0.5) for k, t in enumerate((0.0, 0.1, 0.2, 5.0))]
    gains = spark.createDataFrame(rows, "site string, time double, r_re double, r_im double, l_re double, l_im double")
    inverse = calibration.invert_gains(gains).orderBy("time").first()
    assert (inverse["r_re"], inverse["r_im"]) == (2.0, 0.0) and abs(complex(inverse["l_re"], inverse["l_im"]) - 1 / (1 + 0.5j)) < 1e-12
    assert [round(r["r_re"], 9) for r in calibration.raise_gains(gains).orderBy("time").collect()] == [0.75, 0.9, 1.05, 1.2]
    assert calibration.raise_gains(gains, ["B"]).orderBy("time").first()["r_re"] == 0.5
    scans = spark.createDataFrame([(0.0, 0.15), (0.18, 1.0), (2.0, 3.0)], "t_start double, t_stop double")
    means = calibration.average_gains(gains, scans).orderBy("time").collect()
    assert [(round(r["time"], 6), round(r["r_re"], 6), r["l_im"]) for r in means] == [(0.075, 0.55, 0.5), (0.59, 0.7, 0.5)]
    assert abs(calibration.average_gains(gains, scans, True).orderBy("time").first()["l_re"] - abs(1 + 0.5j)) < 1e-12
    padded = calibration.pad_gains(gains, 1.0, "endval").orderBy("time").collect()
    assert len(padded) == 8 and [round(r["r_re"], 6) for r in padded] == [0.5, 0.5, 0.6, 0.7, 0.7, 0.8, 0.8, 0.8]
    assert {round(r["r_re"], 6) for r in calibration.pad_gains(gains, 1.0, "one").collect()} == {0.5, 0.6, 0.7, 0.8, 1.0}
    assert calibration.pad_gains(gains, 1.0).orderBy("time").first()["r_re"] == 0.6


def test_noise_fraction(spark):
    rng = np.random.default_rng(7)
    z = rng.normal(3, 1, 4000) + 1j * rng.normal(0, 1, 4000)
    sigma = np.hypot(0.05, 0.2 * np.abs(z))
    data = z + sigma * (rng.normal(size=4000) + 1j * rng.normal(size=4000))
    vis = spark.createDataFrame([(float(d.real), float(d.imag), float(m.real), float(m.imag), 0.05) for d, m in zip(data, z, strict=True)], "vis_re double, vis_im double, mod_re double, mod_im double, sigma double")
    f = calibration.noise_fraction(vis)
    assert abs(np.mean(np.abs(data - z) ** 2 / (2 * (0.05**2 + f**2 * np.abs(data) ** 2))) - 1) < 1e-6 and 0.1 < f < 0.3
    assert calibration.noise_fraction(vis.withColumn("sigma", F.lit(100.0))) == 0.0 and calibration.noise_fraction(vis, most=0.01) == 0.01
    assert calibration.noise_fraction(vis.filter("false")) == 0.0
