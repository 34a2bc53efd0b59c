"""Terms, statistics, scalars and text formats against plain code."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringelake.functions import scalars
from fringelake.operators import closure, models, statistics, terms
from fringelake.sources import texts, visibilities


def value(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


def test_formats_and_dates(spark):
    lit = F.lit
    assert value(spark, scalars.ra_text(lit(12.5125)), scalars.dec_text(lit(-29.0078)), scalars.gmt_text(lit(25.5))) == ["12 h 30 m 45.0000 s", "-29 deg  0 m 28.0800 s", "01:30:0.0000"]
    mjd, hour = scalars.schedule_date(lit("2017y095d04h30m36s"))
    assert value(spark, mjd, hour) == [57848, 4.51]
    t = lit(datetime.datetime(2017, 4, 5, 1, 2, 3, 260000))
    assert value(spark, scalars.round_time(t, 0.1), scalars.round_time(t, 60.0)) == [datetime.datetime(2017, 4, 5, 1, 2, 3, 300000), datetime.datetime(2017, 4, 5, 1, 2)]
    names = [lit(x) for x in "abc"]
    orders = {"abc": 1, "acb": -1, "bac": -1, "bca": 1, "cab": 1, "cba": -1, "abd": None, "aab": None}
    assert value(spark, *[scalars.parity([lit(x) for x in o], names) for o in orders]) == list(orders.values())
    assert [scalars.power_of_two(x) for x in (0.3, 1, 2, 3, 64, 65)] == [1, 1, 2, 4, 64, 128]


def test_debiasing_and_errors(spark):
    lit = F.lit
    got = value(spark, scalars.debiased_closure_amplitude(lit(2.0), lit(2.0), lit(4.0)), scalars.debiased_log_closure_amplitude(lit(0.5), lit(1.0), lit(2.0), lit(4.0), lit(8.0)), scalars.fractional_error(lit(-2.0), lit(0.5), lit(0.2), lit(0.3), lit(0.4)), scalars.q_value(lit(2.0), lit(0.5), lit(0.3)), scalars.u_value(lit(2.0), lit(0.5), lit(0.3)))
    assert np.allclose(got, [2 / (1 + 1 / 4 + 1 / 16), 0.5 + 0.5 * (1 + 1 / 4 - 1 / 16 - 1 / 64), math.sqrt(0.09 + 0.16 + 0.01) / 2, math.cos(0.6), math.sin(0.6)])


@pytest.mark.parametrize("kind", scalars.PULSES[1:5])
def test_pulses_and_their_transforms(spark, kind):
    width = 2.0
    x = np.linspace(-12, 12, 4801)
    table = spark.createDataFrame([(float(a),) for a in x], "x double")
    p = np.array([r[0] for r in table.select(scalars.pulse(kind, F.col("x"), width), "x").orderBy("x").collect()])
    for omega in (0.0, 0.7, 2.3):
        (f,) = value(spark, scalars.pulse_transform(kind, F.lit(omega), width))
        assert abs((p * np.cos(omega * x)).sum() * (x[1] - x[0]) - f) < 3e-3


def test_numbers_by_hash(spark):
    got = spark.range(20000).select(scalars.hash_normal(F.col("id"), F.lit(1)).alias("x"), scalars.hash_uniform(F.col("id")).alias("u"), scalars.hash_choice(["a", "b"], F.col("id")).alias("c"))
    r = got.agg(F.avg("x"), F.stddev("x"), F.avg("u"), F.min("u"), F.max("u"), F.avg((F.col("c") == "a").cast("int"))).first()
    assert abs(r[0]) < 0.03 and abs(r[1] - 1) < 0.03 and abs(r[2] - 0.5) < 0.01 and 0 < r[3] and r[4] < 1 and abs(r[5] - 0.5) < 0.02
    assert got.orderBy("u").first() == got.repartition(3).orderBy("u").first()
    assert np.allclose(scalars.kernel_covariance(np.array([0.0, 1.0]), 2.0), [[1, math.exp(-1 / 8)], [math.exp(-1 / 8), 1]])


def test_circular_statistics(spark):
    angles = [170.0, -170.0, 175.0, float("nan"), None]
    table = spark.createDataFrame([(1, a) for a in angles] + [(2, 10.0), (3, None)], "g int, a double")
    rows = {r["g"]: r for r in table.groupBy("g").agg(statistics.circular_mean(F.col("a")).alias("m"), statistics.circular_deviation(F.col("a")).alias("s"), statistics.circular_error(F.col("a")).alias("e")).collect()}
    z = np.exp(1j * np.radians(angles[:3])).mean()
    assert abs(rows[1]["m"] - math.degrees(np.angle(z))) < 1e-9 and abs(rows[1]["s"] - math.degrees(math.sqrt(-2 * math.log(abs(z))))) < 1e-9 and abs(rows[1]["e"] * math.sqrt(3) - rows[1]["s"]) < 1e-9
    assert abs(rows[2]["m"] - 10) < 1e-9 and rows[2]["s"] is None and rows[3]["m"] is None


def test_bootstrap_intervals(spark):
    rng = np.random.default_rng(1)
    table = spark.createDataFrame([(g, float(x)) for g, s in ((0, 1.0), (1, 4.0)) for x in rng.normal(10, s, 400)], "g int, x double").coalesce(2)
    for statistic in ("mean", "rms"):
        for r in statistics.bootstrap(table, ["g"], "x", statistic, 100).collect():
            width = (1.0, 4.0)[r["g"]] / 20  # one deviation of the mean either way
            assert r["low"] < r["value"] < r["high"] and 1.2 * width < r["high"] - r["low"] < 3.0 * width
    turned = table.withColumn("x", F.pmod(F.col("x") + 350.0, F.lit(360.0)) - 180.0)
    assert all(r["low"] < r["value"] < r["high"] for r in statistics.bootstrap(turned.withColumn("x", F.col("x") + 180.0), ["g"], "x", "circular", 50).collect())
    assert statistics.bootstrap(table.filter("false"), ["g"], "x").count() == 0
    same = statistics.bootstrap(spark.createDataFrame([(1, 2.0)] * 5, "g int, x double"), ["g"], "x", "mean", 20).first()
    assert (same["value"], same["low"], same["high"]) == (2.0, 2.0, 2.0)


def test_variation_reports(spark):
    table = spark.createDataFrame([("A", t, a) for t, a in enumerate((170.0, -170.0, 180.0))] + [("B", 0, 1.0)], "t1 string, time int, a double")
    got = statistics.variation(table, ["t1"], "a", degrees=True).collect()
    assert [(r["t1"], r["variation"], r["n"]) for r in got] == [("A", 15.0, 2)]
    half = statistics.variation(table.withColumn("a", F.col("a") / 2), ["t1"], "a")
    assert statistics.compare_variation(statistics.variation(table, ["t1"], "a"), half, ["t1"]).first()["ratio"] == 2.0


def test_diagonal_closures(spark):
    rng = np.random.default_rng(2)
    sites = "ABCD"
    draws = 400
    base = [(a, b) for i, a in enumerate(sites) for b in sites[i + 1 :]]
    sigma = {b: float(s) for b, s in zip(base, rng.uniform(0.01, 0.05, 6), strict=True)}
    rows = []
    for t in range(draws):
        for a, b in base:
            z = 1 + sigma[a, b] * complex(*rng.normal(size=2))
            rows.append((float(t), a, b, 1.0, 1.0, z.real, z.imag, sigma[a, b]))
    vis = spark.createDataFrame(rows, "time double, t1 string, t2 string, u double, v double, vis_re double, vis_im double, sigma double")
    level = vis.withColumns({"vis_re": F.lit(1.0), "vis_im": F.lit(0.0)})
    for kind, table in (("cphase", closure.closure_phases(vis, minimal=True)), ("logcamp", closure.closure_amplitudes(vis, "min", "logcamp", debias=False))):
        got = statistics.diagonal_closures(table, level, kind).toPandas()
        per = got.pivot(index="time", columns="k", values="value").to_numpy()
        want = got.groupby("k")["sigma"].first().to_numpy()
        assert per.shape == (draws, 3 if kind == "cphase" else 2)
        assert np.allclose(per.std(0) / want, 1, atol=0.15) and np.abs(np.corrcoef(per.T) - np.eye(per.shape[1])).max() < 0.2


def test_polarised_and_spectral_terms(spark):
    rng = np.random.default_rng(3)
    i, q, u, v = rng.uniform(1, 2, 16), *rng.uniform(-0.4, 0.4, (3, 16))
    images = spark.createDataFrame([(0, *(x.tolist() for x in (i, q, u, v)), [0.5] * 16)], "image_id int, i array<double>, q array<double>, u array<double>, v array<double>, prior array<double>")
    m = np.hypot(q, u) / i
    steps = lambda a: (np.diff(a.reshape(4, 4), axis=1, append=0), np.diff(a.reshape(4, 4), axis=0, append=0))
    var = lambda *a, soft=0.0: np.sqrt(sum(d**2 for x in a for d in steps(x)) + soft).sum()
    got = terms.polarised(images, 4, 20.0, 0.5, 0.5, 1.0).first()
    want = {"msimple": -(i * np.log(m)).sum() / 20, "hw": -(i * ((1 + m) / 2 * np.log((1 + m) / 2) + (1 - m) / 2 * np.log((1 - m) / 2))).sum() / 20, "ptv": -var(q, u) / 10, "vflux": -((v.sum() - 0.5) ** 2) / 0.25, "l1v": -np.abs(v).sum() / 0.5, "l2v": -(v**2).sum() / 0.25, "vtv": -var(v) / 0.25, "vtv2": -sum((d**2).sum() for d in steps(v)) / (0.5**4 * 0.25)}
    assert all(abs(got[k] - x) < 1e-9 for k, x in want.items())
    s = terms.spectral(images.withColumn("pix", F.col("v")), 4).first()
    assert abs(s["l2"] + ((v - 0.5) ** 2).mean()) < 1e-12 and abs(s["tv"] + var(v, soft=1e-10) / 16) < 1e-12
    t = terms.polarised_totals(images).first()
    assert np.allclose([t["linear"], t["circular"], t["angle"], t["mean_linear"], t["mean_circular"]], [math.hypot(q.sum(), u.sum()) / i.sum(), v.sum() / i.sum(), math.atan2(u.sum(), q.sum()) / 2, (m * i).sum() / i.sum(), np.abs(v).sum() / i.sum()])
    y, x = np.mgrid[:4, :4]
    x, y = 1.5 - x, 1.5 - y
    r, a = np.hypot(x, y).ravel(), np.arctan2(x, y).ravel()
    inside = (r >= 1) & (r <= 2)
    for row in terms.azimuthal_modes(images, 4, [0, 2], 1.0, 2.0).collect():
        z = ((q + 1j * u) * np.exp(-1j * row["m"] * a))[inside].sum() / i[inside].sum()
        assert abs(complex(row["re"], row["im"]) - z) < 1e-12


def test_movie_terms(spark):
    f = np.random.default_rng(4).uniform(0, 1, (5, 9))
    frames = spark.createDataFrame([(0, k, f[k].tolist()) for k in (3, 0, 4, 1, 2)] + [(1, 0, [1.0])], "movie_id int, frame int, pix array<double>")
    ep, mean = 1e-10, f.mean(0)
    log = lambda a, b: np.log((a + ep) / (b + ep))
    want = {"D": ((np.diff(f, axis=0) ** 2).sum() / 5, ((f - mean) ** 2).sum() / 5), "KL": ((f[1:] * log(f[1:], f[:-1])).sum() / 5, (f * log(f, mean)).sum() / 5), "SymKL": ((0.5 * (f[1:] - f[:-1]) * log(f[1:], f[:-1])).sum() / 5, (0.5 * (f - mean) * log(f, mean)).sum() / 5)}
    for metric, (a, b) in want.items():
        one, two = (dict(t.collect()) for t in (terms.movie_steps(frames, metric), terms.movie_spread(frames, metric)))
        assert abs(one[0] - a) < 1e-9 and abs(two[0] - b) < 1e-9 and one[1] == two[1] == 0.0
    assert abs(dict(terms.movie_flux_steps(frames).collect())[0] - (np.diff(f.sum(1)) ** 2).sum()) < 1e-9


def test_chi_squares_of_polarised_visibilities(spark):
    rng = np.random.default_rng(5)
    z = {n: rng.normal(1, 0.3, 20) + 1j * rng.normal(0, 0.3, 20) for n in ("vis", "qvis", "uvis", "vvis", "mod", "modq", "modu", "modv")}
    table = spark.createDataFrame([(*(float(p) for a in z.values() for p in (a[k].real, a[k].imag)), 0.1, 0.2, 0.3, 0.4) for k in range(20)], ", ".join(f"{n}_{p} double" for n in z for p in ("re", "im")) + ", sigma double, qsigma double, usigma double, vsigma double")
    p, w = z["qvis"] + 1j * z["uvis"], z["modq"] + 1j * z["modu"]
    m = p / z["vis"]
    error = (0.04 + 0.09 + 0.01 * np.abs(m) ** 2) / np.abs(z["vis"]) ** 2
    want = {"pvis": (np.abs(p - w) ** 2 / 0.13).sum() / 40, "m": (np.abs(m - w / z["mod"]) ** 2 / error).sum() / 40, "vvis": (np.abs(z["vvis"] - z["modv"]) ** 2 / 0.16).sum() / 40}
    for kind, x in want.items():
        assert abs(terms.chisq_polarised(table, kind).first()[0] - x) < 1e-9


VEX = """VEX_rev = 1.5;
$SOURCE;
def M87;
  source_name = M87; ra = 12h30m49.4s; dec = 12d23'28.0";
enddef;
def SGRA;
  source_name = SGRA; ra = 17h45m40.0s; dec = -29d00'28.1";
enddef;
$FREQ;
def one;
*   chan_def = : 1 MHz : U : 1 MHz : &CH00 ;
    chan_def = : 227100.00 MHz : U : 1856.00 MHz : &CH01 : &BBC01 : &U_cal;
enddef;
$SITE;
def ALMA;
  site_type = fixed; site_name = ALMA; site_ID = Aa;
  site_position = 2225061.164 m : -5440057.37 m : -2481681.15 m;
enddef;
$SCHED;
scan No0001;
  start=2017y095d22h31m00s; mode=EHT; source=M87;
  station=Aa: 0 sec: 420 sec: 0.0 GB: : : 1;
  station=Pv: 5 sec: 300 sec: 0.0 GB: : : 1;
endscan;
"""


def test_schedules(spark, tmp_path):
    path = str(tmp_path / "a.vex")
    (tmp_path / "a.vex").write_text(VEX)
    a, b = texts.schedule_sources(spark, path).orderBy("source").collect()
    assert abs(a["ra"] - (12 + 30 / 60 + 49.4 / 3600)) < 1e-12 and abs(b["dec"] + 29 + 28.1 / 3600) < 1e-12
    assert [tuple(r) for r in texts.schedule_stations(spark, path, {"ALMA": 90.0}).collect()] == [("ALMA", "Aa", 2225061.164, -5440057.37, -2481681.15, 90.0)]
    assert [tuple(r) for r in texts.schedule_scans(spark, path).orderBy("site_id").collect()] == [("No0001", "M87", 57848, 22 + 31 / 60, "Aa", 0.0, 420.0), ("No0001", "M87", 57848, 22 + 31 / 60, "Pv", 5.0, 300.0)]
    assert texts.schedule_frequency(spark, path) == (227.1e9, 1.856e9)


def test_image_texts(spark, tmp_path):
    images = spark.createDataFrame([([float(k) for k in range(6)], [0.5] * 6)], "i array<double>, q array<double>")
    text = images.select(texts.image_text(F.lit("M 87"), F.lit(57848.5), F.lit(2.3e11), 3, 2, 1e-11, "i", "q")).first()[0]
    (tmp_path / "a.txt").write_text(text)
    (r,) = texts.read_images(spark, str(tmp_path / "*.txt")).collect()
    assert (r["source"], r["nx"], r["ny"], r["mjd"], r["rf"]) == ("M 87", 3, 2, 57848.5, 2.3e11) and abs(r["psize"] - 1e-11) < 1e-24
    assert r["ipix"] == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0] and r["qpix"] == [0.5] * 6 and r["vpix"] is None


def test_tables_stations_gains_and_models(spark, tmp_path):
    names, numbers = texts.TABLES["cphase"]
    table = spark.createDataFrame([(0.1, "A", "B", "C", *[k / 3 for k in range(8)]), (0.2, "A", "B", "D", *[-float(k) for k in range(7)], None)], "time double, " + ", ".join(f"{n} string" for n in names) + ", " + ", ".join(f"{n} double" for n in numbers))
    texts.write_table(table, str(tmp_path / "cp"), "cphase")
    back = texts.read_table(spark, str(tmp_path / "cp"), "cphase").orderBy("time").collect()
    assert back[0] == table.orderBy("time").first() and back[1]["sigmacp"] is None and back[1]["t3"] == "D"
    (tmp_path / "odd.txt").write_text("# x\n1 A B\n1 A B C 1 2 3 4 5 6 seven 8\n")
    odd = texts.read_table(spark, str(tmp_path / "odd.txt"), "cphase").collect()
    assert sorted((r["t1"] is None, r["cphase"]) for r in odd) == [(False, None), (True, None)]
    stations = spark.createDataFrame([("AA", *[k / 7 for k in range(12)])], "site string, " + ", ".join(f"{c} double" for c in texts.STATION_COLUMNS[1:]))
    texts.write_stations(stations, str(tmp_path / "st"))
    assert visibilities.read_stations(spark, str(tmp_path / "st")).collect() == stations.collect()
    gains = spark.createDataFrame([(s, t, 1.5, 0.5, 2.0, -0.5) for s in ("AA", "BB") for t in (0.0, 1.0)], "site string, time double, r_re double, r_im double, l_re double, l_im double")
    texts.write_gains(gains, str(tmp_path / "g"), square=True)
    back = visibilities.read_gains(spark, str(tmp_path / "g" / "site=AA"), square_root=True).orderBy("time").collect()
    assert len(back) == 2 and np.allclose([back[0][c] for c in ("r_re", "r_im", "l_re", "l_im")], [1.5, 0.5, 2.0, -0.5])
    parts = [models.Component("mring", 1.5, x=1e-10, d=3e-10, beta=(0.1 - 0.2j, 0.3j)), models.Component("point", 0.25)]
    (tmp_path / "m.txt").write_text("# a model\n" + "\n".join(texts.model_lines(parts)))
    assert texts.read_models(spark, str(tmp_path / "m.txt")) == parts
