"""Legs of closure tables: they close, they follow reorderings, and tables feed the writer and the imager."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringelake.operators import closure, imaging, simulation
from fringelake.sources import texts

PIXEL = 1e-10


@pytest.fixture(scope="module")
def vis(spark):
    rng = np.random.default_rng(2)
    rows = []
    for t in range(12):
        at = {s: rng.uniform(-1.5e9, 1.5e9, 2) for s in "ABCDE"}
        for i, a in enumerate("ABCDE"):
            for b in "ABCDE"[i + 1 :]:
                u, v = at[a] - at[b]
                rows.append((float(t), a, b, float(u), float(v), 0.05))
    image = np.exp(-((np.indices((8, 8))[0] - 3) ** 2 + (np.indices((8, 8))[1] - 5) ** 2) / 3.0)
    points = spark.createDataFrame(rows, "time double, t1 string, t2 string, u double, v double, sigma double")
    return simulation.image_visibilities(points, image, PIXEL).cache(), image


def test_legs_close_and_predict(vis, spark):
    table, image = vis
    for frame, legs in ((closure.bispectra(table), 3), (closure.closure_amplitudes(table, debias=False), 4), (closure.closure_amplitudes(table, "min", debias=False), 4)):
        rows = frame.collect()
        assert rows
        for r in rows[:200]:
            uv = np.array([[r[f"u{k}"], r[f"v{k}"]] for k in range(1, legs + 1)])
            if legs == 3:
                assert np.allclose(uv.sum(0), 0, atol=1e-3)
            x = imaging.positions(8, PIXEL)
            z = [np.exp(2j * np.pi * (v * x[:, None] + u * x[None, :])) for u, v in uv]
            m = [(image * k).sum() for k in z]
            if legs == 3:
                assert np.isclose(m[0] * m[1] * m[2], complex(r["bispec_re"], r["bispec_im"]))
            else:
                assert np.isclose(abs(m[0]) * abs(m[1]) / abs(m[2]) / abs(m[3]), r["camp"])


@pytest.mark.parametrize("kind", ["bispec", "cphase", "camp", "logcamp"])
def test_tables_feed_the_imager_and_the_writer(vis, kind, tmp_path, spark):
    table, image = vis
    frame = {"bispec": closure.bispectra, "cphase": closure.closure_phases, "camp": lambda v: closure.closure_amplitudes(v, debias=False), "logcamp": lambda v: closure.closure_amplitudes(v, kind="logcamp", debias=False)}[kind](table)
    value, slope = imaging.data_term(frame, kind, 8, PIXEL)(image)
    assert value < 1e-15 and np.abs(slope).max() < 1e-6
    name = {"bispec": "bs"}.get(kind, kind)
    name = name if name in texts.TABLES else "camp"
    texts.write_table(frame, str(tmp_path / kind), name)
    assert texts.read_table(spark, str(tmp_path / kind), name).dropna().count() == frame.count()


def test_averages_keep_mean_legs(vis):
    table, _ = vis
    one = table.groupBy("t1", "t2").agg(F.avg("u").alias("u"))
    mean = {(r["t1"], r["t2"]): r["u"] for r in one.collect()}
    for frame, names in ((closure.average_bispectra(closure.bispectra(table), 1e6), 3), (closure.average_phases(closure.closure_phases(table), 1e6), 3), (closure.average_amplitudes(closure.closure_amplitudes(table), 1e6), 4)):
        rows = frame.collect()
        assert rows and all(abs(r["u1"] - mean[r["t1"], r["t2"]]) < 1e-3 for r in rows) and f"v{names}" in frame.columns


def test_orders_of_stations_turn_the_legs(vis):
    table, _ = vis
    own = closure.closure_phases(table).filter("t1='A' and t2='B' and t3='D'").orderBy("time").first()
    for a, b, c in (("D", "A", "B"), ("B", "A", "D"), ("A", "D", "B")):
        r = closure.one_triangle(closure.closure_phases(table), a, b, c).orderBy("time").first()
        at = {("A", "B"): own["u1"], ("B", "D"): own["u2"], ("D", "A"): own["u3"]}
        leg = lambda p, q: at.get((p, q), -at.get((q, p), 0.0))
        assert [r["u1"], r["u2"], r["u3"]] == [leg(a, b), leg(b, c), leg(c, a)]
    full = closure.closure_amplitudes(table, debias=False)
    for order in (("A", "B", "C", "D"), ("C", "D", "A", "B"), ("A", "D", "C", "B"), ("B", "C", "D", "A"), ("D", "C", "B", "A")):
        r = closure.one_quadrangle(full, *order).orderBy("time").first()
        base = {(x["t1"], x["t2"]): x["u"] for x in table.filter("time = 0").collect()}
        leg = lambda p, q: base.get((p, q), -base.get((q, p), 0.0))
        a, b, c, d = order
        assert np.allclose([r["u1"], r["u2"], r["u3"], r["u4"]], [leg(a, b), leg(c, d), leg(a, d), leg(b, c)])


def test_minimal_quadrangles_are_those_of_the_minimal_set(vis):
    table, _ = vis
    for kind in ("camp", "logcamp"):
        want = closure.closure_amplitudes(table, "min", kind, debias=False).collect()
        got = closure.minimal_quadrangles(closure.closure_amplitudes(table, "max", kind, debias=False), table, kind == "logcamp").collect()
        key = lambda r: (r["time"], tuple(sorted((r["t1"], r["t2"], r["t3"], r["t4"]))), round(r["camp"], 9), round(r["sigmaca"], 9))
        assert sorted(map(key, got)) == sorted(map(key, want)) and len(got) == 12 * 5
        at = {(r["time"], r["t1"], r["t2"]): r["u"] for r in table.collect()}
        for r in got:
            for k, (p, q) in enumerate((("t1", "t2"), ("t3", "t4"), ("t1", "t4"), ("t2", "t3")), 1):
                a, b = r[p], r[q]
                assert abs(r[f"u{k}"] - (at[r["time"], a, b] if a < b else -at[r["time"], b, a])) < 1e-3


def test_cuts_and_averages_before_closing(vis):
    table, _ = vis
    amps = closure.amplitude_table(table, 7200.0, debias=False)
    assert amps.count() == 60 and {"u", "v", "amp", "sigma"} <= set(amps.columns)
    camps = closure.closure_amplitude_table(table, 7200.0, debias=False)
    assert camps.count() == 6 * 15
    a = {(r["time"], r["t1"], r["t2"]): r["amp"] for r in amps.collect()}
    for r in camps.collect():
        leg = lambda p, q: a[r["time"], min(p, q), max(p, q)]  # noqa: B023, E731
        assert np.isclose(r["camp"], leg(r["t1"], r["t2"]) * leg(r["t3"], r["t4"]) / leg(r["t1"], r["t4"]) / leg(r["t2"], r["t3"]))
    everything = closure.closure_phases(table).count()
    assert 0 < closure.phase_table(table, snr_cut=20.0).count() < everything
    assert 0 < closure.bispectrum_table(table, snr_cut=20.0).count() < everything
    assert closure.amplitude_table(table, snr_cut=1e9).count() == 0
