"""Interval joins and curves against plain loops; no plan has a nested loop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringelake.operators import images, intervals
from fringelake.operators import visibility as V

VIS = "time double, t1 string, t2 string, u double, v double, vis_re double, vis_im double, sigma double"


def table(spark, n=400, seed=2):
    rng = np.random.default_rng(seed)
    names = "ABCD"
    rows = []
    for t in np.round(rng.uniform(-3, 27, n), 2):
        i, j = sorted(rng.choice(4, 2, replace=False))
        rows.append((float(t), names[i], names[j], 1.0, 2.0, float(rng.normal()), float(rng.normal()), 0.1))
    return spark.createDataFrame(rows, VIS), rows


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def no_loops(frame):
    return not any(x in plan_of(frame) for x in ("NestedLoop", "Cartesian"))


def test_flags_of_stations_baselines_and_all(spark):
    vis, rows = table(spark)
    flags = [(0.5, 3.25, "A"), (2.0, 2.5, None), (10.0, 20.0, "C-B"), (10.0, 20.0, "B-D"), (11.0, 11.0, "A"), (30.0, 10.0, "A"), (None, 5.0, "A"), (-9.0, -1.0, "D")]
    got = V.flag_table(vis, spark.createDataFrame(flags, "start double, stop double, site string"))
    held = lambda r, f: f[0] is not None and f[0] < r[0] < f[1] and (f[2] is None or f[2] in (r[1], r[2], f"{r[1]}-{r[2]}", f"{r[2]}-{r[1]}"))
    want = [r for r in rows if not any(held(r, f) for f in flags)]
    assert sorted(map(tuple, got.collect())) == sorted(want) and 0 < len(want) < len(rows) and no_loops(got)


def test_scans_over_blocks(spark):
    vis, rows = table(spark)
    times = sorted({r[0] for r in rows})
    for gap in (0.05, 0.2):
        want, start = [], 0
        for i in range(1, len(times) + 1):
            if i == len(times) or times[i] - times[i - 1] > gap:
                want.append((len(want), times[start], times[i - 1], i - start))
                start = i
        for hours in (0.3, 24.0):
            assert sorted(map(tuple, V.scans(vis, gap, hours).collect())) == want
    tagged = V.in_scans(vis, V.scans(vis, 0.2))
    assert tagged.count() == len(rows) and no_loops(tagged) and no_loops(V.subscan_dropouts(tagged, 0.9))


def not_a_knot(x, y, at):
    """The cubic spline by a dense system over all coefficients."""
    n = len(x) - 1
    a, b = np.zeros((4 * n, 4 * n)), np.zeros(4 * n)
    row = 0

    def put(piece, powers, value, other=None):
        nonlocal row
        a[row, 4 * piece : 4 * piece + 4] += powers
        if other is not None:
            a[row, 4 * other[0] : 4 * other[0] + 4] -= other[1]
        b[row] = value
        row += 1

    h = np.diff(x)
    for i in range(n):
        put(i, [1, 0, 0, 0], y[i])
        put(i, [1, h[i], h[i] ** 2, h[i] ** 3], y[i + 1])
        if i + 1 < n:
            put(i, [0, 1, 2 * h[i], 3 * h[i] ** 2], 0, (i + 1, [0, 1, 0, 0]))
            put(i, [0, 0, 2, 6 * h[i]], 0, (i + 1, [0, 0, 2, 0]))
    put(0, [0, 0, 0, 1], 0, (1, [0, 0, 0, 1]))
    put(n - 2, [0, 0, 0, 1], 0, (n - 1, [0, 0, 0, 1]))
    c = np.linalg.solve(a, b).reshape(n, 4)
    i = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 1)
    d = at - x[i]
    return ((c[i, 3] * d + c[i, 2]) * d + c[i, 1]) * d + c[i, 0]


def curve(spark, sizes, seed=3):
    rng = np.random.default_rng(seed)
    out = {}
    for site, n in sizes.items():
        x = np.sort(rng.choice(np.arange(0, 2400), n, replace=False)) / 100.0
        out[site] = (x, rng.normal(size=n), rng.normal(size=n))
    rows = [(s, float(t), float(a), float(b)) for s, (x, p, q) in out.items() for t, a, b in zip(x, p, q, strict=True)]
    return spark.createDataFrame(rows, "site string, time double, g_re double, g_im double"), out


@pytest.mark.parametrize("extrapolate", [False, True])
@pytest.mark.parametrize("method", ["linear", "nearest", "cubic"])
def test_gains_of_every_method(spark, method, extrapolate):
    vis, rows = table(spark)
    gains, curves = curve(spark, {"A": 40, "B": 1, "D": 6})

    def at(site, t):
        if site not in curves:
            return 1.0
        x, p, q = curves[site]
        z = p + 1j * q
        if len(x) == 1:
            return z[0]
        if not x[0] <= t <= x[-1] and not extrapolate:
            return None
        i = int(np.clip(np.searchsorted(x, t, "right") - 1, 0, len(x) - 2))
        share = (t - x[i]) / (x[i + 1] - x[i])
        if method == "nearest":
            return z[i + 1] if share > 0.5 else z[i]
        if method == "linear":
            return z[i] + share * (z[i + 1] - z[i])
        return not_a_knot(x, p, t) + 1j * not_a_knot(x, q, t)

    frame = V.apply_gains(vis, gains, method, extrapolate)
    assert no_loops(frame)
    got = sorted(map(tuple, frame.collect()), key=lambda r: r[:3])
    assert len(got) == len(rows)
    seen = 0
    for r, g in zip(sorted(rows), sorted(got, key=lambda r: (*r[:3], r[7] if r[7] is not None else 0)), strict=True):
        assert r[:3] == g[:3]
    want = {}
    for r in rows:
        one, two = at(r[1], r[0]), at(r[2], r[0])
        value = None if one is None or two is None else complex(r[5], r[6]) * one * np.conj(two)
        want.setdefault(r[:3], []).append(value)
    for g in got:
        left = want[g[:3]]
        value = None if g[5] is None else complex(g[5], g[6])
        match = next(i for i, w in enumerate(left) if (w is None) == (value is None) and (w is None or abs(w - value) < 1e-8 * (1 + abs(w))))
        left.pop(match)
        seen += value is not None
    assert seen > 20 and not any(want.values())


def test_pieces_of_a_spline_give_the_whole_one(spark):
    gains, curves = curve(spark, {"A": 900})
    x, p, _ = curves["A"]
    whole = intervals.spline_slopes(x, p)[:, 0]
    rows = intervals.segments(gains, "site", ("g_re", "g_im"), "cubic", piece=100).orderBy("lo").collect()
    assert [r["lo"] for r in rows] == x.tolist() and np.allclose([r["da_g_re"] for r in rows], whole, rtol=1e-9, atol=1e-9 * np.abs(whole).max())
    assert np.allclose([r["db_g_re"] for r in rows[:-1]], whole[1:], rtol=1e-9, atol=1e-9 * np.abs(whole).max()) and rows[-1]["hi"] is None


def test_both_hands(spark):
    row = [(1.0, "A", "B", *[float(k) for k in range(1, 9)], *[0.1] * 4)]
    names = ("rr", "ll", "rl", "lr")
    vis = spark.createDataFrame(row, "time double, t1 string, t2 string, " + ", ".join(f"{n}vis_{p} double" for n in names for p in ("re", "im")) + ", " + ", ".join(f"{n}sigma double" for n in names))
    gains = spark.createDataFrame([("A", 0.0, 2.0, 0.0, 0.0, 1.0), ("A", 2.0, 2.0, 0.0, 0.0, 1.0), ("B", 0.0, 3.0, 1.0, 5.0, 0.0)], "site string, time double, r_re double, r_im double, l_re double, l_im double")
    hands = {"A": {"r": 2 + 0j, "l": 1j}, "B": {"r": 3 + 1j, "l": 5 + 0j}}
    for force in (None, "R", "L"):
        got = V.apply_hands(vis, gains, force=force).first()
        for k, n in enumerate(names):
            a, b = (force or n[0]).lower(), (force or n[1]).lower()
            g = hands["A"][a] * np.conj(hands["B"][b])
            assert abs(complex(got[f"{n}vis_re"], got[f"{n}vis_im"]) - complex(2 * k + 1, 2 * k + 2) * g) < 1e-12 and abs(got[f"{n}sigma"] - 0.1 * abs(g)) < 1e-12


def test_frames_and_errors_of_all_products(spark):
    frames = spark.createDataFrame([(1, 5.0, 50), (1, 7.0, 70), (2, 1.0, 11)], "movie_id long, t double, image_id long")
    times = spark.createDataFrame([(m, t) for m in (1, 2, 3) for t in (0.0, 5.0, 6.9, 9.0)], "movie_id long, time double")
    got = sorted(map(tuple, images.frame_at(frames, times).collect()))
    assert got == [(1, 0.0, 50), (1, 5.0, 50), (1, 6.9, 50), (1, 9.0, 70), (2, 0.0, 11), (2, 5.0, 11), (2, 6.9, 11), (2, 9.0, 11)]
    full = spark.createDataFrame([(3.0, 4.0, 0.3, 0.1, 0.2, 1e9, 0.0, 8.0)], "vis_re double, vis_im double, sigma double, qsigma double, vsigma double, u double, v double, qvis_re double")
    r = V.fractional_noise(full, 0.1).first()
    assert np.allclose([r["sigma"], r["qsigma"], r["vsigma"]], np.hypot([0.3, 0.1, 0.2], 0.5))
    t = V.taper(full, 1e-10).first()
    k = np.exp(-2 * np.pi**2 * (1e-10 / (2 * np.sqrt(2 * np.log(2)))) ** 2 * 1e18)
    assert np.isclose(t["qvis_re"], 8 * k) and np.isclose(t["vsigma"], 0.2 * k) and np.isclose(V.taper(V.taper(full, 1e-10), 1e-10, True).first()["qvis_re"], 8.0)
    empty = full.filter("u < 0")
    assert V.fractional_noise(empty, 0.1).count() == 0
    assert V.scans(spark.createDataFrame([], VIS), 0.1).count() == 0
    assert V.apply_gains(spark.createDataFrame([], VIS), spark.createDataFrame([], "site string, time double, g_re double, g_im double"), "cubic").count() == 0
    some, rows = table(spark, 5)
    assert V.apply_gains(some, spark.createDataFrame([], "site string, time double, g_re double, g_im double")).agg(F.sum("vis_re")).first()[0] == pytest.approx(sum(r[5] for r in rows))
