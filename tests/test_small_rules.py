"""Thresholds, picked times, systematic noise, sidereal matches and gain floors on rows worked out by hand."""

import pytest

from fringelake.operators import calibration, images, tables
from fringelake.operators import visibility as V
from fringelake.operators.geometry import gmst

VIS = "time double, t1 string, t2 string, vis_re double, vis_im double, sigma double"


def test_threshold_counts_from_the_least_value(spark):
    table = spark.createDataFrame([(1, [2.0, 4.0, 6.0, 3.0]), (2, [5.0, 5.0, 5.0, 5.0])], "image_id int, pix array<float>")
    rows = lambda **k: {r["image_id"]: r["pix"] for r in images.threshold(table, 0.5, **k).collect()}
    assert rows()[1] == [4.0, 4.0, 6.0, 4.0] and rows(fill=0.0)[1] == [0.0, 0.0, 6.0, 0.0] and rows()[2] == [5.0] * 4


def test_every_nth_time_of_the_table(spark):
    vis = spark.createDataFrame([(t, a, b, 1.0, 0.0, 1.0) for t in (0.0, 1.0, 25.0, 26.0, 80.0) for a, b in (("A", "B"), ("A", "C"))] + [(1.5, "B", "C", 1.0, 0.0, 1.0)], VIS)
    got = tables.every_nth(vis.unionByName(vis), 2)
    assert sorted({r["time"] for r in got.collect()}) == [0.0, 1.5, 26.0] and got.count() == 10 and got.columns == vis.columns


def test_picked_times(spark):
    vis = spark.createDataFrame([(0.0, "A", "B", 1.0, 0.0, 1.0), (0.0, "C", "D", 1.0, 0.0, 1.0), (1.0, "A", "B", 1.0, 0.0, 1.0)], VIS)
    assert tables.pick(vis, ["A", "D"]).count() == 2 and tables.pick(vis, []).count() == 3 and tables.pick(vis, ["E"]).count() == 0


def test_systematic_noise(spark):
    vis = spark.createDataFrame([(0.0, "A", "B", 3.0, 4.0, 0.5), (0.0, "A", "C", 3.0, 4.0, 2.0), (0.0, "B", "D", 3.0, 4.0, 0.5), (0.0, "B", "C", None, 4.0, 0.5)], VIS)
    own = {(r["t1"], r["t2"]): r["sigma"] for r in V.systematic_noise(vis, {"A": 0.1, "D": -1.0}, 5.0).collect()}
    assert own == {("A", "B"): pytest.approx((0.25 + 0.25) ** 0.5)}
    assert {round(r["sigma"] ** 2, 9) for r in V.systematic_noise(vis, 0.1, 5.0).collect()} == {0.75}


def test_sidereal_matches_of_two_days(spark):
    """A sidereal day later the clock shows four minutes less."""
    one = spark.createDataFrame([(5.0, "A", "B", 1.0, 0.0, 1.0), (7.0, "A", "B", 1.0, 0.0, 1.0)], VIS)
    later = spark.createDataFrame([(5.0 - 24.0 * (1 - 1 / 1.00273790935), "B", "A", 1.0, 0.0, 1.0)], VIS)
    found = tables.common_rows(one, later, 0.01, "gmst", days=(57854, 57855)).collect()
    assert [r["time"] for r in found] == [5.0]
    clock = lambda t, day: t.select(gmst(t["time"], day).alias("g")).first()["g"]
    assert abs(clock(one.filter("time = 5"), 57854) - clock(later, 57855)) < 1e-4


def test_gain_floors(spark):
    gains = spark.createDataFrame([("A", 0.0, 0.4, 0.0, 0.6, 0.0), ("A", 1.0, 0.8, 0.0, 1.0, 0.0), ("B", 0.0, 2.0, 0.0, 2.0, 0.0)], "site string, time double, r_re double, r_im double, l_re double, l_im double")
    first = lambda by: {(r["site"], r["time"]): round(r["r_re"], 9) for r in calibration.raise_gains(gains, None, 0.75, by).collect()}
    assert first("min")["A", 0.0] == 0.75 and first("median")["A", 0.0] == round(0.4 / 0.7, 9) and first("mean")["A", 1.0] == round(0.8 / 0.7, 9)
    assert all(first(by)["B", 0.0] == 2.0 for by in ("min", "mean", "median"))
    with pytest.raises(ValueError):
        calibration.raise_gains(gains, None, 0.75, "max")
