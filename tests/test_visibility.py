import math

from fringelake.operators import closure
from fringelake.operators import visibility as V

VIS = "time double, tint double, t1 string, t2 string, tau1 double, tau2 double, u double, v double, vis_re double, vis_im double, sigma double"


def table(spark, rows):
    return spark.createDataFrame([(t, 10.0, a, b, 0.1, 0.1, u, v, r * math.cos(p), r * math.sin(p), s) for t, a, b, u, v, r, p, s in rows], VIS)


def test_closure_phase_of_three_legs(spark):
    d = math.radians
    vis = table(spark, [(0.0, "A", "B", 1.0, 0.0, 1.0, d(10), 0.1), (0.0, "B", "C", 1.0, 0.0, 1.0, d(20), 0.1), (0.0, "A", "C", 2.0, 0.0, 1.0, d(40), 0.1)])
    assert abs(closure.closure_phases(vis).first()["cphase"] + 10) < 1e-6


def test_flags_split_the_table(spark):
    vis = table(spark, [(0.0, "A", "B", 1.0, 0.0, 1.0, 0.0, 0.1), (1.0, "A", "B", 1.0, 0.0, 0.1, 0.0, 0.1)])
    assert V.flag(vis, V.low_snr(3.0)).count() == V.flag(vis, V.low_snr(3.0), "flagged").count() == 1


def test_conjugates_twice_is_each_row_twice(spark):
    vis = table(spark, [(0.0, "A", "B", 1.0, 2.0, 1.0, 0.5, 0.1)])
    twice = V.conjugates(V.conjugates(vis))
    assert twice.filter("t1 = 'A'").distinct().count() == 1 and twice.count() == 4


def test_scan_gap_is_strict(spark):
    vis = table(spark, [(t, "A", "B", 1.0, 0.0, 1.0, 0.0, 0.1) for t in (0.0, 0.5, 1.0, 1.75)])
    assert [r["n_times"] for r in V.scans(vis, 0.5).orderBy("scan_id").collect()] == [3, 1]
