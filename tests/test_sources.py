"""Text readers and the writer: round trips and the older widths."""

import math

from fringelake.sources import visibilities as S

COLUMNS = "time double, tint double, t1 string, t2 string, tau1 double, tau2 double, u double, v double, vis_re double, vis_im double, qvis_re double, qvis_im double, uvis_re double, uvis_im double, vvis_re double, vvis_im double, sigma double, qsigma double, usigma double, vsigma double"


def test_round_trip(spark, tmp_path):
    rows = [(0.5 * i, 10.0, "A", "B", 0.1, 0.2, 1e9 / (i + 1), -3.0, 1.0, 2.0, -0.1, 0.2, 0.0, -0.3, 0.4, 0.0, 0.1, 0.2, 0.3, 0.4) for i in range(5)]
    S.write_text(spark.createDataFrame(rows, COLUMNS), str(tmp_path / "a"))
    back = sorted(tuple(r[c.split()[0]] for c in COLUMNS.split(", ")) for r in S.read_text(spark, str(tmp_path / "a")).collect())
    assert all(x == y if isinstance(x, str) else abs(x - y) < 1e-12 for a, b in zip(back, rows) for x, y in zip(a, b)) and len(back) == 5


def test_older_widths(spark, tmp_path):
    base = "1.0 10 A B 30 40 0.1 0.2 5e6 6e6 2.0 90"
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.txt").write_text("\n".join(["# SRC: x", "", base + " 1 0 1 180 1 -90 0.5", base + " 1 0 1 180 0.25", base + " 0.125 0 0", "1.0 2"]))
    wide, middle, narrow, odd = sorted(S.read_text(spark, str(tmp_path / "b")).collect(), key=lambda r: -(r["sigma"] or 0))
    for r in (wide, middle, narrow):
        assert (r["tau1"], r["u"], r["v"]) == (0.1, 5e6, 6e6) and abs(r["vis_im"] - 2) < 1e-12
    assert (wide["vsigma"], middle["qsigma"], narrow["sigma"]) == (0.5, 0.25, 0.125)
    assert abs(wide["vvis_im"] + 1) < 1e-12 and (middle["uvis_re"], middle["vvis_re"]) == (-1.0, 0.0) and (narrow["qvis_re"], narrow["uvis_re"]) == (0.0, 0.0)
    assert odd["vis_re"] is None and odd["time"] == 1.0


def test_stations_gains_and_flags(spark, tmp_path):
    for name, text in (("s", "# c\nA 1 2 3 4\nB 1 2 3 4 5 0 1 0 .1 .2 .3 .4\n"), ("f", "mjd_start,mjd_stop,station\n57000.25,57000.5,A\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.txt").write_text(text)
    a, b = sorted(S.read_stations(spark, str(tmp_path / "s")).collect())
    assert (a["sefdl"], a["dl_im"], b["sefdl"], b["dl_im"]) == (4.0, 0.0, 5.0, 0.4)
    r = S.read_flags(spark, str(tmp_path / "f")).first()
    assert (r["start"], r["stop"], r["site"]) == (6.0, 12.0, "A")
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "src_A.txt").write_text("0.5 0 2 4 0\n")
    r = S.read_gains(spark, str(tmp_path / "g"), square_root=True).first()
    assert abs(r["r_re"] - 1) < 1e-12 and abs(r["r_im"] - 1) < 1e-12 and abs(r["l_re"] - 2) < 1e-12 and math.isclose(r["time"], 0.5)
