"""FITS files: round trips, byte ranges, channels, missing products."""

import numpy as np
from pyspark.sql import functions as F

from fringelake.operators import polarimetry
from fringelake.sources import fits

SEEN = fits.Observation("M87", 12.5, 12.4, 2.3e11, 2e9, "circ")
PARTS = [f"{v}_{x}" for v in ("rrvis", "llvis", "rlvis", "lrvis") for x in ("re", "im")]


def observed(spark, n=60):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(n):
        for a, b in (("AA", "BB"), ("AA", "CC"), ("BB", "CC")):
            rows.append((k * 0.05, 10.0, a, b, 0.1, 0.2, *(float(x) for x in rng.normal(0, 1e9, 2)), *(float(x) for x in rng.normal(0, 1, 8)), 0.1, 0.2, 0.3, 0.4))
    names = "time double, tint double, t1 string, t2 string, tau1 double, tau2 double, u double, v double, " + ", ".join(f"{c} double" for c in PARTS) + ", rrsigma double, llsigma double, rlsigma double, lrsigma double"
    stations = spark.createDataFrame([(s, 1e6 * k, 2e6, -3e6 * k, 100.0 * k) for k, s in enumerate(("AA", "BB", "CC"), 1)], "site string, x double, y double, z double, sefdr double")
    return spark.createDataFrame(rows, names), stations


def test_visibilities_survive_a_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fits, "TASK_BYTES", 84 * 50)  # several byte ranges, the last of them short
    monkeypatch.setattr(fits, "BATCH_BYTES", 84 * 7)
    vis, stations = observed(spark)
    path = str(tmp_path / "a.uvfits")
    scans = spark.createDataFrame([(-0.01, 1.01), (1.02, 4.0)], "t_start double, t_stop double")
    fits.write_uvfits(vis, stations, path, SEEN, 57849, scans)
    back = fits.read_uvfits(spark, path)
    assert back.rdd.getNumPartitions() > 1 and fits.observation(path) == SEEN
    own, read = vis.orderBy("time", "t1", "t2").collect(), back.orderBy("time", "t1", "t2").collect()
    assert len(own) == len(read) == 180
    for a, b in zip(own, read, strict=True):
        assert (a["t1"], a["t2"], b["mjd"]) == (b["t1"], b["t2"], 57849)
        for c in ("time", "tint", "u", "v", "tau1", "tau2", "rrsigma", "lrsigma", *PARTS):
            assert abs(a[c] - b[c]) <= 2e-7 * max(1.0, abs(a[c])), c
    assert [(r["site"], r["x"], r["sefdr"]) for r in fits.read_stations(spark, path).orderBy("number").collect()] == [("AA", 1e6, 100.0), ("BB", 2e6, 200.0), ("CC", 3e6, 300.0)]
    assert np.allclose([list(r) for r in fits.read_scans(spark, path).collect()], [[-0.01, 1.01], [1.02, 4.0]])
    flipped = fits.read_uvfits(spark, path, flip=True).orderBy("time", "t1", "t2").first()
    assert flipped["u"] == -read[0]["u"]


def test_missing_products_and_rows_without_weight(spark, tmp_path):
    vis, stations = observed(spark, 2)
    none = F.lit(None).cast("double")
    first = (F.col("t1") == "AA") & (F.col("t2") == "BB")
    vis = vis.withColumns({"llsigma": F.when(first, none).otherwise(F.col("llsigma")), "rlsigma": none, "rrsigma": F.when(F.col("t1") == "BB", none).otherwise(F.col("rrsigma"))})
    vis = vis.withColumn("llsigma", F.when(F.col("t1") == "BB", none).otherwise(F.col("llsigma")))
    path = str(tmp_path / "b.uvfits")
    fits.write_uvfits(vis, stations, path, SEEN, 57849)
    rows = {(r["time"], r["t1"], r["t2"]): r for r in fits.read_uvfits(spark, path).collect()}
    assert sorted({k[1:] for k in rows}) == [("AA", "BB"), ("AA", "CC")]  # BB-CC has no parallel hand
    assert all(r["rlvis_re"] is None and r["rlsigma"] is None for r in rows.values())
    assert all((r["llsigma"] is None) == (k[2] == "BB") for k, r in rows.items())
    filled = fits.read_uvfits(spark, path, fill_sigmas=True).collect()
    assert all(abs(r["rlsigma"] - 0.1) < 1e-6 for r in filled) and fits.read_scans(spark, path).count() == 0
    assert polarimetry.switch(fits.read_uvfits(spark, path), "stokes").count() == 4


def test_channels_and_bands_are_averaged_by_weight(spark, tmp_path):
    vis, stations = observed(spark, 1)
    path = str(tmp_path / "c.uvfits")
    fits.write_uvfits(vis, stations, path, SEEN, 57849)
    with open(path, "rb") as f:
        unit, whole = fits.units(f)[0], (f.seek(0), f.read())[1]
    raw = np.frombuffer(whole[unit.start : unit.start + unit.size], ">f4").reshape(3, 21)
    many = np.zeros((3, 2, 3, 4, 3), ">f4")  # bands, channels, products, parts
    many[:] = raw[:, 9:].reshape(3, 1, 1, 4, 3)
    many[:, 1, 2, :, 0] += 6.0
    many[:, 1, 2, :, 2] *= 2.0
    many[:, 0, 0, :, 2] = 0.0  # flagged
    body = np.concatenate([raw[:, :9], many.reshape(3, -1)], 1).astype(">f4").tobytes()
    head = whole[: unit.start].replace(b"NAXIS4  =                    1", b"NAXIS4  =                    3").replace(b"NAXIS5  =                    1", b"NAXIS5  =                    2")
    end = whole[unit.start + -(-unit.size // 2880) * 2880 :]
    with open(path, "wb") as f:
        f.write(head + body + b"\0" * (-len(body) % 2880) + end)
    base = {(r["t1"], r["t2"]): r for r in vis.collect()}
    for r in fits.read_uvfits(spark, path).collect():
        own = base[r["t1"], r["t2"]]  # four channels of weight 1 and one of 2 that is 6 higher
        assert abs(r["rrvis_re"] - (own["rrvis_re"] + 2.0)) < 1e-5 and abs(r["rrsigma"] - 0.1 / np.sqrt(6)) < 1e-6
    for r in fits.read_uvfits(spark, path, inverse_variance=False).collect():
        assert abs(r["rrvis_re"] - (base[r["t1"], r["t2"]]["rrvis_re"] + 6 / 5)) < 1e-5
    one = fits.read_uvfits(spark, path, channels=[2], bands=[1]).collect()
    assert all(abs(r["llvis_re"] - base[r["t1"], r["t2"]]["llvis_re"] - 6.0) < 1e-5 for r in one)


def test_images_survive_files(spark, tmp_path):
    i, q = np.arange(6.0), -np.arange(6.0)
    images = spark.createDataFrame([(k, 3, 2, 1e-11, (i + k).tolist(), q.tolist() if k else None) for k in range(3)], "image_id int, nx int, ny int, psize double, ipix array<double>, qpix array<double>")
    fits.write_images(images, str(tmp_path / "im"))
    read = sorted(fits.read_images(spark, str(tmp_path / "im/*.fits")).collect(), key=lambda r: r["path"])
    assert [r["ipix"] for r in read] == [(i + k).tolist() for k in range(3)]
    assert read[0]["qpix"] is None and read[1]["qpix"] == q.tolist() and (read[0]["nx"], read[0]["ny"]) == (3, 2) and abs(read[0]["psize"] - 1e-11) < 1e-22
