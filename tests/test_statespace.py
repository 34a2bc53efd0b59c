"""State-space movies: the segmented smoother against the sequential one, sums of visibilities, and a planted motion."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringelake.operators import imaging, statespace

N = 5


def model(seed=1):
    rng = np.random.default_rng(seed)
    f = 0.9 * np.eye(N) + 0.1 * rng.normal(size=(N, N))
    a = rng.normal(size=(N, N))
    return f, 0.1 * a @ a.T + 0.05 * np.eye(N), rng.normal(size=N), np.eye(N)


def table(spark, frames, seed=2):
    """Frames of several movies; some frames have no data."""
    rng = np.random.default_rng(seed)
    out = {}
    for movie, count in frames.items():
        for t in range(count):
            h = rng.normal(size=(3, N)) * (rng.uniform() > 0.2)
            y = rng.normal(size=3)
            out[movie, t] = (4 * h.T @ h, 4 * h.T @ y)
    rows = [(m, t, a.ravel().tolist(), b.tolist()) for (m, t), (a, b) in out.items()]
    return spark.createDataFrame(rows, "movie_id long, frame long, info array<double>, seen array<double>").repartition(3), out


def sequential(data, movie, f, q, m0, p0):
    count = sum(1 for k in data if k[0] == movie)
    filtered, m, p = [], m0, p0
    for t in range(count):
        if t:
            m, p = f @ m, f @ p @ f.T + q
        info, h = data[movie, t]
        p2 = np.linalg.inv(np.linalg.inv(p) + info)
        m = p2 @ (np.linalg.solve(p, m) + h)
        p = p2
        filtered.append((m, p))
    out = {count - 1: (*filtered[-1], None)}
    for t in range(count - 2, -1, -1):
        m, p = filtered[t]
        e = p @ f.T @ np.linalg.inv(f @ p @ f.T + q)
        m2, p2, _ = out[t + 1]
        out[t] = m + e @ (m2 - f @ m), p + e @ (p2 - f @ p @ f.T - q) @ e.T, p2 @ e.T
    return out


@pytest.mark.parametrize("segment, block", [(32, 64), (3, 2), (1, 3)])
def test_segments_give_the_sequential_smoother(spark, segment, block):
    f, q, m0, p0 = model()
    frames, data = table(spark, {1: 23, 2: 1, 7: 9})
    got = {(r["movie_id"], r["frame"]): r for r in statespace.smooth(frames, f, q, m0, p0, segment, block).collect()}
    assert set(got) == set(data)
    for movie in (1, 2, 7):
        for t, (m, p, lag) in sequential(data, movie, f, q, m0, p0).items():
            r = got[movie, t]
            assert np.abs(np.array(r["mean"]) - m).max() < 1e-8 and np.abs(np.array(r["cov"]).reshape(N, N) - p).max() < 1e-8
            assert (lag is None) == (r["after"] is None) and (lag is None or np.abs(np.array(r["after"]).reshape(N, N) - lag).max() < 1e-8)


def test_moments_are_those_of_all_steps(spark):
    f, q, m0, p0 = model()
    frames, data = table(spark, {1: 8, 3: 5})
    want = np.zeros((3, N, N))
    for movie in (1, 3):
        s = sequential(data, movie, f, q, m0, p0)
        for t in range(len(s) - 1):
            (m, p, lag), (m2, p2, _) = s[t], s[t + 1]
            want += [p2 + np.outer(m2, m2), lag + np.outer(m2, m), p + np.outer(m, m)]
    got = statespace.moments(statespace.smooth(frames, f, q, m0, p0, 3, 2), N)
    assert np.abs(np.array(got) - want).max() < 1e-7
    none = statespace.smooth(frames.filter("frame < 0"), f, q, m0, p0)
    assert none.count() == 0 and not statespace.moments(none, N)[1].any()


def movie_vis(spark, n, count, shift, pixel=1e-10):
    rng = np.random.default_rng(4)
    y, x = np.indices((n, n))
    rows = []
    at = imaging.positions(n, pixel)
    for t in range(count):
        image = np.exp(-((x - 1.2 - shift[0] * t) ** 2 + (y - 1.5 - shift[1] * t) ** 2) / 1.5)
        for u, v in rng.uniform(-4e9, 4e9, (30, 2)):
            z = (image * np.exp(2j * np.pi * (v * at[:, None] + u * at[None, :]))).sum() + 0.01 * (rng.normal() + 1j * rng.normal())
            rows.append((t, float(u), float(v), float(z.real), float(z.imag), 0.01))
    return spark.createDataFrame([*rows, (0, None, 1.0, 1.0, 1.0, 1.0)], "t int, u double, v double, vis_re double, vis_im double, sigma double").repartition(3)


def test_sums_of_visibilities(spark):
    n, pixel = 3, 1e-10
    vis = movie_vis(spark, n, 2, (0.2, 0.1))
    at = imaging.positions(n, pixel)
    for r in statespace.frame_information(vis, "t", n, pixel).collect():
        rows = vis.filter((F.col("t") == r["frame"]) & F.col("u").isNotNull()).collect()
        h = np.array([np.outer(np.exp(2j * np.pi * k["v"] * at), np.exp(2j * np.pi * k["u"] * at)).ravel() / k["sigma"] for k in rows])
        y = np.array([complex(k["vis_re"], k["vis_im"]) / k["sigma"] for k in rows])
        assert np.allclose(np.array(r["info"]).reshape(9, 9), np.real(np.conj(h).T @ h)) and np.allclose(r["seen"], np.real(np.conj(h).T @ y))


def test_a_planted_motion_is_learnt(spark):
    n, shift = 6, (0.45, 0.25)
    frames = statespace.frame_information(movie_vis(spark, n, 7, shift), "t", n, 1e-10).cache()
    noise, cov = 2e-3 * np.eye(n * n), np.eye(n * n)
    p, path = statespace.learn_warp(frames, n, noise, np.zeros(n * n), cov, np.zeros(2), rounds=3, segment=3, block=2)
    assert np.abs(p - shift).max() < 0.15 and len(path) == 3


def test_warps():
    image = np.zeros((5, 5))
    image[2, 1] = 1.0
    moved = (statespace.warp(5, [1.0, 0.5]) @ image.ravel()).reshape(5, 5)
    assert moved[2, 2] == 0.5 and moved[3, 2] == 0.5 and np.isclose(moved.sum(), 1)
    assert np.allclose(statespace.warp(4, np.zeros(6)), np.eye(16))
