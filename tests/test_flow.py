"""Flow between frames: sums, terms, gradients and fields against plain arrays, and a planted motion."""

import numpy as np
from pyspark.sql import functions as F

from fringelake.operators import flow, imaging

N = 6


def movies(seed=3):
    rng = np.random.default_rng(seed)
    return {1: rng.normal(size=(5, N, N)), 4: rng.normal(size=(2, N, N)), 9: rng.normal(size=(1, N, N))}, {m: rng.normal(size=(2, N, N)) for m in (1, 4, 9)}


def tables(spark):
    data, fields = movies()
    frames = [(m, t + 7 * m, x.ravel().tolist()) for m, xs in data.items() for t, x in enumerate(xs)]
    return spark.createDataFrame(frames, "movie_id int, frame int, pix array<double>").repartition(3), spark.createDataFrame([(m, f[0].ravel().tolist(), f[1].ravel().tolist()) for m, f in fields.items()], "movie_id int, down array<double>, right array<double>")


def operator(down, right):
    """The matrix that makes a frame of the one before, by its definition pixel by pixel."""
    out = np.eye(N * N)
    at = lambda r, c: (r % N) * N + c % N
    for r in range(N):
        for c in range(N):
            k = at(r, c)
            out[k, k] -= (down[(r + 1) % N, c] - down[r - 1, c] + right[r, (c + 1) % N] - right[r, c - 1]) / 2
            for j, w in ((at(r + 1, c), down[r, c] / 2), (at(r - 1, c), -down[r, c] / 2), (at(r, c + 1), right[r, c] / 2), (at(r, c - 1), -right[r, c] / 2)):
                out[k, j] -= w
    return out


def test_carry_and_its_adjoint():
    x, r, down, right = np.random.default_rng(1).normal(size=(4, N, N))
    m = operator(down, right)
    assert np.allclose(flow.carry(x, down, right).ravel(), m @ x.ravel()) and np.allclose(flow.carry_back(r, down, right).ravel(), m.T @ r.ravel())


def test_terms(spark):
    frames, fields = tables(spark)
    data, plain = movies()
    got = {r["movie_id"]: r["value"] for r in flow.flow_term(frames, fields, N).collect()}
    for m, xs in data.items():
        step = operator(*plain[m])
        want = sum(((b.ravel() - step @ a.ravel()) ** 2).sum() for a, b in zip(xs, xs[1:])) / len(xs)
        assert np.isclose(got[m], want)
    assert flow.flow_term(frames.filter("frame < 0"), fields, N).count() == 0


def test_fields_are_the_least_squares_ones(spark):
    frames, _ = tables(spark)
    data, _ = movies()
    smoothness = 0.7
    got = {r["movie_id"]: np.array([r["down"], r["right"]]) for r in flow.movie_fields(frames, N, smoothness).collect()}
    unit = np.eye(2 * N * N).reshape(-1, 2, N, N)
    slopes = np.array([np.concatenate([flow._down(m).ravel(), flow._right(m).ravel()]) for m in unit])
    for m, xs in data.items():
        rows, right = [np.sqrt(smoothness) * slopes.T], [np.zeros(4 * N * N)]
        for a, b in zip(xs, xs[1:]):
            rows.append(np.array([a.ravel() - operator(*f) @ a.ravel() for f in unit]).T)
            right.append(-(b - a).ravel())
        a, y = np.concatenate(rows), np.concatenate(right)
        want = np.linalg.lstsq(a, y, rcond=None)[0]
        loss = lambda z: ((a @ z - y) ** 2).sum()  # noqa: B023, E731
        assert loss(got[m].ravel()) <= loss(want) * (1 + 1e-9) + 1e-12
        assert np.allclose(got[m].ravel(), want, atol=1e-5)


def test_missing_pixels_leave_sums(spark):
    pix = [float(x) for x in range(N * N)]
    hole = [None if k == 8 else x for k, x in enumerate(pix)]
    frames = spark.createDataFrame([(1, 0, hole), (1, 1, pix)], "movie_id int, frame int, pix array<double>")
    assert {r["i"] for r in flow.flow_sums(frames, N).select("i").collect()} == set(range(N * N)) - {8, 7, 9, 2, 14}


def test_gradient_of_a_frame():
    rng = np.random.default_rng(2)
    x, before, after, down, right = rng.normal(size=(5, N, N))
    sums = imaging.Sums(rng.normal(size=(N, N)), np.ones((2 * N - 1, 2 * N - 1)), 3.0, 2.0, 5, 1e-10)
    value = lambda z: flow.frame_misfit(z, sums, before, after, (down, right), 0.3)
    slope, way = value(x)[1], rng.normal(size=(N, N))
    assert np.isclose((value(x + 1e-5 * way)[0] - value(x - 1e-5 * way)[0]) / 2e-5, (slope * way).sum(), rtol=1e-6)
    assert flow.frame_misfit(x, None, None, None, (down, right), 0.3)[0] == 0


def test_a_moving_blob_is_tracked(spark):
    n, pixel, count, speed = 8, 1e-10, 6, (0.3, 0.5)
    rng = np.random.default_rng(5)
    y, x = np.indices((n, n))
    at = imaging.positions(n, pixel)
    rows, truth = [], []
    for t in range(count):
        image = np.exp(-((y - 2.6 - speed[0] * t) ** 2 + (x - 2.2 - speed[1] * t) ** 2) / 4) + 1e-3
        truth.append(image)
        if t == 3:
            continue  # a frame that nobody saw
        for u, v in rng.uniform(-3e9, 3e9, (60, 2)):
            z = (image * np.exp(2j * np.pi * (v * at[:, None] + u * at[None, :]))).sum() + 0.02 * (rng.normal() + 1j * rng.normal())
            rows.append((t, float(u), float(v), float(z.real), float(z.imag), 0.02))
    vis = spark.createDataFrame([*rows, (0, None, 1.0, 1.0, 1.0, 1.0)], "t int, u double, v double, vis_re double, vis_im double, sigma double").repartition(3)
    flux = truth[0].sum()
    frames, field = flow.make_flow_movie(vis, n, pixel, "t", np.full((n, n), flux / n**2), 3000.0, 0.3, rounds=4)
    got = {r["frame"]: np.array(r["pix"]).reshape(n, n) for r in frames.collect()}
    assert sorted(got) == list(range(count))
    for t, image in enumerate(truth):
        assert np.corrcoef(got[t].ravel(), image.ravel())[0, 1] > (0.97 if t != 3 else 0.95), t
    f = field.first()
    weight = sum(truth)
    mean = [float((np.array(f[c]).reshape(n, n) * weight).sum() / weight.sum()) for c in ("down", "right")]
    assert np.abs(np.array(mean) - speed).max() < 0.15, mean


def test_no_data_no_movie(spark):
    none = spark.createDataFrame([], "t int, u double, v double, vis_re double, vis_im double, sigma double")
    frames, field = flow.make_flow_movie(none, 4, 1e-10, "t", np.ones((4, 4)), 1.0, 1.0)
    assert frames.count() == 0 and field.count() == 0 and flow.flow_sums(frames, 4).count() == 0
    assert frames.select(F.col("movie_id")).schema[0].dataType.simpleString() == "bigint"
