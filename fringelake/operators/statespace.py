"""Movies as a state that moves: x(t) = F x(t - 1) + noise of covariance Q, seen through the visibilities of each frame.

The Gaussian messages of filter and smoother form a semigroup, so time need not be
walked in one task: frames are dealt by segments, each segment folds its elements into
one, a scan over the segments (by blocks of them, again and again) gives the state at every
border, and from there each segment runs the usual recursions by itself. Results are
those of the sequential smoother.

A frame's visibilities enter as sums: H' R^-1 H and H' R^-1 y, of n^2 and n numbers for n pixels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.minimise import lbfgs
from .imaging import ROWS, positions

#: Frames of a segment, and segments (or blocks) of a block of the scan.
SEGMENT, BLOCK = 32, 64


def frame_information(vis: DataFrame, frame: str, n: int, pixel: float, movie: str | None = None) -> DataFrame:
    """(movie_id, frame, info, seen): H' R^-1 H (row by row) and H' R^-1 y of the real image of n by n pixels, for each frame.

    Tasks add their rows up by frame; a frame's sums are n^4 + n^2 numbers. Rows with nulls or without a positive error take no part.
    """
    x, size = positions(n, pixel), n**4 + n**2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            values = np.concatenate(list(held.values())) if held else np.zeros(0)
            at = pa.array(np.arange(len(held) + 1, dtype=np.int32) * size)
            keys = list(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.ListArray.from_arrays(at, pa.array(values))], ["movie_id", "frame", "sums"])

        for batch in batches:
            m, f, u, v, re, im, s = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(7))
            for key in sorted(set(zip(m.tolist(), f.tolist(), strict=True))):
                which = np.flatnonzero((m == key[0]) & (f == key[1]))
                for a in range(0, len(which), ROWS):
                    i = which[a : a + ROWS]
                    h = (np.exp(2j * np.pi * np.outer(v[i], x))[:, :, None] * np.exp(2j * np.pi * np.outer(u[i], x))[:, None, :]).reshape(len(i), -1) / s[i, None]
                    y = (re[i] + 1j * im[i]) / s[i]
                    total = held.setdefault(key, np.zeros(size))
                    total += np.concatenate([np.real(np.conj(h).T @ h).ravel(), np.real(np.conj(h).T @ y)])
                if len(held) * size > 1 << 22:
                    yield out()
        yield out()

    rows = vis.select((F.col(movie) if movie else F.lit(0)).cast("long").alias("m"), F.col(frame).cast("long").alias("f"), "u", "v", "vis_re", "vis_im", "sigma").dropna().filter("sigma > 0")
    parts = rows.mapInArrow(run, "movie_id long, frame long, sums array<double>")
    sums = parts.select("movie_id", "frame", F.posexplode("sums").alias("at", "value")).groupBy("movie_id", "frame", "at").agg(F.sum("value").alias("value"))
    whole = sums.groupBy("movie_id", "frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda r: r["value"]).alias("sums"))
    return whole.select("movie_id", "frame", F.slice("sums", 1, n**4).alias("info"), F.slice("sums", n**4 + 1, n**2).alias("seen"))


class Filtering:
    """Elements (A, b, C, eta, J) of the filter and how they join."""

    @staticmethod
    def parts(n: int) -> list[tuple[int, ...]]:
        return [(n, n), (n,), (n, n), (n,), (n, n)]

    @staticmethod
    def join(x: list[np.ndarray], y: list[np.ndarray]) -> list[np.ndarray]:
        a, b, c, eta, j = x
        a2, b2, c2, eta2, j2 = y
        one = np.eye(len(b))
        left = np.linalg.solve((one + c @ j2).T, a2.T).T  # A2 (1 + C J2)^-1
        right = np.linalg.solve((one + j2 @ c).T, a).T  # A' (1 + J2 C)^-1
        return [left @ a, left @ (b + c @ eta2) + b2, left @ c @ a2.T + c2, right @ (eta2 - j2 @ b) + eta, right @ j2 @ a + j]


class Smoothing:
    """Elements (E, g, L) of the smoother; the later one comes second."""

    @staticmethod
    def parts(n: int) -> list[tuple[int, ...]]:
        return [(n, n), (n,), (n, n)]

    @staticmethod
    def join(x: list[np.ndarray], y: list[np.ndarray]) -> list[np.ndarray]:
        return [x[0] @ y[0], x[0] @ y[1] + x[1], x[0] @ y[2] @ x[0].T + x[2]]


def _pack(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.ravel(p) for p in parts])


def _unpack(flat: np.ndarray, shapes: list[tuple[int, ...]]) -> list[np.ndarray]:
    edges = np.cumsum([0, *[int(np.prod(s)) for s in shapes]])
    return [flat[a:b].reshape(s) for a, b, s in zip(edges, edges[1:], shapes, strict=False)]


def _grouped(table: DataFrame, keys: list[str], order: str, f: Callable, schema: str) -> DataFrame:
    """f(key, [(order, array or None, ...)]) -> rows, for each group of ``keys`` in order; all other columns are arrays of doubles."""
    names = [c.split()[0] for c in schema.split(", ")]
    arrays = [c for c in table.columns if c not in (*keys, order)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def out() -> pa.RecordBatch:
            made = list(f(now, rows))
            columns = list(zip(*made, strict=True)) if made else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.list_(pa.float64()) if "array" in kind else pa.int64()) for c, kind in zip(columns, schema.split(", "), strict=True)], names)

        for batch in batches:
            own = list(zip(*[batch[k].to_pylist() for k in keys], strict=True))
            at = batch[order].to_pylist()
            values = []
            for c in arrays:
                flat, offsets, valid = batch[c].values.to_numpy(), batch[c].offsets.to_numpy(), batch[c].is_valid().to_pylist()
                values.append([flat[offsets[i] : offsets[i + 1]] if valid[i] else None for i in range(len(at))])
            for key, *row in zip(own, at, *values, strict=True):
                if key != now:
                    if now is not None:
                        yield out()
                    now, rows = key, []
                rows.append(tuple(None if x is None else np.array(x) if isinstance(x, np.ndarray) else x for x in row))
        if now is not None:
            yield out()

    return table.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)


def _scan(elements: DataFrame, kind: type, n: int, last: int, forward: bool, block: int) -> DataFrame:
    """(movie_id, part, element): the joined elements of all parts before each one (after it, if not ``forward``); none for the first."""
    shapes = kind.parts(n)
    join = (lambda held, x: kind.join(held, x)) if forward else (lambda held, x: kind.join(x, held))

    def walk(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
        """Rows of a block with, before the others, one of number -1 that holds what comes from outside."""
        held = None
        outside = [r for r in rows if r[0] < 0]
        if outside and outside[0][1] is not None:
            held = _unpack(outside[0][1], shapes)
        own = [r for r in rows if r[0] >= 0]
        for part, e in own if forward else own[::-1]:
            yield key[0], part, None if held is None else _pack(held)
            x = _unpack(e, shapes)
            held = x if held is None else join(held, x)

    def fold(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
        held = None
        for _, e in rows if forward else rows[::-1]:
            x = _unpack(e, shapes)
            held = x if held is None else join(held, x)
        yield key[0], key[1], _pack(held)

    blocked = elements.withColumn("block", F.expr(f"part div {block}"))
    if last >= block:
        folded = _grouped(blocked, ["movie_id", "block"], "part", fold, "movie_id long, part long, element array<double>")
        before = _scan(folded, kind, n, last // block, forward, block)
        blocked = blocked.unionByName(before.select("movie_id", F.col("part").alias("block"), F.lit(-1).cast("long").alias("part"), "element"))
    return _grouped(blocked, ["movie_id", "block"], "part", walk, "movie_id long, part long, element array<double>")


def smooth(frames: DataFrame, transition: np.ndarray, noise: np.ndarray, mean: np.ndarray, cov: np.ndarray, segment: int = SEGMENT, block: int = BLOCK) -> DataFrame:
    """(movie_id, frame, mean, cov, after): the state of each frame given all of its movie's, and cov(next frame, frame) (null for the last).

    ``frames`` has (movie_id, frame, info, seen) with frames counted from 0 without gaps (a frame without data has zeros); ``mean`` and ``cov``
    are the first frame's prior. An empty table gives no rows.
    """
    n = len(mean)
    f, q = np.asarray(transition, float), np.asarray(noise, float)
    one = np.eye(n)

    def seen(state: tuple, info: np.ndarray, h: np.ndarray) -> tuple:
        m, p = state
        gain = np.linalg.solve(one + p @ info, p)
        return m + gain @ (h - info @ m), (gain + gain.T) / 2

    def element(frame: int, info: np.ndarray, h: np.ndarray) -> list[np.ndarray]:
        if frame == 0:
            m, p = seen((mean, cov), info, h)
            return [np.zeros((n, n)), m, p, np.zeros(n), np.zeros((n, n))]
        left = np.linalg.inv(one + q @ info)
        return [left @ f, left @ q @ h, left @ q, f.T @ left.T @ h, f.T @ left.T @ info @ f]

    def fold(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
        held = None
        for frame, info, h in rows:
            e = element(frame, info.reshape(n, n), h)
            held = e if held is None else Filtering.join(held, e)
        yield key[0], key[1], _pack(held)

    def filtered(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
        """The filter's states; a row of frame -1 holds the joined elements before."""
        state = None
        for frame, info, h, border in rows:
            if frame < 0:
                if border is not None:
                    _, m, p, _, _ = _unpack(border, Filtering.parts(n))
                    state = m, p
                continue
            state = (mean, cov) if frame == 0 else (f @ state[0], f @ state[1] @ f.T + q)
            state = seen(state, info.reshape(n, n), h)
            yield key[0], key[1], frame, state[0], state[1].ravel()

    def gains(m: np.ndarray, p: np.ndarray) -> list[np.ndarray]:
        ahead = f @ p @ f.T + q
        e = np.linalg.solve(ahead, f @ p).T
        return [e, m - e @ f @ m, p - e @ f @ p]

    def backward(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
        held = None
        for frame, m, p, last in rows[::-1]:
            e = [np.zeros((n, n)), m, p.reshape(n, n)] if last is not None else gains(m, p.reshape(n, n))
            held = e if held is None else Smoothing.join(e, held)
        yield key[0], key[1], _pack(held)

    def smoothed(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
        """The smoother's states; a row of frame -1 holds the joined elements after, which are the next segment's first state."""
        after = None
        if rows[0][0] < 0:
            if rows[0][4] is not None:
                _, m, p = _unpack(rows[0][4], Smoothing.parts(n))
                after = m, p
            rows = rows[1:]
        for frame, m, p, last, _ in rows[::-1]:
            p = p.reshape(n, n)
            if last is not None or after is None:
                state, lag = (m, p), None
            else:
                e, g, rest = gains(m, p)
                state, lag = (e @ after[0] + g, e @ after[1] @ e.T + rest), after[1] @ e.T
            yield key[0], frame, state[0], ((state[1] + state[1].T) / 2).ravel(), None if lag is None else lag.ravel()
            after = state

    own = frames.select(F.col("movie_id").cast("long").alias("movie_id"), F.col("frame").cast("long").alias("frame"), "info", "seen").withColumn("part", F.expr(f"frame div {segment}"))
    last = own.agg(F.max("part")).first()[0]
    none = F.lit(None).cast("array<double>")
    schema = "movie_id long, part long, element array<double>"
    if last is None:
        last = 0
    folded = _grouped(own, ["movie_id", "part"], "frame", fold, schema)
    before = _scan(folded, Filtering, n, last, True, block).select("movie_id", "part", F.lit(-1).cast("long").alias("frame"), none.alias("info"), none.alias("seen"), F.col("element").alias("border"))
    states = _grouped(own.withColumn("border", none).unionByName(before), ["movie_id", "part"], "frame", filtered, "movie_id long, part long, frame long, mean array<double>, cov array<double>")
    ends = own.groupBy("movie_id").agg(F.max("frame").alias("_end"))
    states = states.join(ends, "movie_id").withColumn("last", F.when(F.col("frame") == F.col("_end"), F.array(F.lit(1.0)))).drop("_end")
    folded = _grouped(states, ["movie_id", "part"], "frame", backward, schema)
    after = _scan(folded, Smoothing, n, last, False, block).select("movie_id", "part", F.lit(-1).cast("long").alias("frame"), none.alias("mean"), none.alias("cov"), none.alias("last"), F.col("element").alias("border"))
    out = _grouped(states.withColumn("border", none).unionByName(after), ["movie_id", "part"], "frame", smoothed, "movie_id long, frame long, mean array<double>, cov array<double>, lag array<double>")
    return out.select("movie_id", "frame", "mean", "cov", F.col("lag").alias("after"))


def moments(states: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over all steps of E[x x'] of the later frame, of later with earlier, and of the earlier, which the likeliest transition follows from.

    ``states`` are ``smooth``'s; tasks add up, the driver sees 3 n^2 numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, n, n))
        for batch in batches:
            for m, p, m2, p2, lag in zip(*(batch[c].to_pylist() for c in ("mean", "cov", "mean2", "cov2", "after")), strict=True):
                m, m2 = np.array(m), np.array(m2)
                total += np.array([np.array(p2).reshape(n, n) + np.outer(m2, m2), np.array(lag).reshape(n, n) + np.outer(m2, m), np.array(p).reshape(n, n) + np.outer(m, m)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(3 * n * n)), pa.array(total.ravel())], ["at", "value"])

    later = states.select("movie_id", (F.col("frame") - 1).alias("frame"), F.col("mean").alias("mean2"), F.col("cov").alias("cov2"))
    steps = states.filter("after is not null").join(later, ["movie_id", "frame"]).select("mean", "cov", "mean2", "cov2", "after")
    got = steps.mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow().sort_by("at")["value"].to_numpy()
    return tuple(got.reshape(3, n, n)) if len(got) else (np.zeros((n, n)),) * 3


def warp(n: int, parameters: np.ndarray) -> np.ndarray:
    """The matrix that moves an image of n by n pixels: (dx, dy) in pixels and, with six parameters, the linear part's (xx, xy, yx, yy) too.

    A pixel takes the value at its place less the motion, between its four neighbours in proportion; from beyond the edge comes 0.
    """
    p = np.concatenate([np.asarray(parameters, float), np.zeros(6 - len(parameters))])
    y, x = np.indices((n, n), float)
    cx, cy = x - (n - 1) / 2, y - (n - 1) / 2
    sx, sy = x - (p[0] + p[2] * cx + p[3] * cy), y - (p[1] + p[4] * cx + p[5] * cy)
    out, row = np.zeros((n * n, n * n)), np.arange(n * n)
    ix, iy = np.floor(sx).astype(int), np.floor(sy).astype(int)
    for dx in (0, 1):
        for dy in (0, 1):
            wx, wy = (sx - ix if dx else 1 - sx + ix), (sy - iy if dy else 1 - sy + iy)
            jx, jy = ix + dx, iy + dy
            ok = ((jx >= 0) & (jx < n) & (jy >= 0) & (jy < n)).ravel()
            np.add.at(out, (row[ok], (jy * n + jx).ravel()[ok]), (wx * wy).ravel()[ok])
    return out


def learn_warp(frames: DataFrame, n: int, noise: np.ndarray, mean: np.ndarray, cov: np.ndarray, start: np.ndarray, rounds: int = 10, segment: int = SEGMENT, block: int = BLOCK) -> tuple[np.ndarray, list[np.ndarray]]:
    """(parameters, those of every round) of the warp between frames, by expectation and maximisation over all movies.

    A round smooths once and looks for the parameters of the least expected misfit, of a few numbers and n^2 by n^2 sums, on the driver.
    """
    p, path = np.array(start, float), []
    inverse = np.linalg.inv(noise)
    for _ in range(rounds):
        later, cross, earlier = moments(smooth(frames, warp(n, p), noise, mean, cov, segment, block), n * n)

        def misfit(z: np.ndarray, later: np.ndarray = later, cross: np.ndarray = cross, earlier: np.ndarray = earlier) -> float:
            a = warp(n, z)
            return float(np.trace(inverse @ (later - a @ cross.T - cross @ a.T + a @ earlier @ a.T)))

        def both(z: np.ndarray) -> tuple[float, np.ndarray]:
            h = 1e-5
            return misfit(z), np.array([(misfit(z + h * e) - misfit(z - h * e)) / (2 * h) for e in np.eye(len(z))])

        p = lbfgs(both, p, 30)
        path.append(p)
    return p, path
