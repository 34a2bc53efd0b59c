"""CLEAN on closure quantities: point components found from bispectra or closure phases, which no station's gain changes.

A component of flux d at a pixel changes the misfit by about P d + Q d^2. Both are sums over
the triangles of exponentials of the pixel's place, so a step is one job: tasks
read the model's visibilities from its grid, add what P and Q need up on two grids of
their own, and cells are summed by a shuffle; the driver sees two rasters. The
pixel of the greatest fall of the misfit gets a share of its best flux.

P and Q of bispectra are exact to second order, those of phases leave out the
curvature of the phase itself (as Gauss-Newton steps do).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gridding import Grid, _touched
from .imaging import DATA, ROWS

PAIRS = ((0, 1, 2), (1, 2, 0), (2, 0, 1))


def _terms(kind: str, data: list[np.ndarray], v: list[np.ndarray], weights: str) -> tuple[np.ndarray, list[tuple[tuple[int, int, int], np.ndarray]], list[tuple[tuple[int, int, int], np.ndarray]], np.ndarray]:
    """Misfit of each row; of P and of Q, (how often each leg counts, q): Re of the sum of q exp(2 pi i times the legs so added); and Q's part without x."""
    leg = lambda *k: tuple(int(sum(s for j, s in k if j == i)) for i in range(3))
    s = data[-1]
    if kind == "bispec":
        w = 1 / s**2 if weights == "natural" else np.ones(len(s))
        c = [v[1] * v[2], v[0] * v[2], v[0] * v[1]]
        r = data[0] + 1j * data[1] - v[0] * c[0]
        first = [(leg((k, 1)), -2 * w * np.conj(r) * c[k]) for k in range(3)]
        second = [(leg((i, 1), (j, -1)), 2 * w * c[i] * np.conj(c[j])) for i, j, _ in PAIRS]
        second += [(leg((i, 1), (j, 1)), -2 * w * np.conj(r) * v[k]) for i, j, k in PAIRS]
        return w * np.abs(r) ** 2, first, second, w * sum(np.abs(x) ** 2 for x in c)
    e = np.radians(s)
    w = 1 / e**2 if weights == "natural" else np.ones(len(s))
    turn = np.radians(data[0]) - np.angle(v[0] * v[1] * v[2])
    z = [1 / x for x in v]
    first = [(leg((k, 1)), 2j * w * np.sin(turn) * z[k]) for k in range(3)]
    second = [(leg((i, 1), (j, -1)), w * z[i] * np.conj(z[j])) for i, j, _ in PAIRS]
    second += [(leg((k, 2)), -w / 2 * z[k] ** 2) for k in range(3)]
    second += [(leg((i, 1), (j, 1)), -w * z[i] * z[j]) for i, j, _ in PAIRS]
    return 2 * w * (1 - np.cos(turn)), first, second, w / 2 * sum(np.abs(x) ** 2 for x in z)


def derivatives(rows: DataFrame, kind: str, image: np.ndarray, grid: Grid, weights: str = "natural") -> tuple[float, np.ndarray, np.ndarray, int]:
    """(misfit, P, Q, rows) of an image, whose visibilities must not vanish; one job over ``rows``, a table of DATA's columns without nulls."""
    columns, legs = DATA[kind]
    model, size = grid.transform(image), grid.cells

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, q, rest = np.zeros(size * size, complex), np.zeros(size * size, complex), np.zeros(3)
        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in range(batch.num_columns)]
            for a in range(0, batch.num_rows, ROWS):
                part = [c[a : a + ROWS] for c in cols]
                data, us, vs = part[: len(columns)], part[len(columns) :: 2], part[len(columns) + 1 :: 2]
                misfit, first, second, constant = _terms(kind, data, [grid.read(model, u, v) for u, v in zip(us, vs, strict=True)], weights)
                for total, terms in ((p, first), (q, second)):
                    for times, value in terms:
                        grid.add(total, sum(t * u for t, u in zip(times, us, strict=True)), sum(t * v for t, v in zip(times, vs, strict=True)), np.conj(value))
                rest += misfit.sum(), constant.sum(), len(misfit)
        zero = np.zeros(3)
        yield _touched(p_re=np.append(p.real, rest), p_im=np.append(p.imag, zero), q_re=np.append(q.real, zero), q_im=np.append(q.imag, zero))

    names = ("p_re", "p_im", "q_re", "q_im")
    got = rows.mapInArrow(run, "at long, " + ", ".join(f"{c} double" for c in names)).groupBy("at").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    whole = np.zeros((4, size * size + 3))
    for k, c in enumerate(names):
        whole[k, got["at"].to_numpy()] = got[c].to_numpy()
    misfit, constant, count = whole[0, -3:]
    image_of = lambda a, b: grid.image(whole[a, :-3] + 1j * whole[b, :-3]).real
    return float(misfit), image_of(0, 1), image_of(2, 3) + constant, int(count)


def clean_closures(table: DataFrame, kind: str, n: int, pixel: float, steps: int = 100, gain: float = 0.1, weights: str = "natural", mask: np.ndarray | None = None, positive: bool = True, start: np.ndarray | None = None, threshold: float = 0.0, width: int = 8) -> tuple[np.ndarray, list[float]]:
    """(components, misfit a row after each step) of a table of "bispec" or "cphase" with its legs.

    ``start`` is a first image; by default one point in the middle (pixel n // 2), of the bispectra's mean flux or, for phases, which tell no
    flux, of 1. Stops early where no component lowers the misfit by more than ``threshold`` times it. Rows with nulls take no part.
    Persist a table that is read for many steps.
    """
    if kind not in ("bispec", "cphase"):
        raise ValueError(kind)
    columns, legs = DATA[kind]
    rows = table.select(*columns, *[c for leg in legs for c in leg]).dropna()
    grid = Grid(n, pixel, width=width)
    image = np.zeros((n, n)) if start is None else np.array(start, float)
    if start is None:
        w = 1 / (F.col(columns[-1]) * F.col(columns[-1])) if weights == "natural" else F.lit(1.0)
        mean = rows.agg(F.sum(w * F.col(columns[0])) / F.sum(w)).first()[0] if kind == "bispec" else 1.0
        if mean is None:
            return image, []
        image[n // 2, n // 2] = np.cbrt(mean)
    history: list[float] = []
    for _ in range(steps):
        misfit, p, q, count = derivatives(rows, kind, image, grid, weights)
        if not count:
            break
        history.append(misfit / count)
        usable = (q > 0) & (np.ones((n, n), bool) if mask is None else mask)
        if positive:
            usable &= p < 0
        fall = np.where(usable, p**2 / (4 * np.where(q > 0, q, 1)), 0.0)
        at = np.unravel_index(np.argmax(fall), fall.shape)
        if not fall[at] > threshold * misfit:
            break
        image[at] -= gain * p[at] / (2 * q[at])
    return image, history
