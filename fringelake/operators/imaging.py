"""Images from visibilities: dirty maps, CLEAN, regularised least squares and Gaussian fits.

A least-squares data term of complex visibilities needs the data once: the dirty
map and the map of pixel offsets hold all of it, so any number of iterations then
runs on the driver over two rasters. Terms that are not linear in the image
(amplitudes, closures) take one distributed pass per evaluation; what tasks send
back is one raster each, summed by pixel before it reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import complexes as cx
from ..functions.minimise import lbfgs

#: Rows of a product of transform matrices at a time.
ROWS = 4096


@dataclass(frozen=True)
class Sums:
    """All that least squares asks of the visibilities, for square images of ``pixel`` radians.

    dirty: sum of w Re(v exp(-2 pi i (u x + v y))) at each pixel; spread: sum of w cos(2 pi (u dx + v dy)) at each
    offset of up to n - 1 pixels; power: sum of w |v|^2; weight: sum of w; count: rows.
    """

    dirty: np.ndarray
    spread: np.ndarray
    power: float
    weight: float
    count: int
    pixel: float

    def spread_of(self, image: np.ndarray) -> np.ndarray:
        """The image under the normal operator."""
        n = len(self.dirty)
        size = 3 * n
        f = np.fft.rfft2(image, (size, size)) * np.fft.rfft2(self.spread, (size, size))
        return np.fft.irfft2(f, (size, size))[n - 1 : 2 * n - 1, n - 1 : 2 * n - 1]

    def chisq(self, image: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean of w |v - V|^2 / 2 and its gradient."""
        s, n = self.spread_of(image), 2 * max(self.count, 1)
        return float((self.power - 2 * (image * self.dirty).sum() + (image * s).sum()) / n), 2 * (s - self.dirty) / n


def positions(n: int, pixel: float) -> np.ndarray:
    """Pixel centres, falling."""
    return ((n - 1) / 2 - np.arange(n)) * pixel


def normal_sums(vis: DataFrame, n: int, pixel: float, weighting: str = "natural", data: str = "vis", sigma: str = "sigma") -> Sums:
    """One pass over the visibilities; weights are 1 / sigma^2, or ("uniform") 1. Rows with nulls take no part."""
    return frame_sums(vis.withColumn("_frame", F.lit(0)), n, pixel, "_frame", weighting, data, sigma).get(0) or Sums(np.zeros((n, n)), np.zeros((2 * n - 1, 2 * n - 1)), 0.0, 0.0, 0, pixel)


def frame_sum_rows(vis: DataFrame, n: int, pixel: float, frame: str, weighting: str = "natural", data: str = "vis", sigma: str = "sigma") -> DataFrame:
    """(frame, at, value): the sums of each value of the integer column ``frame``, as dirty, spread, power, weight and count one after another.

    One pass; a task holds a raster for each frame it meets.
    """
    x, offsets = positions(n, pixel), np.arange(-(n - 1), n) * pixel

    size = n * n + (2 * n - 1) ** 2 + 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
            for k in np.unique(cols[5]):
                rows = np.flatnonzero(cols[5] == k)
                total = held.setdefault(int(k), np.zeros(size))
                for a in range(0, len(rows), ROWS):
                    u, v, re, im, s = (c[rows[a : a + ROWS]] for c in cols[:5])
                    w = 1 / s**2 if weighting == "natural" else np.ones(len(s))
                    z = re + 1j * im
                    dirty = np.real((np.exp(-2j * np.pi * np.outer(x, v)) * (w * z)) @ np.exp(-2j * np.pi * np.outer(u, x)))
                    spread = np.real((np.exp(-2j * np.pi * np.outer(offsets, v)) * w) @ np.exp(-2j * np.pi * np.outer(u, offsets)))
                    total += np.concatenate([dirty.ravel(), spread.ravel(), [(w * np.abs(z) ** 2).sum(), w.sum(), len(u)]])
        for k, total in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, k)), pa.array(np.arange(size)), pa.array(total)], ["frame", "at", "value"])

    usable = vis.select("u", "v", f"{data}_re", f"{data}_im", sigma, F.col(frame).cast("long").alias("_f")).dropna().filter(F.col(sigma) > 0)
    return usable.mapInArrow(run, "frame long, at long, value double").groupBy("frame", "at").agg(F.sum("value").alias("value"))


def frame_sums(vis: DataFrame, n: int, pixel: float, frame: str, weighting: str = "natural", data: str = "vis", sigma: str = "sigma") -> dict[int, Sums]:
    """The sums of each value of the integer column ``frame``."""
    size = n * n + (2 * n - 1) ** 2 + 3
    sums = frame_sum_rows(vis, n, pixel, frame, weighting, data, sigma).toArrow().sort_by([("frame", "ascending"), ("at", "ascending")])
    values, m = sums["value"].to_numpy().reshape(-1, size), n * n
    # Offsets rise along the axes of spread while positions fall; the cosine is even, so either order serves.
    return {int(k): Sums(got[:m].reshape(n, n), got[m:-3].reshape(2 * n - 1, 2 * n - 1), float(got[-3]), float(got[-2]), int(got[-1]), pixel) for k, got in zip(sums["frame"].to_numpy()[::size], values, strict=True)}


def dirty_image(sums: Sums) -> np.ndarray:
    """Mean over the visibilities of w Re(v exp(-2 pi i (u x + v y)))."""
    return sums.dirty / max(sums.weight, 1e-300)


def clean(sums: Sums, steps: int = 1000, gain: float = 0.1, mask: np.ndarray | None = None, threshold: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(components, residual) by taking a share of the highest point's response away, ``steps`` times or down to ``threshold``."""
    n = len(sums.dirty)
    if not sums.weight > 0:
        return np.zeros((n, n)), np.zeros((n, n))
    left, beam = dirty_image(sums).copy(), sums.spread / sums.weight
    found = np.zeros((n, n))
    for _ in range(steps):
        look = np.where(mask, left, 0.0) if mask is not None else left
        iy, ix = np.unravel_index(np.argmax(np.abs(look)), look.shape)
        peak = look[iy, ix]
        if abs(peak) <= threshold:
            break
        found[iy, ix] += gain * peak
        left -= gain * peak * beam[n - 1 - iy : 2 * n - 1 - iy, n - 1 - ix : 2 * n - 1 - ix]
    return found, left


def restore(components: np.ndarray, residual: np.ndarray, fwhm_pixels: float) -> np.ndarray:
    """Components under a round Gaussian of unit sum, with the residual."""
    from .raster import blur_circular

    return blur_circular(components, fwhm_pixels) + residual


Term = Callable[[np.ndarray], tuple[float, np.ndarray]]


def entropy(prior: np.ndarray) -> Term:
    """sum x log(x / prior) over the prior's flux: least at prior / e."""
    flux = prior.sum()
    return lambda x: (float((x * np.log(x / prior)).sum() / flux), (np.log(x / prior) + 1) / flux)


def sparsity(flux: float) -> Term:
    return lambda x: (float(np.abs(x).sum() / flux), np.sign(x) / flux)


def total_variation(flux: float, squared: bool = False, soft: float = 1e-12) -> Term:
    """Sum of the lengths (or squares) of the gradient, zeros beyond the edge."""

    def term(x: np.ndarray) -> tuple[float, np.ndarray]:
        right, down = np.diff(x, axis=1, append=0.0), np.diff(x, axis=0, append=0.0)
        size = right**2 + down**2
        if squared:
            value, a, b = size.sum() / flux**2, 2 * right / flux**2, 2 * down / flux**2
        else:
            length = np.sqrt(size + soft)
            value, a, b = length.sum() / flux, right / length / flux, down / length / flux
        g = -a - b
        g[:, 1:] += a[:, :-1]
        g[1:] += b[:-1]
        return float(value), g

    return term


def total_flux(flux: float) -> Term:
    return lambda x: (float((x.sum() - flux) ** 2 / flux**2), np.full(x.shape, 2 * (x.sum() - flux) / flux**2))


def centred(flux: float) -> Term:
    """Squared distance of the flux's centre from the middle, in pixels."""

    def term(x: np.ndarray) -> tuple[float, np.ndarray]:
        n = len(x)
        at = np.arange(n) - (n - 1) / 2
        cx_, cy = (x.sum(0) * at).sum() / flux, (x.sum(1) * at).sum() / flux
        return float(cx_**2 + cy**2), 2 * (cx_ * at[None, :] + cy * at[:, None]) / flux

    return term


def make_image(terms: list[tuple[float, Term]], start: np.ndarray, steps: int = 200) -> np.ndarray:
    """The positive image of the least weighted sum of terms, by L-BFGS on its logarithm from the positive image ``start``."""
    shape = start.shape

    def f(z: np.ndarray) -> tuple[float, np.ndarray]:
        x = np.exp(np.clip(z, -80, 80)).reshape(shape)
        value, slope = 0.0, np.zeros(shape)
        for weight, term in terms:
            a, b = term(x)
            value, slope = value + weight * a, slope + weight * b
        return value, (slope * x).ravel()

    return np.exp(np.clip(lbfgs(f, np.log(start).ravel(), steps), -80, 80)).reshape(shape)


def make_signed_image(terms: list[tuple[float, Term]], start: np.ndarray, steps: int = 300) -> np.ndarray:
    """The image of either sign (Q, U or V) of the least weighted sum of terms."""
    shape = start.shape

    def f(z: np.ndarray) -> tuple[float, np.ndarray]:
        got = [(w, *term(z.reshape(shape))) for w, term in terms]
        return sum(w * a for w, a, _ in got), sum(w * b for w, _, b in got).ravel()

    return lbfgs(f, start.ravel(), steps).reshape(shape)


def make_movie(sums: dict[int, Sums], start: np.ndarray, image_terms: list[tuple[float, Term]], steadiness: float = 1.0, steps: int = 300) -> dict[int, np.ndarray]:
    """Positive frames of all keys in order: each frame's data term and image terms, and ``steadiness`` times the squared steps
    between consecutive frames over the squared flux of ``start`` (the mean frame's guess)."""
    keys = sorted(sums)
    shape, flux = (len(keys), *start.shape), start.sum()

    def f(z: np.ndarray) -> tuple[float, np.ndarray]:
        x = np.exp(np.clip(z, -80, 80)).reshape(shape)
        value, slope = 0.0, np.zeros(shape)
        for k, frame in enumerate(x):
            for weight, term in [(1.0, sums[keys[k]].chisq), *image_terms]:
                a, b = term(frame)
                value, slope[k] = value + weight * a, slope[k] + weight * b
        step = np.diff(x, axis=0) * (steadiness / flux**2)
        value += float((step * np.diff(x, axis=0)).sum())
        slope[1:] += 2 * step
        slope[:-1] -= 2 * step
        return value, (slope * x).ravel()

    x = np.exp(np.clip(lbfgs(f, np.log(np.broadcast_to(start, shape)).ravel(), steps), -80, 80)).reshape(shape)
    return dict(zip(keys, x, strict=True))


#: Of each data product: its columns, and the legs (u, v) of a row.
DATA = {
    "vis": (("vis_re", "vis_im", "sigma"), (("u", "v"),)),
    "amp": (("amp", "sigma"), (("u", "v"),)),
    "logamp": (("amp", "sigma"), (("u", "v"),)),
    "bispec": (("bispec_re", "bispec_im", "sigmab"), (("u1", "v1"), ("u2", "v2"), ("u3", "v3"))),
    "cphase": (("cphase", "sigmacp"), (("u1", "v1"), ("u2", "v2"), ("u3", "v3"))),
    "camp": (("camp", "sigmaca"), (("u1", "v1"), ("u2", "v2"), ("u3", "v3"), ("u4", "v4"))),
    "logcamp": (("camp", "sigmaca"), (("u1", "v1"), ("u2", "v2"), ("u3", "v3"), ("u4", "v4"))),
}


def _pull(kind: str, data: list[np.ndarray], legs: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each row's misfit, and q of each leg such that the misfit's change is Re(q dV)."""
    s = data[-1]
    if kind == "vis":
        d = data[0] + 1j * data[1] - legs[0]
        return np.abs(d) ** 2 / s**2 / 2, [-np.conj(d) / s**2]
    if kind == "bispec":
        b = legs[0] * legs[1] * legs[2]
        d = data[0] + 1j * data[1] - b
        return np.abs(d) ** 2 / s**2 / 2, [-np.conj(d) * b / v / s**2 for v in legs]
    if kind == "cphase":  # degrees
        c, e = np.radians(data[0]) - np.angle(legs[0] * legs[1] * legs[2]), np.radians(s)
        return 2 * (1 - np.cos(c)) / e**2, [2j * np.sin(c) / e**2 / v for v in legs]
    if kind == "amp":
        d, v = data[0] - np.abs(legs[0]), legs[0]
        return d**2 / s**2, [-2 * d / s**2 * np.conj(v) / np.abs(v)]
    if kind == "logamp":
        e = s / data[0]
        d = np.log(data[0]) - np.log(np.abs(legs[0]))
        return d**2 / e**2, [-2 * d / e**2 / legs[0]]
    power = (1, 1, -1, -1)
    log = sum(p * np.log(np.abs(v)) for p, v in zip(power, legs, strict=True))
    if kind == "logcamp":
        d = data[0] - log
        return d**2 / s**2, [-2 * d / s**2 * p / v for p, v in zip(power, legs, strict=True)]
    d = data[0] - np.exp(log)
    return d**2 / s**2, [-2 * d / s**2 * np.exp(log) * p / v for p, v in zip(power, legs, strict=True)]


def data_term(table: DataFrame, kind: str, n: int, pixel: float) -> Term:
    """The reduced chi-square of a table of ``kind`` and its gradient by the image; each evaluation is one job over the table.

    Persist a table that is read for many evaluations. Rows with nulls take no part; an empty table gives 0.
    """
    columns, legs = DATA[kind]
    rows = table.select(*columns, *[c for leg in legs for c in leg]).dropna()
    x = positions(n, pixel)

    def term(image: np.ndarray) -> tuple[float, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, slope, count = 0.0, np.zeros((n, n)), 0
            for batch in batches:
                cols = [batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in range(batch.num_columns)]
                for a in range(0, batch.num_rows, ROWS):
                    part = [c[a : a + ROWS] for c in cols]
                    data, uv = part[: len(columns)], part[len(columns) :]
                    ey = [np.exp(2j * np.pi * np.outer(v, x)) for v in uv[1::2]]
                    ex = [np.exp(2j * np.pi * np.outer(u, x)) for u in uv[::2]]
                    misfit, q = _pull(kind, data, [((y @ image) * e).sum(1) for y, e in zip(ey, ex, strict=True)])
                    total, count = total + misfit.sum(), count + len(misfit)
                    slope += sum(np.real((y * k[:, None]).T @ e) for y, e, k in zip(ey, ex, q, strict=True))
            values = np.concatenate([slope.ravel(), [total, count]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["at", "value"])

        got = rows.mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow().sort_by("at")["value"].to_numpy()
        if not len(got) or not got[-1]:
            return 0.0, np.zeros((n, n))
        return float(got[-2] / got[-1]), got[:-2].reshape(n, n) / got[-1]

    return term


GAUSSIAN = ("flux", "x", "y", "a", "b", "c")


def fit_gaussian(vis: DataFrame, start: dict[str, float], steps: int = 30) -> dict[str, float]:
    """The elliptic Gaussian nearest to the visibilities: flux exp(2 pi i (u x + v y) - 2 pi^2 (a u^2 + 2 c u v + b v^2)).

    a, b and c are the covariance (radians squared). Each step is one aggregation of the normal equations, damped until it lowers
    chi-square. Returns the parameters, the major and minor widths and position angle (radians), and chisq.
    """
    w = 1 / (F.col("sigma") * F.col("sigma"))
    u, v = F.col("u"), F.col("v")
    usable = vis.select("u", "v", "vis_re", "vis_im", "sigma").dropna().filter("sigma > 0")
    # Parameters of like size: positions and widths in units of 1 / largest baseline.
    reach = usable.agg(F.max(F.hypot("u", "v"))).first()[0]
    if not reach:
        raise ValueError("no usable visibilities of length above 0")
    unit = np.array([1, 1 / reach, 1 / reach, 1 / reach**2, 1 / reach**2, 1 / reach**2])

    def at(p: np.ndarray):
        flux, x, y, a, b, c = (float(k) for k in p * unit)
        size, turn = F.exp(-2 * np.pi**2 * (a * u * u + 2 * c * u * v + b * v * v)), 2 * np.pi * (u * x + v * y)
        unit_z = (size * F.cos(turn), size * F.sin(turn))
        model = cx.scale(unit_z, flux)
        d = cx.sub(cx.pair("vis"), model)
        k = 2 * np.pi**2
        slopes = [unit_z, cx.scale(cx.times_i(model), 2 * np.pi * u * unit[1]), cx.scale(cx.times_i(model), 2 * np.pi * v * unit[2]), cx.scale(model, -k * u * u * unit[3]), cx.scale(model, -k * v * v * unit[4]), cx.scale(model, -2 * k * u * v * unit[5])]
        dot = lambda p, q: p[0] * q[0] + p[1] * q[1]
        sums = [F.avg(w * dot(d, d)).alias("chi")]
        sums += [F.avg(w * dot(d, s)).alias(f"r{i}") for i, s in enumerate(slopes)]
        sums += [F.avg(w * dot(slopes[i], slopes[j])).alias(f"m{i}{j}") for i in range(6) for j in range(i, 6)]
        got = usable.agg(*sums).first()
        m = np.array([[got[f"m{min(i, j)}{max(i, j)}"] for j in range(6)] for i in range(6)])
        return got["chi"] / 2, np.array([got[f"r{i}"] for i in range(6)]), m

    p = np.array([start[k] for k in GAUSSIAN], float) / unit
    chi, right, matrix = at(p)
    damp = 1e-3
    for _ in range(steps):
        there = p + np.linalg.lstsq(matrix + damp * np.diag(np.diag(matrix) + 1e-300), right, rcond=None)[0]
        new = at(there)
        if np.isfinite(new[0]) and new[0] <= chi:
            done = chi - new[0] <= 1e-10 * max(chi, 1e-300)
            p, (chi, right, matrix), damp = there, new, damp / 10
            if done:
                break
        else:
            damp *= 10
            if damp > 1e12:
                break
    out = dict(zip(GAUSSIAN, (float(k) for k in p * unit), strict=True))
    return out | widths(out["a"], out["b"], out["c"]) | {"chisq": float(chi)}


def widths(a: float, b: float, c: float) -> dict[str, float]:
    """Major and minor full widths at half maximum and the position angle (from y towards x) of a covariance."""
    middle, half = (a + b) / 2, np.hypot((a - b) / 2, c)
    k = np.sqrt(8 * np.log(2))
    return {"major": float(k * np.sqrt(max(middle + half, 0))), "minor": float(k * np.sqrt(max(middle - half, 0))), "angle": float(np.arctan2(2 * c, b - a) / 2)}


def clean_beam(vis: DataFrame, weighting: str = "natural") -> dict[str, float]:
    """Widths and angle (radians) of the Gaussian with the dirty beam's curvature at its middle, from weighted second moments of u and v."""
    w = 1 / (F.col("sigma") * F.col("sigma")) if weighting == "natural" else F.lit(1.0)
    got = vis.agg(*[(F.sum(w * F.col(p) * F.col(q)) / F.sum(w)).alias(p + q) for p, q in (("u", "u"), ("v", "v"), ("u", "v"))]).first()
    inverse = np.linalg.inv(4 * np.pi**2 * np.array([[got["uu"], got["uv"]], [got["uv"], got["vv"]]]))
    return widths(inverse[0, 0], inverse[1, 1], inverse[0, 1])
