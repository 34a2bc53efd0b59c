"""Analytic source models: visibilities of sums of components, a batch of rows at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.bessel import jn

KINDS = ("point", "circ_gauss", "gauss", "disk", "blurred_disk", "crescent", "blurred_crescent", "ring", "thick_ring", "mring", "thick_mring")


@dataclass(frozen=True)
class Component:
    """One part of a source; lengths and angles in radians.

    d: diameter; fwhm: of a round Gaussian; major, minor, angle: of an elliptic one; alpha: width of blurring; of crescents:
    fr, the inner diameter's share of the outer, fo, the shift of the hole as a share of the room it has (0 to 1), ff, the hole's
    brightness as a share of the disk's, towards angle; beta: complex modes 1, 2, ... of a ring's brightness.
    """

    kind: str
    flux: float
    x: float = 0.0
    y: float = 0.0
    d: float = 0.0
    fwhm: float = 0.0
    major: float = 0.0
    minor: float = 0.0
    angle: float = 0.0
    alpha: float = 0.0
    fr: float = 0.5
    fo: float = 0.0
    ff: float = 0.0
    beta: tuple[complex, ...] = field(default=())

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"no component {self.kind!r}; there are {', '.join(KINDS)}")


def _disk(rho: np.ndarray, d: float) -> np.ndarray:
    z = np.pi * d * rho
    return np.where(z > 1e-8, 2 * jn(1, z) / np.where(z > 1e-8, z, 1.0), 1.0)


def _blur(rho: np.ndarray, fwhm: float) -> np.ndarray:
    return np.exp(-((np.pi * fwhm * rho) ** 2) / (4 * np.log(2)))


def sample(c: Component, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Complex visibilities of one component."""
    rho, shift = np.hypot(u, v), np.exp(2j * np.pi * (u * c.x + v * c.y))
    kind = c.kind.removeprefix("blurred_").removeprefix("thick_")
    if kind == "point":
        z = np.ones(u.shape)
    elif kind == "circ_gauss":
        z = _blur(rho, c.fwhm)
    elif kind == "gauss":
        along, across = u * np.sin(c.angle) + v * np.cos(c.angle), u * np.cos(c.angle) - v * np.sin(c.angle)
        z = _blur(along, c.major) * _blur(across, c.minor)
    elif kind == "disk":
        z = _disk(rho, c.d)
    elif kind == "crescent":
        # A uniform disk less a smaller one of 1 - ff times its brightness.
        room = c.fo * (1 - c.fr) * c.d / 2
        hole = np.exp(2j * np.pi * room * (u * np.sin(c.angle) + v * np.cos(c.angle)))
        share = (1 - c.ff) * c.fr**2
        z = (_disk(rho, c.d) - share * _disk(rho, c.fr * c.d) * hole) / (1 - share)
    else:
        z = jn(0, np.pi * c.d * rho).astype(complex)
        turn = np.arctan2(u, v) - np.pi / 2
        for m, b in enumerate(c.beta, 1):
            size = jn(m, np.pi * c.d * rho)
            z = z + size * (b * np.exp(1j * m * turn) + (-1) ** m * np.conj(b) * np.exp(-1j * m * turn))
    if c.kind.startswith(("blurred_", "thick_")):
        z = z * _blur(rho, c.alpha)
    return c.flux * z * shift


def model_visibilities(points: DataFrame, components: list[Component], prefix: str = "vis") -> DataFrame:
    """Add ``prefix``_re and ``prefix``_im: the sum of the components at each row's u and v (NULL where either is)."""
    names = [f"{prefix}_re", f"{prefix}_im"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = (batch[c].to_numpy(zero_copy_only=False).astype(float) for c in ("u", "v"))
            z = sum((sample(c, u, v) for c in components), np.zeros(len(u), complex))
            z = np.where(np.isnan(u) | np.isnan(v), np.nan, z)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(z.real, from_pandas=True), pa.array(z.imag, from_pandas=True)], [*batch.schema.names, *names])

    base = points.drop(*names)
    return base.mapInArrow(run, StructType([*base.schema.fields, *(StructField(n, DoubleType()) for n in names)]))


def fit_components(vis: DataFrame, components: list[Component], free: list[tuple[int, str]], scales: list[float], steps: int = 40) -> tuple[list[Component], float]:
    """Least squares of the free parameters (number of the component, name), and the reduced chi-square.

    ``scales`` are the sizes by which parameters are expected to change. Each step is one pass: tasks add up the normal equations
    of their rows (derivatives by central differences), of the size of the parameters squared. Steps are damped until they lower
    chi-square. Rows with nulls take no part.
    """
    usable = vis.select("u", "v", "vis_re", "vis_im", "sigma").dropna().filter("sigma > 0").persist()
    k = len(free)
    size = 1 + k + k * k + 1

    def moved(parts: list[Component], changes: np.ndarray) -> list[Component]:
        out = list(parts)
        for (i, name), scale, change in zip(free, scales, changes, strict=True):
            out[i] = replace(out[i], **{name: getattr(out[i], name) + float(change) * scale})
        return out

    def equations(parts: list[Component]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                u, v, re, im, s = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(5))
                model = lambda p: sum(sample(c, u, v) for c in p)  # noqa: B023, E731
                d = (re + 1j * im - model(parts)) / s
                steps_ = 1e-4 * np.eye(k)
                slopes = [(model(moved(parts, e)) - model(moved(parts, -e))) / 2e-4 / s for e in steps_]
                j = np.array([np.concatenate([x.real, x.imag]) for x in slopes]).reshape(k, -1)
                r = np.concatenate([d.real, d.imag])
                total += np.concatenate([[r @ r], j @ r, (j @ j.T).ravel(), [len(u)]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["at", "value"])

        got = usable.mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow().sort_by("at")["value"].to_numpy()
        return got if len(got) else np.zeros(size)

    now, damp = equations(components), 1e-3
    if not now[-1]:
        usable.unpersist()
        raise ValueError("no usable visibilities")
    for _ in range(steps):
        matrix = now[1 + k : -1].reshape(k, k)
        change = np.linalg.lstsq(matrix + damp * np.diag(np.diag(matrix) + 1e-300), now[1 : 1 + k], rcond=None)[0]
        there = moved(components, change)
        new = equations(there)
        if np.isfinite(new[0]) and new[0] <= now[0]:
            done = now[0] - new[0] <= 1e-9 * max(now[0], 1e-300)
            components, now, damp = there, new, damp / 10
            if done:
                break
        else:
            damp *= 10
            if damp > 1e10:
                break
    usable.unpersist()
    return components, float(now[0] / (2 * now[-1]))
