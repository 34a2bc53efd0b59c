"""Polarised and spectral images: all blocks of unknowns from one pass over the visibilities a step.

The unknowns are changed so that every vector is a possible image: Stokes I is an
exponential, the share m of linear polarisation 1/2 + atan(s) / pi, its angle chi free, and
log I = log I0 + alpha x + beta x^2 in x = ln(frequency / reference). Images of each
product and frequency become grids, which tasks read model visibilities from and add the
misfit's pull up on; gradients by the unknowns follow by the chain rule.

Complex images: P = Q + iU = I m exp(2 i chi).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.minimise import lbfgs
from .gridding import Grid, _touched
from .imaging import ROWS

#: Of each kind of data: the products that its model reads.
READS = {"vis": ("I",), "pvis": ("P",), "m": ("I", "P"), "vvis": ("V",)}
#: Grids of a pass at most: products times frequencies, each held twice by a task.
MOST_GRIDS = 256

Images = dict[tuple[str, int], np.ndarray]
Prior = Callable[[dict[str, np.ndarray]], tuple[float, dict[str, np.ndarray]]]


def data_rows(vis: DataFrame, kind: str, frequency: Column | None = None) -> DataFrame:
    """(u, v, re, im, sigma, f) of a kind of data: "vis", "pvis" (Q + iU), "m" (that over I) or "vvis"; rows with nulls or no error left out.

    ``frequency`` is the row's place in the list of frequencies (default 0).
    """
    s2 = lambda *c: sum((F.col(x) * F.col(x) for x in c), F.lit(0.0))
    p_re, p_im, ps = F.col("qvis_re") - F.col("uvis_im") if kind in ("pvis", "m") else None, F.col("qvis_im") + F.col("uvis_re") if kind in ("pvis", "m") else None, None
    if kind == "vis":
        re, im, s = F.col("vis_re"), F.col("vis_im"), F.col("sigma")
    elif kind == "vvis":
        re, im, s = F.col("vvis_re"), F.col("vvis_im"), F.col("vsigma")
    else:
        ps = s2("qsigma", "usigma")
        re, im, s = p_re, p_im, F.sqrt(ps)
        if kind == "m":
            power = s2("vis_re", "vis_im")
            re, im = (p_re * F.col("vis_re") + p_im * F.col("vis_im")) / F.nullif(power, F.lit(0.0)), (p_im * F.col("vis_re") - p_re * F.col("vis_im")) / F.nullif(power, F.lit(0.0))
            s = F.sqrt((ps + F.col("sigma") * F.col("sigma") * (re * re + im * im)) / power)
    return vis.select("u", "v", re.alias("re"), im.alias("im"), s.alias("sigma"), (F.lit(0) if frequency is None else frequency).cast("int").alias("f")).dropna().filter("sigma > 0")


def _pulls(kind: str, d: np.ndarray, s: np.ndarray, read: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Each row's misfit, and q of each product such that the misfit changes by Re(q dV)."""
    w = 1 / s**2
    if kind == "m":
        m = read["P"] / read["I"]
        pull = -w * np.conj(d - m)
        return w * np.abs(d - m) ** 2 / 2, {"P": pull / read["I"], "I": -pull * m / read["I"]}
    (name,) = READS[kind]
    r = d - read[name]
    return w * np.abs(r) ** 2 / 2, {name: -w * np.conj(r)}


def block_term(rows: dict[str, DataFrame], grid: Grid) -> Callable[[Images], tuple[float, Images]]:
    """f(images by product and frequency) = the sum over kinds of the mean misfit, and its slopes g: a change dX of an image adds Re(sum g dX).

    ``rows`` holds a table of ``data_rows`` for each kind; an evaluation reads each once. Persist tables read for many steps.
    """
    size = grid.cells

    def term(images: Images) -> tuple[float, Images]:
        if len(images) > MOST_GRIDS:
            raise ValueError(f"more than {MOST_GRIDS} images")
        grids = {k: grid.transform(x) for k, x in images.items()}
        value, slopes = 0.0, {k: np.zeros(x.shape, complex) for k, x in images.items()}
        for kind, table in rows.items():
            names = [(p, f) for p, f in images if p in READS[kind]]
            place = {k: i for i, k in enumerate(names)}
            own = {k: grids[k] for k in names}

            def run(batches: Iterator[pa.RecordBatch], kind: str = kind, own: dict = own, place: dict = place) -> Iterator[pa.RecordBatch]:
                pull = np.zeros((len(place), size * size), complex)
                rest = np.zeros(2)
                for batch in batches:
                    u, v, re, im, s, f = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
                    for at in np.unique(f):
                        which = np.flatnonzero(f == at)
                        for a in range(0, len(which), ROWS):
                            i = which[a : a + ROWS]
                            misfit, q = _pulls(kind, re[i] + 1j * im[i], s[i], {p: grid.read(own[p, int(at)], u[i], v[i]) for p in READS[kind]})
                            rest += misfit.sum(), len(i)
                            for p, x in q.items():
                                grid.add(pull[place[p, int(at)]], u[i], v[i], np.conj(x))
                flat = pull.ravel()
                yield _touched(re=np.append(flat.real, rest), im=np.append(flat.imag, [0, 0]))

            got = table.mapInArrow(run, "at long, re double, im double").groupBy("at").agg(F.sum("re").alias("re"), F.sum("im").alias("im")).toArrow()
            whole = np.zeros(len(names) * size * size + 2, complex)
            whole[got["at"].to_numpy()] = got["re"].to_numpy() + 1j * got["im"].to_numpy()
            total, count = whole[-2:].real
            if count:
                value += total / count
                for k, i in place.items():
                    slopes[k] = slopes[k] + np.conj(grid.image(whole[i * size * size : (i + 1) * size * size])) / count
        return float(value), slopes

    return term


@dataclass
class Blocks:
    """Unknown rasters by name out of "I", "m", "chi", "V" (share of I), "alpha" and "beta"; those not solved for keep their start."""

    start: dict[str, np.ndarray]
    solve: tuple[str, ...]
    #: ln(frequency / reference) of each frequency.
    logs: tuple[float, ...] = (0.0,)
    priors: list[tuple[float, Prior]] = field(default_factory=list)

    def pack(self) -> np.ndarray:
        return np.concatenate([self._inner(k, np.asarray(self.start[k], float)).ravel() for k in self.solve])

    @staticmethod
    def _inner(name: str, x: np.ndarray) -> np.ndarray:
        if name == "I":
            return np.log(x)
        if name == "m":
            return np.tan(np.pi * (np.clip(x, 1e-6, 1 - 1e-6) - 0.5))
        if name == "V":
            return np.tan(np.pi / 2 * np.clip(x, -1 + 1e-6, 1 - 1e-6))
        return x

    def rasters(self, z: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        """The images and their slopes by the inner numbers."""
        values, slopes = {k: np.asarray(x, float) for k, x in self.start.items()}, {}
        for name, x in zip(self.solve, np.split(z, len(self.solve)), strict=True):
            x = x.reshape(values[name].shape)
            if name == "I":
                values[name] = slopes[name] = np.exp(np.clip(x, -80, 80))
            elif name == "m":
                values[name], slopes[name] = 0.5 + np.arctan(x) / np.pi, 1 / (np.pi * (1 + x * x))
            elif name == "V":
                values[name], slopes[name] = 2 / np.pi * np.arctan(x), 2 / (np.pi * (1 + x * x))
            else:
                values[name], slopes[name] = x, np.ones_like(x)
        return values, slopes

    def images(self, r: dict[str, np.ndarray]) -> Images:
        out: Images = {}
        for f, x in enumerate(self.logs):
            i = r["I"] * np.exp(r.get("alpha", 0.0) * x + r.get("beta", 0.0) * x * x)
            out["I", f] = i
            if "m" in r:
                out["P", f] = i * r["m"] * np.exp(2j * r["chi"])
            if "V" in r:
                out["V", f] = i * r["V"]
        return out

    def chain(self, r: dict[str, np.ndarray], images: Images, g: Images) -> dict[str, np.ndarray]:
        """Slopes by the rasters, of slopes by the images."""
        out = {k: np.zeros_like(r["I"]) for k in self.solve}

        def add(name: str, x: np.ndarray) -> None:
            if name in out:
                out[name] = out[name] + x

        for f, x in enumerate(self.logs):
            # What a relative change of I does, through every product.
            grown = sum(np.real(g[k] * v) for k, v in images.items() if k[1] == f)
            add("I", grown / r["I"])
            add("alpha", x * grown)
            add("beta", x * x * grown)
            if "m" in r:
                turn = images["I", f] * np.exp(2j * r["chi"])
                add("m", np.real(g["P", f] * turn))
                add("chi", np.real(g["P", f] * 2j * r["m"] * turn))
            if "V" in r:
                add("V", np.real(g["V", f] * images["I", f]))
        return out

    def objective(self, term: Callable[[Images], tuple[float, Images]]) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
        def f(z: np.ndarray) -> tuple[float, np.ndarray]:
            r, inner = self.rasters(z)
            images = self.images(r)
            value, g = term(images)
            slope = self.chain(r, images, g)
            for weight, prior in self.priors:
                a, b = prior(r)
                value += weight * a
                for k, x in b.items():
                    if k in slope:
                        slope[k] = slope[k] + weight * x
            return value, np.concatenate([(slope[k] * inner[k]).ravel() for k in self.solve])

        return f


def solve(rows: dict[str, DataFrame], grid: Grid, blocks: Blocks, steps: int = 100) -> dict[str, np.ndarray]:
    """The rasters of the least sum of misfits and priors; each step reads the tables of ``rows`` once."""
    f = blocks.objective(block_term(rows, grid))
    return blocks.rasters(lbfgs(f, blocks.pack(), steps))[0]


def smooth(names: tuple[str, ...]) -> Prior:
    """Sum of squared steps between neighbours of each named raster."""

    def prior(r: dict[str, np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
        value, slopes = 0.0, {}
        for k in names:
            g = np.zeros_like(r[k])
            for axis in (0, 1):
                d = np.diff(r[k], axis=axis)
                value += float((d**2).sum())
                low, high = [slice(None)] * 2, [slice(None)] * 2
                low[axis], high[axis] = slice(None, -1), slice(1, None)
                g[tuple(high)] += 2 * d
                g[tuple(low)] -= 2 * d
            slopes[k] = g
        return value, slopes

    return prior


def polarised_total_variation(soft: float = 1e-12) -> Prior:
    """Sum over pixels of the length of the complex gradient of P = I m exp(2 i chi), over the flux; zeros beyond the edge."""

    def prior(r: dict[str, np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
        flux = r["I"].sum()
        turn = np.exp(2j * r["chi"])
        p = r["I"] * r["m"] * turn
        right, down = np.diff(p, axis=1, append=0), np.diff(p, axis=0, append=0)
        length = np.sqrt(np.abs(right) ** 2 + np.abs(down) ** 2 + soft)
        a, b = np.conj(right) / length / flux, np.conj(down) / length / flux
        g = -a - b
        g[:, 1:] += a[:, :-1]
        g[1:] += b[:-1]
        total = float(length.sum() / flux)
        return total, {"m": np.real(g * r["I"] * turn), "chi": np.real(g * 2j * p), "I": np.real(g * r["m"] * turn) - total / flux}

    return prior
