"""Gridded Fourier transforms between images and visibilities.

A visibility meets the cells around its place, weighted by a kernel, so the work is
rows times kernel cells where the direct transform is rows times pixels. Each
task adds its rows up on a grid of its own and passes on the cells it has touched; cells
are summed by a shuffle, and one FFT over the summed grid, whose size is a
parameter, gives the image, corrected by the kernel's transform. Model
visibilities come from the adjoint: one FFT, whose grid tasks read from.

Positions fall from the first pixel; V is the sum of I exp(2 pi i (u x + v y)).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .imaging import DATA, ROWS, Sums, Term, _pull

#: Largest grid, in cells a side: tasks hold three numbers of 8 bytes a cell.
MOST_CELLS = 4096


def pill(s: np.ndarray) -> np.ndarray:
    return (np.abs(s) < 0.5).astype(float)


def gauss(s: np.ndarray) -> np.ndarray:
    return np.exp(-(s**2))


def cubic(s: np.ndarray) -> np.ndarray:
    """The cubic convolution kernel of parameter -1/2."""
    s = np.abs(s)
    return np.where(s <= 1, (1.5 * s - 2.5) * s * s + 1, np.where(s < 2, ((-0.5 * s + 2.5) * s - 4) * s + 2, 0.0))


def kaiser(s: np.ndarray, width: int) -> np.ndarray:
    """The Kaiser-Bessel kernel that suits grids of twice the image."""
    beta = np.pi * np.sqrt((0.75 * width) ** 2 - 0.8)
    return np.i0(beta * np.sqrt(np.clip(1 - (2 * s / width) ** 2, 0, None))) / np.i0(beta) * (np.abs(2 * s) <= width)


KERNELS = {"pill": (pill, 1), "gauss": (gauss, 8), "cubic": (cubic, 4)}


@dataclass(frozen=True)
class Grid:
    """A grid for square images of ``n`` pixels of ``pixel`` radians, ``oversample`` times as wide, rounded up to a power of two.

    ``kernel`` is "kaiser" with ``width`` cells (an error of about 10 ** -(width - 1) of the flux; at most 14), "cubic", "gauss" or "pill".
    """

    n: int
    pixel: float
    oversample: float = 2.0
    kernel: str = "kaiser"
    width: int = 8

    @property
    def cells(self) -> int:
        size = 1 << max(3, int(np.ceil(np.log2(self.oversample * self.n))))
        if size > MOST_CELLS:
            raise ValueError(f"a grid of {size} cells a side is above {MOST_CELLS}")
        return size

    @property
    def reach(self) -> int:
        """Cells that a row meets along an axis."""
        return self.width if self.kernel == "kaiser" else KERNELS[self.kernel][1]

    def weight(self, s: np.ndarray) -> np.ndarray:
        return kaiser(s, self.width) if self.kernel == "kaiser" else KERNELS[self.kernel][0](s)

    def correction(self) -> np.ndarray:
        """One over the kernel's transform at each pixel of an axis."""
        # Gauss-Legendre on unit pieces: the kernels are smooth between whole and half numbers.
        at, w = np.polynomial.legendre.leggauss(16)
        pieces = np.arange(2 * self.reach) / 2 - self.reach / 2
        s, w = (pieces[:, None] + (at + 1) / 4).ravel(), np.tile(w / 4, len(pieces))
        m = np.arange(self.n) - self.n // 2
        return 1 / (np.cos(2 * np.pi * np.outer(m, s) / self.cells) @ (w * self.weight(s)))

    def places(self, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat cell, weight) of each row's cells, and the factor of a row that moves the middle to a whole pixel."""
        size, shift = self.cells, (self.n - 1) / 2 - self.n // 2
        index, weight, turn = [], [], np.zeros(len(u))
        for c in (v, u):
            t = c * (size * self.pixel)
            first = np.floor(t - self.reach / 2).astype(np.int64) + 1
            j = first[:, None] + np.arange(self.reach)
            index.append(j % size)
            weight.append(self.weight(t[:, None] - j))
            turn += t
        flat = (index[0][:, :, None] * size + index[1][:, None, :]).reshape(len(u), -1)
        return flat, (weight[0][:, :, None] * weight[1][:, None, :]).reshape(len(u), -1), np.exp(-2j * np.pi * turn * shift / size)

    def add(self, total: np.ndarray, u: np.ndarray, v: np.ndarray, q: np.ndarray) -> None:
        """Add rows of value q, for images sum q exp(-2 pi i (u x + v y)), to the flat complex grid ``total``."""
        flat, weight, factor = self.places(u, v)
        values = weight * (q * factor)[:, None]
        np.add.at(total.real, flat.ravel(), values.real.ravel())
        np.add.at(total.imag, flat.ravel(), values.imag.ravel())

    def image(self, total: np.ndarray) -> np.ndarray:
        """The complex image of an added-up grid."""
        size, m = self.cells, np.arange(self.n) - self.n // 2
        whole = np.fft.ifft2(total.reshape(size, size)) * size**2
        fix = self.correction()
        return whole[np.ix_(m % size, m % size)] * fix[:, None] * fix

    def transform(self, image: np.ndarray) -> np.ndarray:
        """The flat complex grid that ``read`` takes visibilities of ``image`` from."""
        size, m, fix = self.cells, np.arange(self.n) - self.n // 2, self.correction()
        whole = np.zeros((size, size), complex)
        whole[np.ix_(m % size, m % size)] = image * fix[:, None] * fix
        return np.fft.fft2(whole).ravel()

    def read(self, grid: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        flat, weight, factor = self.places(u, v)
        return (grid[flat] * weight).sum(1) * np.conj(factor)


def _touched(**grids: np.ndarray) -> pa.RecordBatch:
    """The cells of flat grids where any has a value."""
    at = np.flatnonzero(np.any([g != 0 for g in grids.values()], axis=0))
    return pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(np.ascontiguousarray(g[at])) for g in grids.values()]], ["at", *grids])


def cell_sums(vis: DataFrame, grid: Grid, weighting: str = "natural", data: str = "vis", sigma: str = "sigma") -> DataFrame:
    """cell_v, cell_u, re, im, weight: sums over the rows by cell (negative frequencies from the middle on).

    re and im sum w z, ``weight`` sums w, both times the kernel; w is 1 / sigma^2, or ("uniform") 1. Rows with nulls or without a
    positive sigma take no part; an empty table gives no rows.
    """
    size = grid.cells

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, weight = np.zeros(size * size, complex), np.zeros(size * size, complex)
        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            for a in range(0, batch.num_rows, ROWS):
                u, v, re, im, s = (c[a : a + ROWS] for c in cols)
                w = 1 / s**2 if weighting == "natural" else np.ones(len(s))
                grid.add(value, u, v, w * (re + 1j * im))
                flat, k, _ = grid.places(u, v)
                np.add.at(weight.real, flat.ravel(), (k * w[:, None]).ravel())
        yield _touched(re=value.real, im=value.imag, weight=weight.real)

    usable = vis.select("u", "v", f"{data}_re", f"{data}_im", sigma).dropna().filter(F.col(sigma) > 0)
    cells = usable.mapInArrow(run, "at long, re double, im double, weight double")
    sums = cells.groupBy("at").agg(*[F.sum(c).alias(c) for c in ("re", "im", "weight")])
    return sums.select(F.expr(f"int(at div {size})").alias("cell_v"), F.expr(f"int(at % {size})").alias("cell_u"), "re", "im", "weight")


def _grid_of(cells: DataFrame, size: int, *values: Column) -> list[np.ndarray]:
    """Flat grids of cell sums: at most size^2 rows come to the driver."""
    got = cells.select((F.col("cell_v") * size + F.col("cell_u")).alias("at"), *[v.alias(f"c{k}") for k, v in enumerate(values)]).toArrow()
    out = []
    for k in range(len(values)):
        whole = np.zeros(size * size)
        whole[got["at"].to_numpy()] = got[f"c{k}"].to_numpy()
        out.append(whole)
    return out


def dirty_image(vis: DataFrame, grid: Grid, weighting: str = "natural", data: str = "vis", sigma: str = "sigma") -> np.ndarray:
    """Mean over the visibilities of w Re(v exp(-2 pi i (u x + v y)))."""
    sums = cell_sums(vis, grid, weighting, data, sigma)
    re, im, weight = _grid_of(sums, grid.cells, F.col("re"), F.col("im"), F.col("weight"))
    # The kernel's weights of a row add up to its transform at 0 only on average, so the sum of w is read off the image of w.
    total = grid.image(weight.astype(complex))[grid.n // 2, grid.n // 2].real
    return grid.image(re + 1j * im).real / max(total, 1e-300)


def normal_sums(vis: DataFrame, n: int, pixel: float, weighting: str = "natural", data: str = "vis", sigma: str = "sigma", width: int = 10) -> Sums:
    """All that least squares asks of the visibilities, as ``imaging.normal_sums``, by one pass of rows times kernel cells."""
    wide = Grid(2 * n - 1, pixel, width=width)
    size = wide.cells

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dirty, spread, rest = np.zeros(size * size, complex), np.zeros(size * size, complex), np.zeros(3)
        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            for a in range(0, batch.num_rows, ROWS):
                u, v, re, im, s = (c[a : a + ROWS] for c in cols)
                w, z = 1 / s**2 if weighting == "natural" else np.ones(len(s)), re + 1j * im
                # Images of n pixels have their middle half a pixel away from that of 2 n - 1 if n is even.
                half = (n - 1) / 2 - (n - 1) // 2
                wide.add(dirty, u, v, w * z * np.exp(2j * np.pi * (u + v) * pixel * -half))
                wide.add(spread, u, v, w + 0j)
                rest += (w * np.abs(z) ** 2).sum(), w.sum(), len(u)
        yield _touched(re=np.append(dirty.real, rest), im=np.append(dirty.imag, [0, 0, 0]), weight=np.append(spread.real, [0, 0, 0]), turned=np.append(spread.imag, [0, 0, 0]))

    usable = vis.select("u", "v", f"{data}_re", f"{data}_im", sigma).dropna().filter(F.col(sigma) > 0)
    got = usable.mapInArrow(run, "at long, re double, im double, weight double, turned double").groupBy("at").agg(*[F.sum(c).alias(c) for c in ("re", "im", "weight", "turned")]).toArrow()
    whole = {}
    for c in ("re", "im", "weight", "turned"):
        whole[c] = np.zeros(size * size + 3)
        whole[c][got["at"].to_numpy()] = got[c].to_numpy()
    first = (2 * n - 1) // 2 - n // 2 if n % 2 else (2 * n - 1) // 2 - (n - 1) // 2
    dirty = wide.image(whole["re"][:-3] + 1j * whole["im"][:-3]).real[first : first + n, first : first + n]
    spread = wide.image(whole["weight"][:-3] + 1j * whole["turned"][:-3]).real
    power, weight, count = whole["re"][-3:]
    return Sums(dirty, spread, float(power), float(weight), int(count), pixel)


def model_visibilities(points: DataFrame, image: np.ndarray, grid: Grid, name: str = "vis") -> DataFrame:
    """Add the visibilities of ``image`` (n by n) at each row's u and v; null coordinates give nulls."""
    values = grid.transform(np.asarray(image, float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = (np.asarray(batch[c].to_numpy(zero_copy_only=False), float) for c in ("u", "v"))
            z = np.full(len(u), np.nan + 0j)
            for a in range(0, len(u), ROWS):
                known = a + np.flatnonzero(np.isfinite(u[a : a + ROWS] + v[a : a + ROWS]))
                z[known] = grid.read(values, u[known], v[known])
            missing = np.isnan(z)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(z.real, mask=missing), pa.array(z.imag, mask=missing)], [*batch.schema.names, f"{name}_re", f"{name}_im"])

    base = points.drop(f"{name}_re", f"{name}_im")
    return base.mapInArrow(run, StructType([*base.schema.fields, StructField(f"{name}_re", DoubleType()), StructField(f"{name}_im", DoubleType())]))


def data_term(table: DataFrame, kind: str, grid: Grid) -> Term:
    """The reduced chi-square of a table of ``kind`` and its gradient by the image, as ``imaging.data_term``, by grids.

    An evaluation is one job: tasks read model visibilities from the image's grid and add the misfits' pull up on one of their own.
    """
    columns, legs = DATA[kind]
    rows = table.select(*columns, *[c for leg in legs for c in leg]).dropna()
    size = grid.cells

    def term(image: np.ndarray) -> tuple[float, np.ndarray]:
        values = grid.transform(image)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, pull = np.zeros(2), np.zeros(size * size, complex)
            for batch in batches:
                cols = [batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in range(batch.num_columns)]
                for a in range(0, batch.num_rows, ROWS):
                    part = [c[a : a + ROWS] for c in cols]
                    data, uv = part[: len(columns)], part[len(columns) :]
                    misfit, q = _pull(kind, data, [grid.read(values, u, v) for u, v in zip(uv[::2], uv[1::2], strict=True)])
                    total += misfit.sum(), len(misfit)
                    for u, v, k in zip(uv[::2], uv[1::2], q, strict=True):
                        grid.add(pull, u, v, np.conj(k))
            yield _touched(re=np.append(pull.real, total), im=np.append(pull.imag, [0, 0]))

        got = rows.mapInArrow(run, "at long, re double, im double").groupBy("at").agg(F.sum("re").alias("re"), F.sum("im").alias("im")).toArrow()
        whole = np.zeros(size * size + 2, complex)
        whole[got["at"].to_numpy()] = got["re"].to_numpy() + 1j * got["im"].to_numpy()
        value, count = whole[-2:].real
        if not count:
            return 0.0, np.zeros((grid.n, grid.n))
        # Re(q dV) for dV = exp(2 pi i ..) is Re(conj(q) exp(-2 pi i ..)).
        return float(value / count), grid.image(whole[:-2]).real / count

    return term
