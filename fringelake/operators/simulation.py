"""Model visibilities: images by direct Fourier transform, Gaussians, scattering kernels, and thermal noise."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .geometry import DEGREE, LIGHT

#: Fixed values of the Sgr A* scattering ellipse: widths in microarcseconds at 1 cm, position angle in degrees.
SCATTER_MAJOR, SCATTER_MINOR, SCATTER_ANGLE = 1309.0, 640.0, 78.0
MICROARCSECOND = DEGREE / 3600.0 * 1e-6
#: Numbers of a batch's transform matrix at a time.
ENTRIES = 1 << 21


def image_visibilities(points: DataFrame, image: np.ndarray, pixel: float) -> DataFrame:
    """Add vis_re and vis_im: the sum over pixels of I exp(2 pi i (u x + v y)), x and y falling from the first pixel.

    The image (rows of pixels, ``pixel`` radians wide) is broadcast with the task; a batch is a matrix product.
    """
    image = np.asarray(image, float)
    ny, nx = image.shape
    x, y = (np.arange(0, -n, -1) * pixel + pixel * n / 2 - pixel / 2 for n in (nx, ny))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, ENTRIES // (nx + ny))
        for batch in batches:
            u, v = (batch[c].to_numpy(zero_copy_only=False) for c in ("u", "v"))
            parts = [np.zeros(0, complex)]
            for a in range(0, len(u), step):
                rows = np.exp(2j * np.pi * np.outer(v[a : a + step], y)) @ image
                parts.append((rows * np.exp(2j * np.pi * np.outer(u[a : a + step], x))).sum(axis=1))
            z = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(z.real), pa.array(z.imag)], [*batch.schema.names, "vis_re", "vis_im"])

    base = points.drop("vis_re", "vis_im")
    return base.mapInArrow(run, StructType([*base.schema.fields, StructField("vis_re", DoubleType()), StructField("vis_im", DoubleType())]))


def _ellipse(major: float, minor: float, angle: float) -> Column:
    """exp(-2 pi^2 uv' M uv) of a Gaussian of these widths (radians)."""
    k = 2 * math.sqrt(2 * math.log(2))
    one, two, turn = major / k, minor / k, -angle
    a = (two * math.cos(turn)) ** 2 + (one * math.sin(turn)) ** 2
    b = (one * math.cos(turn)) ** 2 + (two * math.sin(turn)) ** 2
    c = (two**2 - one**2) * math.cos(turn) * math.sin(turn)
    u, v = F.col("u"), F.col("v")
    return F.exp(-2 * math.pi**2 * (a * u * u + 2 * c * u * v + b * v * v))


def gaussian(flux: float, major: float, minor: float, angle: float, x: float = 0.0, y: float = 0.0) -> tuple[Column, Column]:
    """Visibility of an elliptic Gaussian at (x, y), all in radians."""
    size, turn = flux * _ellipse(major, minor, angle), -2 * math.pi * (F.col("u") * x + F.col("v") * y)
    return size * F.cos(turn), size * F.sin(turn)


def scattering(frequency: float) -> Column:
    """Kernel of the Sgr A* scattering ellipse."""
    wave = LIGHT / frequency * 100
    return _ellipse(SCATTER_MAJOR * wave**2 * MICROARCSECOND, SCATTER_MINOR * wave**2 * MICROARCSECOND, SCATTER_ANGLE * DEGREE)


def _uniform(part: str, seed: int) -> Column:
    """In (0, 1], by the row's keys: reruns and other partitions give the same."""
    return (F.pmod(F.xxhash64("time", "t1", "t2", F.lit(part), F.lit(seed)), F.lit(1 << 53)) + 1) / float(1 << 53)


def add_noise(vis: DataFrame, seed: int = 0) -> DataFrame:
    """Visibilities with Gaussian noise of their sigma in both parts (Box and Muller), fixed by keys and seed."""
    radius, turn = F.sqrt(-2 * F.log(_uniform("a", seed))) * F.col("sigma"), 2 * math.pi * _uniform("b", seed)
    return vis.withColumns({"vis_re": F.col("vis_re") + radius * F.cos(turn), "vis_im": F.col("vis_im") + radius * F.sin(turn)})
