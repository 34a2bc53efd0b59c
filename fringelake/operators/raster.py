"""Geometry and filters of images, one row an image with its pixels row by row.

The functions of arrays are plain numpy; ``each`` applies any of them to a column
of arrays, batch by batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType


def each(images: DataFrame, f: Callable[..., np.ndarray], nx: int, *args, column: str = "pix", **named) -> DataFrame:
    """Images with ``f(raster, ...)`` in place of ``column``; a row without pixels, or with a missing one, becomes NULL."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if p is None or not len(p) or pd.isna(p).any() else np.asarray(f(np.asarray(p, float).reshape(-1, nx), *args, **named), float).ravel() for p in batch], dtype=object)

    return images.withColumn(column, run(column))


def pad(image: np.ndarray, ny: int, nx: int, value: float = 0.0) -> np.ndarray:
    """In the middle of a larger raster; an odd pixel of room goes below and to the right."""
    h, w = image.shape
    if ny < h or nx < w:
        raise ValueError("the padded image must not be smaller")
    out = np.full((ny, nx), value)
    top, left = (ny - h) // 2, (nx - w) // 2
    out[top : top + h, left : left + w] = image
    return out


def shift(image: np.ndarray, down: int, right: int) -> np.ndarray:
    """Rolled by whole pixels."""
    return np.roll(image, (down, right), (0, 1))


def shift_fourier(image: np.ndarray, down: float, right: float) -> np.ndarray:
    """Rolled by any number of pixels, by phases; twice as large while it moves."""
    h, w = image.shape
    big = pad(image, 2 * h, 2 * w)
    turn = np.exp(-2j * np.pi * (np.fft.fftfreq(2 * h)[:, None] * down + np.fft.fftfreq(2 * w)[None, :] * right))
    moved = np.real(np.fft.ifft2(np.fft.fft2(big) * turn))
    return moved[(2 * h - h) // 2 : (2 * h - h) // 2 + h, (2 * w - w) // 2 : (2 * w - w) // 2 + w]


def centroid(image: np.ndarray) -> tuple[float, float]:
    """(down, right) of the flux's centre from the middle, in pixels."""
    h, w = image.shape
    total = image.sum()
    return float((image.sum(1) * (np.arange(h) - (h - 1) / 2)).sum() / total), float((image.sum(0) * (np.arange(w) - (w - 1) / 2)).sum() / total)


def centre(image: np.ndarray) -> np.ndarray:
    """Rolled so that the flux's centre is within half a pixel of the middle; no flux, no move."""
    if image.sum() == 0:
        return image
    down, right = centroid(image)
    return shift(image, -int(np.rint(down)), -int(np.rint(right)))


def _weights(old: int, new: int, ratio: float, kernel: str) -> np.ndarray:
    """Rows: weights of the old pixels in each new one, whose width is ``ratio`` old ones; both axes share their middle."""
    at = (np.arange(new) - (new - 1) / 2) * ratio + (old - 1) / 2
    d = np.abs(at[:, None] - np.arange(old)[None, :])
    if kernel == "nearest":
        return ((np.rint(at)[:, None] == np.arange(old)[None, :])).astype(float)
    if kernel == "linear":
        return np.maximum(1 - d, 0)
    if kernel == "cubic":
        return np.where(d <= 1, (1.5 * d - 2.5) * d * d + 1, np.where(d < 2, ((-0.5 * d + 2.5) * d - 4) * d + 2, 0.0))
    raise ValueError(kernel)


def regrid(image: np.ndarray, ny: int, nx: int, ratio: float, kernel: str = "cubic") -> np.ndarray:
    """Pixels ``ratio`` times as wide, interpolated at their middles (0 outside) and scaled by their area."""
    h, w = image.shape
    return ratio**2 * _weights(h, ny, ratio, kernel) @ image @ _weights(w, nx, ratio, kernel).T


def resample(image: np.ndarray, ny: int, nx: int, ratio: float) -> np.ndarray:
    """Pixels ``ratio`` times as wide, each with the flux of old (square) pixels that it covers."""

    def cover(old: int, new: int) -> np.ndarray:
        low = (np.arange(new) - new / 2) * ratio + old / 2
        edges = np.arange(old)
        return np.maximum(np.minimum(low[:, None] + ratio, edges[None, :] + 1) - np.maximum(low[:, None], edges[None, :]), 0)

    h, w = image.shape
    return cover(h, ny) @ image @ cover(w, nx).T


def rotate(image: np.ndarray, angle: float, kernel: str = "linear") -> np.ndarray:
    """Turned counter-clockwise by ``angle`` radians about the middle, interpolated, 0 outside."""
    h, w = image.shape
    y, x = np.mgrid[:h, :w].astype(float)
    y, x = y - (h - 1) / 2, x - (w - 1) / 2
    # The pixel at (x, y) comes from where the opposite turn brings it; y grows downwards.
    sx = x * np.cos(angle) - y * np.sin(angle) + (w - 1) / 2
    sy = x * np.sin(angle) + y * np.cos(angle) + (h - 1) / 2
    return sampled(image, sy, sx, kernel)


def sampled(image: np.ndarray, y: np.ndarray, x: np.ndarray, kernel: str = "linear") -> np.ndarray:
    """Values at fractional places, 0 outside."""
    big = np.pad(image, 2)
    ry, rx = (np.rint, np.rint) if kernel == "nearest" else (np.floor, np.floor)
    iy, ix = ry(y).astype(int), rx(x).astype(int)
    fy, fx = y - iy, x - ix
    put = lambda a, n: np.clip(a + 2, 0, n - 1)
    h, w = big.shape
    at = lambda a, b: big[put(iy + a, h), put(ix + b, w)]
    if kernel == "nearest":
        out = at(0, 0)
    else:
        out = (at(0, 0) * (1 - fx) + at(0, 1) * fx) * (1 - fy) + (at(1, 0) * (1 - fx) + at(1, 1) * fx) * fy
    inside = (y > -1) & (y < image.shape[0]) & (x > -1) & (x < image.shape[1])
    return np.where(inside, out, 0.0)


def convolve(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """By a kernel of the image's shape, whose middle is at (n - 1) // 2."""
    h, w = image.shape
    shape = (2 * h, 2 * w)
    full = np.fft.irfft2(np.fft.rfft2(image, shape) * np.fft.rfft2(kernel, shape), shape)
    return full[(h - 1) // 2 : (h - 1) // 2 + h, (w - 1) // 2 : (w - 1) // 2 + w]


def blur_gaussian(image: np.ndarray, major: float, minor: float, angle: float, share: float = 1.0) -> np.ndarray:
    """By an elliptic Gaussian of unit sum over the raster; widths in pixels, angle from up towards the left."""
    if share == 0:
        return image
    h, w = image.shape
    k = share / np.sqrt(8 * np.log(2))
    y, x = ((h - 1) // 2 - np.arange(h))[:, None], ((w - 1) // 2 - np.arange(w))[None, :]
    along, across = y * np.cos(angle) + x * np.sin(angle), x * np.cos(angle) - y * np.sin(angle)
    g = np.exp(-(along**2) / (2 * (major * k) ** 2) - across**2 / (2 * (minor * k) ** 2))
    return convolve(image, g / g.sum())


def blur_circular(image: np.ndarray, fwhm: float, filter: str = "gauss") -> np.ndarray:
    """By a round Gaussian, or by a second-order Butterworth low pass of this width; in pixels, zeros beyond the edge."""
    if fwhm <= 0:
        return image
    h, w = image.shape
    if filter == "gauss":
        sigma = fwhm / np.sqrt(8 * np.log(2))

        def band(n: int) -> np.ndarray:
            d = np.arange(n)[:, None] - np.arange(n)[None, :]
            reach = np.arange(-int(4 * sigma + 0.5), int(4 * sigma + 0.5) + 1)
            return np.where(np.abs(d) <= int(4 * sigma + 0.5), np.exp(-(d**2) / (2 * sigma**2)), 0) / np.exp(-(reach**2) / (2 * sigma**2)).sum()

        return band(h) @ image @ band(w).T
    f = np.hypot(np.fft.fftfreq(2 * h)[:, None], np.fft.rfftfreq(2 * w)[None, :])
    low = 1 / np.sqrt(1 + (f * fwhm) ** 4)
    return np.fft.irfft2(np.fft.rfft2(image, (2 * h, 2 * w)) * low, (2 * h, 2 * w))[:h, :w]


def gradient(image: np.ndarray, part: str = "abs") -> np.ndarray:
    """Sobel derivative down ("x"), to the right ("y"), or the length of both; edges repeat."""
    big = np.pad(image, 1, mode="edge")
    smooth = lambda a, axis: (a[:-2] + 2 * a[1:-1] + a[2:]) if axis == 0 else (a[:, :-2] + 2 * a[:, 1:-1] + a[:, 2:])
    down = smooth(big[2:] - big[:-2], 1)
    right = smooth(big[:, 2:] - big[:, :-2], 0)
    return {"x": down, "y": right}[part] if part != "abs" else np.hypot(down, right)


def _grid(ny: int, nx: int, pixel: float) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) of pixel middles, falling from the first."""
    return np.broadcast_arrays(((nx - 1) / 2 - np.arange(nx))[None, :] * pixel, ((ny - 1) / 2 - np.arange(ny))[:, None] * pixel)


def _scaled(values: np.ndarray, flux: float) -> np.ndarray:
    return values * (flux / values.sum()) if values.sum() else values


def flat(image: np.ndarray, flux: float) -> np.ndarray:
    return image + flux / image.size


def tophat(image: np.ndarray, pixel: float, flux: float, radius: float) -> np.ndarray:
    x, y = _grid(*image.shape, pixel)
    return image + _scaled((np.hypot(x, y) <= radius).astype(float), flux)


def gauss(image: np.ndarray, pixel: float, flux: float, major: float, minor: float, angle: float, x0: float = 0.0, y0: float = 0.0) -> np.ndarray:
    x, y = _grid(*image.shape, pixel)
    along, across = (y - y0) * np.cos(angle) + (x - x0) * np.sin(angle), (x - x0) * np.cos(angle) - (y - y0) * np.sin(angle)
    k = 4 * np.log(2)
    return image + _scaled(np.exp(-k * (along / major) ** 2 - k * (across / minor) ** 2), flux)


def crescent(image: np.ndarray, pixel: float, flux: float, outer: float, inner: float, a: float, b: float) -> np.ndarray:
    """A disk without the disk of radius ``inner`` around (a, b)."""
    x, y = _grid(*image.shape, pixel)
    return image + _scaled(((np.hypot(x, y) <= outer) & (np.hypot(x - a, y - b) > inner)).astype(float), flux)


def ring(image: np.ndarray, pixel: float, flux: float, radius: float, width: float, amplitude: float = 0.0, angle: float = 0.0) -> np.ndarray:
    """A ring of Gaussian profile, brighter towards ``angle`` by 1 + amplitude cos."""
    x, y = _grid(*image.shape, pixel)
    r, t = np.hypot(x, y), np.arctan2(x, y)
    return image + _scaled((1 + amplitude * np.cos(t - angle)) * np.exp(-4 * np.log(2) * ((r - radius) / width) ** 2), flux)


def correlate(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """At each circular shift, the product of the two images, each without its mean and over its deviation."""
    norm = lambda a: (a - a.mean()) / (a.std() or 1.0)
    return np.real(np.fft.ifft2(np.fft.fft2(norm(one)) * np.conj(np.fft.fft2(norm(two)))))


def find_shift(one: np.ndarray, two: np.ndarray) -> tuple[int, int, float]:
    """(down, right) by which ``two`` is rolled to meet ``one`` best, and their normalised correlation there."""
    c = correlate(one, two)
    down, right = np.unravel_index(np.argmax(c), c.shape)
    best = c[down, right] / c.size
    wrap = lambda k, n: int(k - n if k > n // 2 else k)
    return wrap(down, c.shape[0]), wrap(right, c.shape[1]), float(best)


def align(pairs: DataFrame, nx: int) -> DataFrame:
    """Rows of (pix, other) with other rolled to meet pix (aligned), the shift, and nxcorr, nrmse and rssd after it."""
    shape = StructType([StructField("aligned", ArrayType(DoubleType())), *(StructField(c, DoubleType()) for c in ("down", "right", "nxcorr", "nrmse", "rssd"))])

    @F.pandas_udf(shape)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in batches:
            rows = []
            for p, q in zip(a, b, strict=True):
                one, two = (np.asarray(z, float).reshape(-1, nx) for z in (p, q))
                down, right, best = find_shift(one, two)
                moved = shift(two, down, right)
                miss = ((one - moved) ** 2).sum()
                rows.append((moved.ravel(), float(down), float(right), best, float(np.sqrt(miss / (one**2).sum())), float(np.sqrt(miss))))
            yield pd.DataFrame(rows, columns=shape.names)

    return pairs.withColumn("_a", F.when(F.col("pix").isNotNull() & F.col("other").isNotNull(), F.lit(1))).filter("_a = 1").withColumn("_a", run("pix", "other")).select("*", "_a.*").drop("_a")


def ring_features(image: np.ndarray, pixel: float, rays: int = 90, steps: int = 200) -> np.ndarray:
    """diameter, its spread, width, its spread, angle, asymmetry, share of the floor within, and the centre (down, right).

    The centre is the pixel place, among those within a fifth of the raster from the middle, from which the radii of the rays'
    peaks spread least against their mean. Width is the full width at half the peak above the mean floor within the ring.
    """
    n = min(image.shape)
    angles, radii = np.arange(rays) * 2 * np.pi / rays, np.linspace(0, n / 2 - 1, steps)

    def profiles(cy: float, cx: float) -> np.ndarray:
        y = cy - np.outer(np.cos(angles), radii)
        x = cx - np.outer(np.sin(angles), radii)
        return sampled(image, y, x)

    my, mx = (image.shape[0] - 1) / 2, (image.shape[1] - 1) / 2
    reach = n / 5
    best = None
    for size in (reach, reach / 5, reach / 25):  # a coarse grid, then two finer ones around the best
        cy0, cx0 = best[1:] if best else (my, mx)
        for cy in cy0 + np.linspace(-size, size, 9):
            for cx in cx0 + np.linspace(-size, size, 9):
                peaks = radii[profiles(cy, cx).argmax(1)]
                spread = peaks.std() / max(peaks.mean(), 1.0)
                if best is None or spread < best[0]:
                    best = (spread, cy, cx)
    _, cy, cx = best
    p = profiles(cy, cx)
    peak_at = p.argmax(1)
    r = radii[peak_at]
    floor = p[:, radii < r.mean() / 5].mean() if (radii < r.mean() / 5).any() else 0.0
    sizes = []
    for row, k in zip(p, peak_at, strict=True):
        half = floor + (row[k] - floor) / 2
        low = np.nonzero(row[:k] < half)[0]
        high = np.nonzero(row[k:] < half)[0]
        if len(low) and len(high):
            a, b = low[-1], k + high[0]
            left = radii[a] + (half - row[a]) / (row[a + 1] - row[a]) * (radii[1] - radii[0])
            right = radii[b] - (half - row[b]) / (row[b - 1] - row[b]) * (radii[1] - radii[0])
            sizes.append(right - left)
    band = (radii > r.mean() / 2) & (radii < 1.5 * r.mean())
    around = p[:, band].sum(1)
    mode = (around * np.exp(1j * angles)).sum() / max(around.sum(), 1e-300)
    width = (float(np.mean(sizes)), float(np.std(sizes))) if sizes else (np.nan, np.nan)
    ringed = p.max(1).mean()
    return np.array([2 * r.mean() * pixel, 2 * r.std() * pixel, width[0] * pixel, width[1] * pixel, np.angle(mode) % (2 * np.pi), abs(mode), floor / ringed if ringed else np.nan, cy - my, cx - mx])


def spectral_index(images: DataFrame, group: str = "movie_id", reference: float = 1.0) -> DataFrame:
    """(group, i, log_flux, index): the straight line of log I against log(rf / reference) at each pixel; pixels not above 0 take no part."""
    p = images.select(group, "rf", F.posexplode("pix").alias("i", "value")).filter("value > 0 and rf > 0")
    x, y = F.log(F.col("rf") / reference), F.log(F.col("value").cast("double"))
    return p.groupBy(group, "i").agg(F.regr_intercept(y, x).alias("log_flux"), F.regr_slope(y, x).alias("index"))


def by_mean_brightness(images: DataFrame) -> DataFrame:
    """Pixels of each image in falling order of the mean image: (image_id, place, value), equal means by position."""
    from pyspark.sql import Window

    p = images.select("image_id", F.posexplode("pix").alias("i", "value")).withColumn("value", F.col("value").cast("double"))
    # One row a pixel place, whatever the number of images.
    order = p.groupBy("i").agg(F.avg("value").alias("_m")).withColumn("place", F.row_number().over(Window.orderBy(F.desc("_m"), "i")) - 1)
    return p.join(F.broadcast(order.select("i", "place")), "i").select("image_id", "place", "value")


def survey(spark, parameters: dict[str, list], run: Callable[[dict], dict], schema: str | StructType) -> DataFrame:
    """``run`` of every combination of the parameters, one row each: the combination and what it returns, by tasks."""
    import itertools

    names = list(parameters)
    total = int(np.prod([len(v) for v in parameters.values()])) if names else 0
    given = spark.createDataFrame(list(itertools.islice(itertools.product(*parameters.values()), 1)), names).schema if total else StructType([StructField(n, StringType()) for n in names])
    from pyspark.sql.types import _parse_datatype_string

    found = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    sizes = [len(parameters[n]) for n in names]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in batch["id"]:
                at, pick = int(k), {}
                for n, size in zip(reversed(names), reversed(sizes), strict=True):
                    at, j = divmod(at, size)
                    pick[n] = parameters[n][j]
                yield pd.DataFrame([{n: pick[n] for n in names} | run(pick)])

    return spark.range(0, total, 1, max(1, min(total, spark.sparkContext.defaultParallelism * 4))).mapInPandas(rows, StructType([*given.fields, *found.fields]))
