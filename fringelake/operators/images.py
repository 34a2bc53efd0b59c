"""Images as array columns: totals, centroids, regularizers, light curves, comparisons."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pixels(images: DataFrame, side: int) -> DataFrame:
    """(image_id, ix, iy, value) of square images held row by row in ``pix``."""
    p = images.select("image_id", F.posexplode("pix").alias("i", "value"))
    return p.select("image_id", F.pmod("i", F.lit(side)).alias("ix"), F.floor(F.col("i") / side).cast("int").alias("iy"), F.col("value").cast("double").alias("value"))


def moments(images: DataFrame, side: int) -> DataFrame:
    """Total, centroid and peak of each image."""
    p = pixels(images, side)
    total = F.sum("value")
    return p.groupBy("image_id").agg(total.alias("flux"), (F.sum(F.col("value") * F.col("ix")) / F.nullif(total, F.lit(0.0))).alias("x"), (F.sum(F.col("value") * F.col("iy")) / F.nullif(total, F.lit(0.0))).alias("y"), F.max("value").alias("peak"))


def regularizers(images: DataFrame, side: int) -> DataFrame:
    """l1, squared total variation and entropy-like sums, without leaving the array."""
    at = lambda i: F.get("pix", i).cast("double")
    step = F.sequence(F.lit(0), F.lit(side * side - 1))
    right = F.transform(step, lambda i: F.when(F.pmod(i, F.lit(side)) < side - 1, at(i + 1) - at(i)).otherwise(0.0))
    down = F.transform(step, lambda i: F.when(i < side * (side - 1), at(i + side) - at(i)).otherwise(0.0))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return images.select("image_id", total(F.transform("pix", lambda x: F.abs(x.cast("double")))).alias("l1"), total(F.zip_with(right, down, lambda a, b: a * a + b * b)).alias("tv2"), total(F.zip_with(right, down, lambda a, b: F.sqrt(a * a + b * b))).alias("tv"))


def mean_image(images: DataFrame) -> DataFrame:
    return images.select(F.posexplode("pix").alias("i", "value")).groupBy("i").agg(F.avg(F.col("value").cast("double")).alias("value"))


def light_curve(frames: DataFrame) -> DataFrame:
    """(movie_id, frame, flux) of a movie's frames."""
    return frames.select("movie_id", "frame", F.aggregate("pix", F.lit(0.0), lambda s, x: s + x.cast("double")).alias("flux"))


def block_sums(images: DataFrame, side: int, n: int) -> DataFrame:
    return pixels(images, side).groupBy("image_id", F.floor(F.col("ix") / n).alias("bx"), F.floor(F.col("iy") / n).alias("by")).agg(F.sum("value").alias("value"))


def priors(images: DataFrame, side: int, flux: float, psize: float, beam: float | None = None, alpha: float = 1.0, normalised: bool = True) -> DataFrame:
    """The image terms of ``pix`` (positive, row by row) against the array ``prior``: each grows as the image becomes likelier.

    total flux, centre of mass, simple and Gull-Skilling entropy, l1, weighted l1, l_A, total variation and its square
    (zeros beyond the edge), patch, and two size terms.
    """
    beam, n = beam or psize, side
    step = F.sequence(F.lit(0), F.lit(n * n - 1))
    at = lambda i: F.get("pix", i).cast("double")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    each = lambda f: total(F.transform(step, lambda i: f(at(i), F.get("prior", i).cast("double"), F.pmod(i, F.lit(n)), F.floor(i / n), i)))
    right = lambda i: F.when(F.pmod(i, F.lit(n)) < n - 1, at(i + 1)).otherwise(0.0) - at(i)
    down = lambda i: F.when(i < n * (n - 1), at(i + n)).otherwise(0.0) - at(i)
    norm = lambda x: x if normalised else 1.0
    ep, half, middle = 1e-10, n // 2, (n - 1) / 2
    square = lambda x: x * x
    base = images.withColumns({"_sum": each(lambda x, p, ix, iy, i: x), "_x": each(lambda x, p, ix, iy, i: x * (ix - middle) * psize) / flux, "_y": each(lambda x, p, ix, iy, i: x * (iy - middle) * psize) / flux})
    weight0, weight1 = alpha, 1 / (1 + alpha)
    scale_a = (weight1 + (beam / psize) ** 2 * weight0) / (weight0 + weight1)
    pi = 3.141592653589793
    terms = {
        "flux": -square(F.col("_sum") - flux) / norm(flux**2),
        "cm": -(square(each(lambda x, p, ix, iy, i: x * psize * (half - ix))) + square(each(lambda x, p, ix, iy, i: x * psize * (half - iy)))) / norm(beam**2 * flux**2),
        "simple": -each(lambda x, p, ix, iy, i: x * F.log(x / p)) / norm(flux),
        "gs": each(lambda x, p, ix, iy, i: x - p - x * F.log(x / p)) / norm(flux),
        "l1": -each(lambda x, p, ix, iy, i: F.abs(x)) / norm(flux),
        "l1w": -each(lambda x, p, ix, iy, i: F.sqrt(x * x + ep) / (F.sqrt(p * p + ep) + ep)),
        "la": -each(lambda x, p, ix, iy, i: 2 / pi * (1 + alpha) / alpha * F.atan(pi * alpha / 2 * F.abs(x) / flux)) / norm(scale_a),
        "tv": -each(lambda x, p, ix, iy, i: F.sqrt(square(right(i)) + square(down(i)))) / norm(flux * psize / beam),
        "tv2": -each(lambda x, p, ix, iy, i: square(right(i)) + square(down(i))) / norm(psize**4 * flux**2 / beam**4),
        "patch": -0.5 * each(lambda x, p, ix, iy, i: square(x - p)) / norm(flux**2),
        "compact": -each(lambda x, p, ix, iy, i: x * (square((ix - middle) * psize - F.col("_x")) + square((iy - middle) * psize - F.col("_y")))) / norm(flux * beam**2),
        "compact2": -each(lambda x, p, ix, iy, i: x * x * (square((ix - middle) * psize) + square((iy - middle) * psize))) / norm(flux**2 * beam**2),
    }
    return base.select("image_id", *[c.alias(k) for k, c in terms.items()])


def threshold(images: DataFrame, share: float, fill: float | None = None) -> DataFrame:
    """Pixels not above ``share`` of the way from the image's least to its greatest value become ``fill``, or else that level."""
    low = F.array_min("pix").cast("double")
    level = low + share * (F.array_max("pix").cast("double") - low)
    rest = level if fill is None else F.lit(float(fill))
    return images.withColumn("pix", F.transform("pix", lambda x: F.when(x.cast("double") > level, x.cast("double")).otherwise(rest)))


def log_variation(images: DataFrame, side: int, flux: float, psize: float, beam: float | None = None, normalised: bool = True) -> DataFrame:
    """tvlog and tv2log: total variation, and its square, of the logarithm of positive images, over side^2 |log(flux / side^2)|."""
    size = side * side * abs(math.log(flux / side**2))
    logs = images.withColumns({"pix": F.transform("pix", lambda x: F.log(x.cast("double"))), "prior": F.col("pix")})
    return priors(logs, side, size, psize, beam, 1.0, normalised).select("image_id", F.col("tv").alias("tvlog"), F.col("tv2").alias("tv2log"))


def compare(images: DataFrame, others: DataFrame) -> DataFrame:
    """Normalised root mean square error and cross correlation of the images that share an id."""
    other = others.select("image_id", F.col("pix").alias("other"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    pair = lambda f: total(F.zip_with("pix", "other", lambda a, b: f(a.cast("double"), b.cast("double"))))
    joined = images.join(other, "image_id").withColumns({"_a": pair(lambda a, b: a) / F.size("pix"), "_b": pair(lambda a, b: b) / F.size("pix")})
    cross = pair(lambda a, b: (a - F.col("_a")) * (b - F.col("_b")))
    own, their = pair(lambda a, b: (a - F.col("_a")) * (a - F.col("_a"))), pair(lambda a, b: (b - F.col("_b")) * (b - F.col("_b")))
    return joined.select("image_id", F.sqrt(pair(lambda a, b: (a - b) * (a - b)) / pair(lambda a, b: a * a)).alias("nrmse"), (cross / F.sqrt(own * their)).alias("nxcorr"))


def polarised_curves(frames: DataFrame) -> DataFrame:
    """(movie_id, frame, flux, linear, circular): light curve and polarised shares of frames with arrays i, q, u, v."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double"))
    sums = frames.select("movie_id", "frame", *[total(c).alias(c) for c in "iquv"])
    return sums.select("movie_id", "frame", F.col("i").alias("flux"), (F.sqrt(F.col("q") * F.col("q") + F.col("u") * F.col("u")) / F.col("i")).alias("linear"), (F.col("v") / F.col("i")).alias("circular"))


def frame_at(frames: DataFrame, times: DataFrame) -> DataFrame:
    """The latest frame not after each time of its movie (the first before all), of frames (movie_id, t, image_id)."""
    first = frames.groupBy("movie_id").agg(F.min_by("image_id", "t").alias("_first"))
    w = Window.partitionBy("movie_id").orderBy("time", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = frames.select("movie_id", F.col("t").alias("time"), F.lit(0).alias("_kind"), "image_id").unionByName(times.select("movie_id", "time", F.lit(1).alias("_kind"), F.lit(None).cast(frames.schema["image_id"].dataType).alias("image_id")))
    found = both.withColumn("image_id", F.last("image_id", True).over(w)).filter("_kind = 1")
    return found.join(first, "movie_id").select("movie_id", "time", F.coalesce("image_id", "_first").alias("image_id"))
