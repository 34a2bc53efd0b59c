"""Movies: rows (movie_id, frame, t, pix) in order of frame; and colours and polarisations of images."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def offset_time(frames: DataFrame, hours: float) -> DataFrame:
    return frames.withColumn("t", F.col("t") + hours)


def numbered(images: DataFrame, time: str = "mjd", movie: str = "") -> DataFrame:
    """Images as frames of a movie named ``movie``, in order of ``time`` (days become hours since the first frame's day began)."""
    w = Window.partitionBy("movie_id")
    day = F.floor(F.min(time).over(w))
    return images.withColumn("movie_id", F.lit(movie)).withColumns({"frame": F.row_number().over(w.orderBy(time)) - 1, "t": (F.col(time) - day) * 24.0})


def frame_between(frames: DataFrame, times: DataFrame, repeat: bool = False) -> DataFrame:
    """(movie_id, time, pix) of rows (movie_id, time): the frames before and after, blended in proportion.

    Outside a movie pix is NULL, or (``repeat``) its time goes around: the movie lasts from its first to its last frame. A movie of one
    frame shows it at that time only, or always if it repeats. Times meet frames in one pass ordered by time, no join by range.
    """
    ends = frames.groupBy("movie_id").agg(F.min("t").alias("_a"), F.max("t").alias("_b"))
    asked = times.select("movie_id", "time").join(ends, "movie_id")
    span = F.col("_b") - F.col("_a")
    where = F.when((F.col("time") >= F.col("_a")) & (F.col("time") <= F.col("_b")), F.col("time")).otherwise(F.when(span > 0, F.pmod(F.col("time") - F.col("_a"), span) + F.col("_a")).otherwise(F.col("_a"))) if repeat else F.col("time")
    shape = frames.schema["pix"].dataType
    line = frames.select("movie_id", F.col("t").alias("_t"), F.lit(None).cast("double").alias("time"), F.struct("t", "pix").alias("_f"))
    line = line.unionByName(asked.select("movie_id", where.alias("_t"), F.col("time"), F.lit(None).cast(line.schema["_f"].dataType).alias("_f")))
    w = Window.partitionBy("movie_id").orderBy("_t")
    line = line.withColumns({"_l": F.last("_f", True).over(w), "_h": F.first("_f", True).over(w.rangeBetween(0, Window.unboundedFollowing))}).filter("time is not null")
    share = F.when(F.col("_h.t") > F.col("_l.t"), (F.col("_t") - F.col("_l.t")) / (F.col("_h.t") - F.col("_l.t"))).otherwise(0.0)
    blend = F.zip_with("_l.pix", "_h.pix", lambda a, b: a + F.col("_s") * (b - a))
    return line.withColumn("_s", share).select("movie_id", "time", F.when(F.col("_l").isNotNull() & F.col("_h").isNotNull(), blend).alias("pix").cast(shape) if str(shape) != "ArrayType(DoubleType(), True)" else F.when(F.col("_l").isNotNull() & F.col("_h").isNotNull(), blend).alias("pix"))


def blur_time(frames: DataFrame, fwhm: float) -> DataFrame:
    """Each frame as the mean of its movie's frames by a Gaussian of their distance in frames, within four deviations.

    Frames are sent to their neighbours, so a movie of any length is dealt over tasks. ``frame`` counts without gaps.
    """
    sigma = fwhm / math.sqrt(8 * math.log(2))
    reach = int(4 * sigma + 0.5)
    step = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    sent = frames.select("movie_id", "frame", "pix", step.alias("_d")).withColumns({"_to": F.col("frame") + F.col("_d"), "_w": F.exp(-(F.col("_d") * F.col("_d")) / (2 * sigma**2))})
    sums = sent.select("movie_id", F.col("_to").alias("frame"), "_w", F.posexplode("pix").alias("_i", "_x")).groupBy("movie_id", "frame", "_i").agg((F.sum(F.col("_w") * F.col("_x")) / F.sum("_w")).alias("_v"))
    arrays = sums.groupBy("movie_id", "frame").agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_v"))), lambda s: s["_v"]).alias("pix"))
    return frames.drop("pix").join(arrays, ["movie_id", "frame"])


def mean_frame(frames: DataFrame) -> DataFrame:
    """(movie_id, pix): mean of the frames."""
    p = frames.select("movie_id", F.posexplode("pix").alias("i", "x")).groupBy("movie_id", "i").agg(F.avg("x").alias("x"))
    return p.groupBy("movie_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("pix"))


def circular_products(images: DataFrame) -> DataFrame:
    """Arrays i, q, u, v as rr, ll and the parts of rl = q + iu and lr = q - iu."""
    both = lambda a, b, f: F.zip_with(a, b, f)
    return images.withColumns({"rr": both("i", "v", lambda a, b: a + b), "ll": both("i", "v", lambda a, b: a - b), "rl_re": F.col("q"), "rl_im": F.col("u"), "lr_re": F.col("q"), "lr_im": F.transform("u", lambda x: -x)})


def stokes_products(images: DataFrame) -> DataFrame:
    """The arrays i, q, u, v from those."""
    half = lambda a, b, f: F.zip_with(a, b, f)
    return images.withColumns({"i": half("rr", "ll", lambda a, b: (a + b) / 2), "v": half("rr", "ll", lambda a, b: (a - b) / 2), "q": half("rl_re", "lr_re", lambda a, b: (a + b) / 2), "u": half("rl_im", "lr_im", lambda a, b: (a - b) / 2)})


def fractions(images: DataFrame) -> DataFrame:
    """Arrays m (linear fraction), chi (angle, radians) and vfrac of each pixel; NULL where i is 0."""
    s = F.arrays_zip("i", "q", "u", "v")
    over = lambda x, i: x / F.nullif(i, F.lit(0.0))
    return images.withColumns({"m": F.transform(s, lambda p: over(F.hypot(p["q"], p["u"]), p["i"])), "chi": F.transform(s, lambda p: F.atan2(p["u"], p["q"]) / 2), "vfrac": F.transform(s, lambda p: over(p["v"], p["i"]))})


def modes(q: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """E and B images: Q and U turned by twice the angle of each spatial frequency."""
    h, w = q.shape
    angle = np.arctan2(np.fft.fftfreq(w)[None, :], np.fft.fftfreq(h)[:, None])
    fq, fu = np.fft.fft2(q), np.fft.fft2(u)
    c, s = np.cos(2 * angle), np.sin(2 * angle)
    return np.real(np.fft.ifft2(c * fq + s * fu)), np.real(np.fft.ifft2(-s * fq + c * fu))


def at_frequency(images: DataFrame, frequency: float, reference: float) -> DataFrame:
    """pix at another frequency: times (f / reference) ** (alpha + beta ln(f / reference)), of arrays alpha and beta."""
    x = math.log(frequency / reference)
    power = F.zip_with("alpha", "beta", lambda a, b: F.exp(a * x + b * (x * x)))
    return images.withColumn("pix", F.zip_with("pix", power, lambda p, k: p * k))


def flux_at(images: DataFrame) -> Column:
    return F.aggregate("pix", F.lit(0.0), lambda a, b: a + b)


def screen(n: int, pixel: float, scale: float, inner: float, outer: float, index: float = 11 / 3, seed: int = 0) -> np.ndarray:
    """A random phase screen of n by n pixels with the power spectrum (q^2 + 1/outer^2)^(-index/2) exp(-(q inner)^2), whose
    phase differences over the distance ``scale`` have a mean square of 1."""
    rng = np.random.default_rng(seed)
    q = 2 * np.pi * np.hypot(*np.meshgrid(np.fft.fftfreq(n, pixel), np.fft.fftfreq(n, pixel)))
    power = (q**2 + outer**-2) ** (-index / 2) * np.exp(-((q * inner) ** 2))
    power[0, 0] = 0.0
    # The structure function of unit amplitude at the scale, to bring it to 1.
    kx = 2 * np.pi * np.fft.fftfreq(n, pixel)[None, :]
    power /= (2 * power * (1 - np.cos(kx * scale))).sum()
    noise = np.fft.fft2(rng.normal(size=(n, n))) / n
    return np.real(np.fft.ifft2(noise * np.sqrt(power))) * n * n


def scattered(image: np.ndarray, phase: np.ndarray, pixel: float, fresnel: float) -> np.ndarray:
    """The image seen through a screen: each pixel shows the place that the phase's gradient times ``fresnel`` squared moves it to."""
    from .raster import sampled

    down, right = (fresnel**2 * (np.roll(phase, -1, k) - np.roll(phase, 1, k)) / (2 * pixel) / pixel for k in (0, 1))
    y, x = np.mgrid[: image.shape[0], : image.shape[1]].astype(float)
    return sampled(image, y + down, x + right)
