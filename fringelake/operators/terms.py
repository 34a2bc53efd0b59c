"""Terms of polarised, spectral and moving images, over rows of arrays; and chi-squares of polarised visibilities.

Each image term grows as the image becomes likelier; movie terms are penalties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import complexes as cx

#: Keeps logarithms of empty pixels finite.
EPSILON = 1e-10


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _steps(name: str, n: int, i: Column) -> tuple[Column, Column]:
    """Differences to the next pixel right and down in a raster of n columns and rows, zeros beyond the edge."""
    at = lambda k: F.get(name, k).cast("double")
    return F.when(F.pmod(i, F.lit(n)) < n - 1, at(i + 1)).otherwise(0.0) - at(i), F.when(i < n * (n - 1), at(i + n)).otherwise(0.0) - at(i)


def _variation(names: tuple[str, ...], n: int, squared: bool = False, soft: float = 0.0) -> Column:
    def one(i: Column) -> Column:
        total = F.lit(soft)
        for name in names:
            r, d = _steps(name, n, i)
            total = total + r * r + d * d
        return total if squared else F.sqrt(total)

    return _total(F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), one))


def polarised(images: DataFrame, n: int, flux: float, vflux: float, psize: float = 1.0, beam: float | None = None, normalised: bool = True) -> DataFrame:
    """Of arrays i, q, u and v: msimple, hw (fractional polarisation m = |q + iu| / i), ptv, vflux, l1v, l2v, vtv and vtv2.

    Pixels without I or polarisation have no logarithm: msimple is then NULL.
    """
    beam = beam or psize
    norm = lambda x: x if normalised else 1.0
    step = F.sequence(F.lit(0), F.lit(n * n - 1))
    at = lambda c, k: F.get(c, k).cast("double")
    m = lambda k: F.hypot(at("q", k), at("u", k)) / at("i", k)
    each = lambda f: _total(F.transform(step, f))
    xlogx = lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)
    terms = {
        "msimple": -each(lambda k: at("i", k) * F.log(m(k))) / norm(flux),
        "hw": -each(lambda k: at("i", k) * (xlogx((1 + m(k)) / 2) + xlogx((1 - m(k)) / 2))) / norm(flux),
        "ptv": -_variation(("q", "u"), n) / norm(flux * psize / beam),
        "vflux": -F.pow(each(lambda k: at("v", k)) - vflux, F.lit(2.0)) / norm(vflux**2),
        "l1v": -each(lambda k: F.abs(at("v", k))) / norm(abs(vflux)),
        "l2v": -each(lambda k: at("v", k) * at("v", k)) / norm(vflux**2),
        "vtv": -_variation(("v",), n) / norm(abs(vflux) * psize / beam),
        "vtv2": -_variation(("v",), n, squared=True) / norm(psize**4 * vflux**2 / beam**4),
    }
    return images.select("image_id", *[c.alias(k) for k, c in terms.items()])


def spectral(images: DataFrame, n: int, psize: float = 1.0, beam: float | None = None, normalised: bool = True) -> DataFrame:
    """Of an array ``pix`` of spectral values against ``prior``: l2 (mean squared distance) and tv, for each kind of map alike."""
    norm = lambda x: x if normalised else 1.0
    miss = _total(F.zip_with("pix", "prior", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)))
    return images.select("image_id", (-miss / norm(float(n * n))).alias("l2"), (-_variation(("pix",), n, soft=EPSILON) / norm(n * n * psize / (beam or psize))).alias("tv"))


def _distance(a: Column, b: Column, metric: str, p: float) -> Column:
    """Sum over pixels of the distance of two arrays."""
    if metric == "D":
        return _total(F.zip_with(a, b, lambda x, y: F.pow(F.abs(x.cast("double") - y.cast("double")), F.lit(p))))
    log = lambda x, y: F.log((x.cast("double") + EPSILON) / (y.cast("double") + EPSILON))
    if metric == "KL":
        return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * log(x, y)))
    if metric == "SymKL":
        return _total(F.zip_with(a, b, lambda x, y: 0.5 * (x.cast("double") - y.cast("double")) * log(x, y)))
    raise ValueError(metric)


def movie_steps(frames: DataFrame, metric: str = "SymKL", p: float = 2.0) -> DataFrame:
    """(movie_id, value): distances of each frame from the one before, added up, over the number of frames (one frame: 0).

    ``frames`` holds (movie_id, frame, pix), blurred beforehand if wanted.
    """
    before = F.lag("pix").over(Window.partitionBy("movie_id").orderBy("frame"))
    d = frames.withColumn("_b", before).select("movie_id", F.when(F.col("_b").isNotNull(), _distance(F.col("pix"), F.col("_b"), metric, p)).otherwise(0.0).alias("d"))
    return d.groupBy("movie_id").agg((F.sum("d") / F.count(F.lit(1))).alias("value"))


def movie_spread(frames: DataFrame, metric: str = "SymKL", p: float = 2.0) -> DataFrame:
    """(movie_id, value): mean distance of the frames from the movie's mean frame."""
    mean = frames.select("movie_id", F.posexplode("pix").alias("i", "x")).groupBy("movie_id", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    # One array a movie, as long as a frame.
    mean = mean.groupBy("movie_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("_m"))
    return frames.join(mean, "movie_id").groupBy("movie_id").agg(F.avg(_distance(F.col("pix"), F.col("_m"), metric, p)).alias("value"))


def movie_flux_steps(frames: DataFrame) -> DataFrame:
    """(movie_id, value): squared differences of consecutive frames' total flux, added up."""
    flux = frames.select("movie_id", "frame", _total(F.transform("pix", lambda x: x.cast("double"))).alias("f"))
    d = F.col("f") - F.lag("f").over(Window.partitionBy("movie_id").orderBy("frame"))
    return flux.select("movie_id", F.coalesce(d * d, F.lit(0.0)).alias("d")).groupBy("movie_id").agg(F.sum("d").alias("value"))


def chisq_polarised(vis: DataFrame, kind: str) -> DataFrame:
    """Reduced chi-square of pvis, m or vvis of a Stokes table against the models mod, modq, modu and modv."""
    if kind == "vvis":
        data, model, error = cx.pair("vvis"), cx.pair("modv"), F.col("vsigma")
    else:
        p = lambda q, u: cx.add(cx.pair(q), cx.times_i(cx.pair(u)))
        data, model = p("qvis", "uvis"), p("modq", "modu")
        error = F.sqrt(F.col("qsigma") * F.col("qsigma") + F.col("usigma") * F.col("usigma"))
        if kind == "m":
            i = cx.pair("vis")
            data, model = cx.div(data, i), cx.div(model, cx.pair("mod"))
            size, share = cx.amplitude(i), cx.amplitude(data)
            error = F.sqrt(error * error + F.col("sigma") * F.col("sigma") * share * share) / size
    d = cx.sub(data, model)
    return vis.agg((F.sum((d[0] * d[0] + d[1] * d[1]) / (error * error)) / (2 * F.count(F.lit(1)))).alias("chisq"))


def polarised_totals(images: DataFrame) -> DataFrame:
    """Of arrays i, q, u and v: flux, linear and circular fractions, angle (radians), and mean fractions weighted by i."""
    total = lambda f, *c: _total(F.transform(F.arrays_zip(*c), f))
    i, q, u, v = (_total(F.transform(c, lambda x: x.cast("double"))) for c in "iquv")
    linear = total(lambda s: F.hypot(s["q"].cast("double"), s["u"].cast("double")), "q", "u")
    circular = total(lambda s: F.abs(s["v"].cast("double")), "v")
    return images.select("image_id", i.alias("flux"), (F.hypot(q, u) / i).alias("linear"), (v / i).alias("circular"), (F.atan2(u, q) / 2).alias("angle"), (linear / i).alias("mean_linear"), (circular / i).alias("mean_circular"))


def azimuthal_modes(images: DataFrame, n: int, modes: list[int], low: float, high: float) -> DataFrame:
    """(image_id, m, re, im): sums of (q + iu) exp(-i m angle) over i, within ``low`` to ``high`` pixels of the middle.

    The angle goes from up towards the left.
    """
    p = images.select("image_id", F.posexplode(F.arrays_zip("i", "q", "u")).alias("k", "s"))
    x = (n - 1) / 2 - F.pmod("k", F.lit(n))
    y = (n - 1) / 2 - F.floor(F.col("k") / n)
    p = p.withColumns({"r": F.hypot(x, y), "t": F.atan2(x, y)}).filter(F.col("r").between(low, high))
    p = p.withColumn("m", F.explode(F.array(*[F.lit(m) for m in modes])))
    turn = -F.col("m") * F.col("t")
    z = cx.mul((F.col("s.q").cast("double"), F.col("s.u").cast("double")), (F.cos(turn), F.sin(turn)))
    i = F.nullif(F.sum(F.col("s.i").cast("double")), F.lit(0.0))
    return p.groupBy("image_id", "m").agg((F.sum(z[0]) / i).alias("re"), (F.sum(z[1]) / i).alias("im"))
