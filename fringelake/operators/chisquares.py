"""Reduced chi-squares of a visibility table against model visibilities (mod_re, mod_im) in its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import complexes as cx
from .closure import DEGREE, bispectra, closure_amplitudes

KEYS = ["time", "t1", "t2", "t3"]


def with_model(vis: DataFrame, model: cx.Pair) -> DataFrame:
    return vis.withColumns({"mod_re": model[0], "mod_im": model[1]})


def _mean(x: Column, per: float = 1.0) -> Column:
    return F.sum(x) / (per * F.count(F.lit(1)))


def visibilities(vis: DataFrame) -> DataFrame:
    d = cx.sub(cx.pair("vis"), cx.pair("mod"))
    return vis.agg(_mean((d[0] * d[0] + d[1] * d[1]) / (F.col("sigma") * F.col("sigma")), 2.0).alias("chisq"))


def amplitudes(vis: DataFrame, log: bool = False) -> DataFrame:
    a, m = cx.amplitude(cx.pair("vis")), cx.amplitude(cx.pair("mod"))
    d = (F.log(a) - F.log(m)) * a / F.col("sigma") if log else (a - m) / F.col("sigma")
    return vis.agg(_mean(d * d).alias("chisq"))


def _both(vis: DataFrame) -> DataFrame:
    """Bispectra of the data and, as m_re and m_im, of the model."""
    model = vis.withColumns({"vis_re": F.col("mod_re"), "vis_im": F.col("mod_im")})
    return bispectra(vis).join(bispectra(model).select(*KEYS, F.col("bispec_re").alias("m_re"), F.col("bispec_im").alias("m_im")), KEYS)


def bispectrum(vis: DataFrame) -> DataFrame:
    d = cx.sub(cx.pair("bispec"), cx.pair("m"))
    return _both(vis).agg(_mean((d[0] * d[0] + d[1] * d[1]) / (F.col("sigmab") * F.col("sigmab")), 2.0).alias("chisq"))


def closure_phase(vis: DataFrame) -> DataFrame:
    """Errors of phases are those of the bispectra over their amplitudes."""
    b = cx.pair("bispec")
    s = F.col("sigmab") / F.nullif(cx.amplitude(b), F.lit(0.0))
    return _both(vis).agg(_mean((1 - F.cos(cx.phase(b) - cx.phase(cx.pair("m")))) / (s * s), 0.5).alias("chisq"))


def closure_amplitude(vis: DataFrame, log: bool = False, count: str = "max", debias: bool = False) -> DataFrame:
    both = closure_amplitudes(vis, count, "logcamp" if log else "camp", debias, columns=("mod",))
    d = (F.col("camp") - F.col("mod")) / F.col("sigmaca")
    return both.agg(_mean(d * d).alias("chisq"))


def degrees(x: Column) -> Column:
    return x / DEGREE
