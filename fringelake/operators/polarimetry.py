"""Polarimetric quantities of Stokes and circular visibility tables, and noise and flags that depend on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import complexes as cx
from .visibility import BASELINE, DEGREE, debiased

STOKES = {"vis": "sigma", "qvis": "qsigma", "uvis": "usigma", "vvis": "vsigma"}
CIRCULAR = {"rrvis": "rrsigma", "llvis": "llsigma", "rlvis": "rlsigma", "lrvis": "lrsigma"}
FAMILIES = ("i", "q", "u", "v", "p", "m", "e", "b", "rr", "ll", "rl", "lr", "rrll")


def _norm(*sigmas: str, k: float = 1.0) -> Column:
    total = sum((F.col(s) * F.col(s) for s in sigmas[1:]), F.col(sigmas[0]) * F.col(sigmas[0]))
    return F.sqrt(total) * k


def _turned(q: cx.Pair, u: cx.Pair, q_sigma: Column, u_sigma: Column, part: str) -> tuple[cx.Pair, Column]:
    """E or B part, along and across the direction of (v, u)."""
    twice = 2 * F.atan2("u", "v")
    c, s = (F.cos(twice), F.sin(twice)) if part == "e" else (-F.sin(twice), F.cos(twice))
    return cx.add(cx.scale(q, c), cx.scale(u, s)), F.sqrt(0.5 * (c * q_sigma * c * q_sigma + s * u_sigma * s * u_sigma))


def quantity(family: str, polrep: str = "stokes") -> tuple[cx.Pair, Column]:
    """(complex value, sigma) of a family (``FAMILIES``)."""
    if polrep == "stokes":
        i, q, u, v = (cx.pair(n) for n in STOKES)
        if family in ("i", "q", "u", "v"):
            name = "vis" if family == "i" else f"{family}vis"
            return cx.pair(name), F.col(STOKES[name])
        p = cx.add(q, cx.times_i(u))
        if family in ("p", "rl"):
            return p, _norm("qsigma", "usigma")
        if family == "lr":
            return cx.sub(q, cx.times_i(u)), _norm("qsigma", "usigma")
        if family == "m":
            m = cx.div(p, i)
            return m, F.sqrt(F.col("qsigma") * F.col("qsigma") + F.col("usigma") * F.col("usigma") + F.col("sigma") * F.col("sigma") * (m[0] * m[0] + m[1] * m[1])) / F.nullif(cx.amplitude(i), F.lit(0.0))
        if family in ("e", "b"):
            return _turned(q, u, F.col("qsigma"), F.col("usigma"), family)
        right, left = cx.add(i, v), cx.sub(i, v)
        if family in ("rr", "ll"):
            return (right if family == "rr" else left), _norm("sigma", "vsigma")
        size = left[0] * left[0] + left[1] * left[1]
        power = i[0] * i[0] + i[1] * i[1] + v[0] * v[0] + v[1] * v[1]
        return cx.div(right, left), F.sqrt(2 * power) / F.nullif(size, F.lit(0.0)) * _norm("sigma", "vsigma")
    rr, ll, rl, lr = (cx.pair(n) for n in CIRCULAR)
    half = lambda z: cx.scale(z, F.lit(0.5))
    if family in ("rr", "ll", "rl", "lr"):
        return cx.pair(f"{family}vis"), F.col(f"{family}sigma")
    if family in ("i", "v"):
        return half(cx.add(rr, ll) if family == "i" else cx.sub(rr, ll)), _norm("rrsigma", "llsigma", k=0.5)
    q, u, cross = half(cx.add(rl, lr)), half(cx.times_i(cx.sub(lr, rl))), _norm("rlsigma", "lrsigma", k=0.5)
    if family in ("q", "u"):
        return (q if family == "q" else u), cross
    if family == "p":
        return rl, F.col("rlsigma")
    if family in ("e", "b"):
        return _turned(q, u, cross, cross, family)
    if family == "m":
        total = half(cx.add(rr, ll))
        m = cx.div(rl, total)
        hands = F.col("rrsigma") * F.col("rrsigma") + F.col("llsigma") * F.col("llsigma")
        return m, F.sqrt(F.col("rlsigma") * F.col("rlsigma") + hands * (m[0] * m[0] + m[1] * m[1])) / F.nullif(cx.amplitude(total), F.lit(0.0))
    left = F.nullif(cx.amplitude(ll), F.lit(0.0))
    one, two = F.col("rrsigma") / left, F.col("llsigma") * cx.amplitude(rr) / left
    return cx.div(rr, ll), F.sqrt(one * one + two * two)


def unpack(vis: DataFrame, family: str, polrep: str = "stokes", debias: bool = False, radians: bool = False) -> DataFrame:
    """The keys with re, im, amp, phase, snr, sigma and sigma_phase of a family."""
    value, sigma = quantity(family, polrep)
    unit = 1.0 if radians else DEGREE
    base = vis.select("time", *BASELINE, "u", "v", value[0].alias("re"), value[1].alias("im"), F.abs(sigma).alias("sigma"))
    a = cx.amplitude((F.col("re"), F.col("im")))
    return base.select(
        "time", *BASELINE, "re", "im", "sigma", (debiased(a, F.col("sigma")) if debias else a).alias("amp"), (F.atan2("im", "re") / unit).alias("phase"),
        (a / F.nullif(F.col("sigma"), F.lit(0.0))).alias("snr"), (F.col("sigma") / F.nullif(a, F.lit(0.0)) / unit).alias("sigma_phase"),
    )


def switch(vis: DataFrame, polrep: str, single_hand: str | None = None) -> DataFrame:
    """The table in the other representation ("stokes" or "circ"), errors included.

    From circular tables a missing parallel hand is replaced by the other as Stokes I; to circular ones a table of
    Stokes I only becomes that of ``single_hand`` ("R" or "L") if it is given.
    """
    source, target = (CIRCULAR, STOKES) if polrep == "stokes" else (STOKES, CIRCULAR)
    own = "circ" if polrep == "stokes" else "stokes"
    values = {n: quantity({"vis": "i"}.get(n, n.removesuffix("vis")), own) for n in target}
    if polrep == "stokes":
        (re, im), sigma = values["vis"]
        rr, ll = F.col("rrvis_re").isNull(), F.col("llvis_re").isNull()
        pick = lambda whole, right, left: F.when(rr, F.col(left)).when(ll, F.col(right)).otherwise(whole)
        values["vis"] = ((pick(re, "rrvis_re", "llvis_re"), pick(im, "rrvis_im", "llvis_im")), pick(sigma, "rrsigma", "llsigma"))
    elif single_hand:
        name, alone = f"{single_hand.lower() * 2}vis", F.col("vvis_re").isNull()
        (re, im), sigma = values[name]
        values[name] = ((F.when(alone, F.col("vis_re")).otherwise(re), F.when(alone, F.col("vis_im")).otherwise(im)), F.when(alone, F.col("sigma")).otherwise(sigma))
    rest = [c for c in vis.columns if c not in source.values() and c.rsplit("_", 1)[0] not in source]
    return vis.select(*rest, *[x.alias(f"{n}_{p}") for n, (z, _) in values.items() for p, x in zip(("re", "im"), z, strict=True)], *[s.alias(target[n]) for n, (_, s) in values.items()])


def rescale_noise(vis: DataFrame, factor: float) -> DataFrame:
    return vis.withColumns({s: F.col(s) * factor for s in (*STOKES.values(), *CIRCULAR.values()) if s in vis.columns})


def leakage_noise(vis: DataFrame, leakage: float, least: float, debias: bool = False) -> DataFrame:
    """Errors of a Stokes table grown by the noise that leakage of the cross hands makes, ``least`` of the amplitude at least."""
    size = {f: cx.amplitude(quantity(f)[0]) for f in ("i", "rl", "lr")}
    if debias:
        size = {f: debiased(a, quantity(f)[1]) for f, a in size.items()}
    one, two = (F.coalesce(leakage * size[f] / F.nullif(size["i"], F.lit(0.0)), F.lit(0.0)) for f in ("rl", "lr"))
    share = one * one + two * two
    share = F.when(share > least, share).when(share < least, F.lit(least)).otherwise(0.0) * size["i"]
    return vis.withColumn("_grow", share).withColumns({s: F.sqrt(F.col(s) * F.col(s) + F.col("_grow") * F.col("_grow")) for s in STOKES.values() if s in vis.columns}).drop("_grow")


def small_fraction(most: float, polrep: str = "stokes") -> Column:
    """Fractional polarisation below ``most``; a missing one counts as 0."""
    return F.coalesce(cx.amplitude(quantity("m", polrep)[0]), F.lit(0.0)) < most


def by_kernel(vis: DataFrame, kernel: Column) -> DataFrame:
    """Visibilities and errors divided by a real kernel (deblurring)."""
    names = [c for c in vis.columns if c.rsplit("_", 1)[0] in STOKES or c.rsplit("_", 1)[0] in CIRCULAR or c in STOKES.values() or c in CIRCULAR.values()]
    return vis.withColumn("_kernel", kernel).withColumns({c: F.col(c) / F.col("_kernel") for c in names}).drop("_kernel")


def reweight(vis: DataFrame, radius: float, weight: float = 1.0) -> DataFrame:
    """Errors by the local density of (u, v) points, conjugates included: the root of how many lie within ``radius``.

    Points meet by grid cells of the radius's size, so that only near ones are compared.
    """
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    points = vis.withColumn("_row", F.monotonically_increasing_id())
    both = points.select(F.explode(F.array(F.struct("u", "v"), F.struct((-F.col("u")).alias("u"), (-F.col("v")).alias("v")))).alias("p")).select(F.col("p.u").alias("_u"), F.col("p.v").alias("_v"))
    both = both.withColumns({"_cu": F.floor(F.col("_u") / radius).cast("long"), "_cv": F.floor(F.col("_v") / radius).cast("long")})
    steps = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    near = points.withColumn("_step", F.explode(steps)).withColumns({"_cu": cell("u") + F.col("_step.a"), "_cv": cell("v") + F.col("_step.b")}).drop("_step")
    found = near.join(both, ["_cu", "_cv"]).filter(F.pow(F.col("u") - F.col("_u"), 2) + F.pow(F.col("v") - F.col("_v"), 2) <= radius * radius)
    counted = found.groupBy("_row").agg(F.sqrt(F.count(F.lit(1))).alias("_density"))
    joined = points.join(counted, "_row")
    scale = joined.agg((F.avg("sigma") / F.avg("_density")).alias("_scale"))
    new = F.col("_density") * F.col("_scale") * weight + ((1 - weight) * F.col("sigma") if weight < 1 else F.lit(0.0))
    return joined.crossJoin(F.broadcast(scale)).withColumn("sigma", new).drop("_row", "_density", "_scale")
