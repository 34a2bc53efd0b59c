"""Derived fields, flags, noise and averages of a visibility table (time, t1, t2, u, v, vis_re, vis_im, sigma)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import complexes as cx
from . import intervals

DEGREE = 3.141592653589 / 180.0
BASELINE = ("t1", "t2")


def amp() -> Column:
    return cx.amplitude(cx.pair("vis"))


def snr() -> Column:
    return amp() / F.nullif(F.col("sigma"), F.lit(0.0))


def debiased(a: Column, s: Column, force: bool = False) -> Column:
    return F.when(a > s, F.sqrt(a * a - s * s)).otherwise(s if force else F.lit(0.0))


def unpack(vis: DataFrame, debias: bool = False) -> DataFrame:
    """amp, phase (degrees), snr, sigma_phase and uvdist beside the keys."""
    a = amp()
    return vis.select("time", "t1", "t2", "u", "v", (debiased(a, F.col("sigma")) if debias else a).alias("amp"), (cx.phase(cx.pair("vis")) / DEGREE).alias("phase"), snr().alias("snr"), (F.col("sigma") / F.nullif(a, F.lit(0.0)) / DEGREE).alias("sigma_phase"), F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v")).alias("uvdist"))


SWAPPED = {"t1": "t2", "t2": "t1", "tau1": "tau2", "tau2": "tau1", "rlvis_re": "lrvis_re", "rlvis_im": "lrvis_im", "lrvis_re": "rlvis_re", "lrvis_im": "rlvis_im", "rlsigma": "lrsigma", "lrsigma": "rlsigma"}


def conjugate_row(columns: list[str]) -> list[Column]:
    """The columns of the conjugate baseline; cross hands are exchanged."""
    return [(-F.col(SWAPPED.get(c, c)) if c in ("u", "v") or c.endswith("_im") else F.col(SWAPPED.get(c, c))).alias(c) for c in columns]


def conjugates(vis: DataFrame) -> DataFrame:
    """Each row and its conjugate, read once."""
    return vis.select(F.explode(F.array(F.struct(*vis.columns), F.struct(*conjugate_row(vis.columns)))).alias("x")).select("x.*")


def flag(vis: DataFrame, keep: Column, output: str = "kept") -> DataFrame:
    """Rows for which ``keep`` holds, the others ("flagged"), or all with a ``kept`` column ("both")."""
    keep = F.coalesce(keep, F.lit(False))
    return vis.withColumn("kept", keep) if output == "both" else vis.filter(keep if output == "kept" else ~keep)


def low_snr(cut: float) -> Column:
    return snr() > cut


def high_sigma(cut: float) -> Column:
    return F.col("sigma") < cut


def uvdist_between(low: float, high: float) -> Column:
    return F.hypot("u", "v").between(low, high)


def no_site(*sites: str) -> Column:
    return ~F.col("t1").isin(*sites) & ~F.col("t2").isin(*sites)


def not_baseline(*sites: str) -> Column:
    return ~(F.col("t1").isin(*sites) & F.col("t2").isin(*sites))


def outside_hours(start: float, stop: float) -> Column:
    """Edges are kept."""
    return (F.col("time") <= start) | (F.col("time") >= stop)


def flag_table(vis: DataFrame, flags: DataFrame) -> DataFrame:
    """Rows that no flag (start, stop, site) holds: strictly inside it and of its station, its baseline ("A-B", in any order) or, if it is null, any row.

    An equality join by block of hours; a block's flags are few beside its rows.
    """
    f = flags.select("start", "stop", F.col("site").alias("_site"))
    stations = F.array(F.col("t1"), F.col("t2"), F.concat_ws("-", "t1", "t2"), F.concat_ws("-", "t2", "t1"))
    held = (F.col("time") > F.col("start")) & (F.col("time") < F.col("stop")) & (F.col("_site").isNull() | F.array_contains(stations, F.col("_site")))
    return intervals.join_spans(vis, f, F.col("start"), F.col("stop"), held, "left_anti")


#: Columns of errors in tables of either kind.
SIGMAS = ("sigma", "qsigma", "usigma", "vsigma", "rrsigma", "llsigma", "rlsigma", "lrsigma")


def fractional_noise(vis: DataFrame, fraction: float, debias: bool = False) -> DataFrame:
    """All errors of the table grow by a share of the amplitude of Stokes I (debiased on request; of a circular table, of the mean of RR and LL)."""
    if "vis_re" in vis.columns:
        a, s = amp(), F.col("sigma")
    else:
        both = [F.coalesce((F.col(f"rrvis_{p}") + F.col(f"llvis_{p}")) / 2, F.col(f"rrvis_{p}"), F.col(f"llvis_{p}")) for p in ("re", "im")]
        a, s = cx.amplitude((both[0], both[1])), F.coalesce(F.sqrt(F.col("rrsigma") * F.col("rrsigma") + F.col("llsigma") * F.col("llsigma")) / 2, F.col("rrsigma"), F.col("llsigma"))
    a = debiased(a, s) if debias else a
    return vis.withColumns({c: F.sqrt(F.col(c) * F.col(c) + fraction * fraction * a * a) for c in SIGMAS if c in vis.columns})


def taper(vis: DataFrame, fwhm: float, reverse: bool = False) -> DataFrame:
    """Every product and error under (or, reversed, without) the transform of a round Gaussian."""
    size = fwhm / (2 * (2 * 0.6931471805599453) ** 0.5)
    kernel = F.exp(F.lit(-2 * 3.141592653589793**2 * size * size) * (F.col("u") * F.col("u") + F.col("v") * F.col("v")))
    names = [c for c in vis.columns if c in SIGMAS or c.endswith(("vis_re", "vis_im"))]
    return vis.withColumns({c: F.col(c) / kernel if reverse else F.col(c) * kernel for c in names})


def rescale_short(vis: DataFrame, flux: float, uv_max: float) -> DataFrame:
    """Scale the short baselines so that their inverse-variance mean amplitude is ``flux``."""
    short = F.hypot("u", "v") < uv_max
    mean = vis.filter(short).agg((F.sum(amp() / (F.col("sigma") * F.col("sigma"))) / F.sum(1 / (F.col("sigma") * F.col("sigma")))).alias("zbl"))
    k = F.when(short, F.lit(flux) / F.col("zbl")).otherwise(1.0)
    return vis.crossJoin(F.broadcast(mean)).withColumns({c: F.col(c) * k for c in ("vis_re", "vis_im", "sigma")}).drop("zbl")


def to_circular(vis: DataFrame) -> DataFrame:
    """RR, LL, RL, LR of a Stokes table (vis, qvis, uvis, vvis)."""
    i, q, u, v = (cx.pair(n) for n in ("vis", "qvis", "uvis", "vvis"))
    out = {"rrvis": cx.add(i, v), "llvis": cx.sub(i, v), "rlvis": cx.add(q, cx.times_i(u)), "lrvis": cx.sub(q, cx.times_i(u))}
    rest = [c for c in vis.columns if not c.startswith(("vis_", "qvis_", "uvis_", "vvis_"))]
    return vis.select(*rest, *[x.alias(f"{n}_{p}") for n, z in out.items() for p, x in zip(("re", "im"), z, strict=True)])


def to_stokes(vis: DataFrame) -> DataFrame:
    rr, ll, rl, lr = (cx.pair(n) for n in ("rrvis", "llvis", "rlvis", "lrvis"))
    half = lambda z: cx.scale(z, F.lit(0.5))
    out = {"vis": half(cx.add(rr, ll)), "qvis": half(cx.add(rl, lr)), "uvis": half(cx.times_i(cx.sub(lr, rl))), "vvis": half(cx.sub(rr, ll))}
    rest = [c for c in vis.columns if not c.startswith(("rrvis_", "llvis_", "rlvis_", "lrvis_"))]
    return vis.select(*rest, *[x.alias(f"{n}_{p}") for n, z in out.items() for p, x in zip(("re", "im"), z, strict=True)])


def coherent(vis: DataFrame, seconds: float) -> DataFrame:
    """Mean visibility of each baseline and bucket; the time is the bucket's centre."""
    bucket = F.floor(F.col("time") * 3600.0 / seconds)
    grouped = vis.groupBy(*BASELINE, bucket.alias("bucket")).agg(
        F.avg("vis_re").alias("vis_re"), F.avg("vis_im").alias("vis_im"), (F.sqrt(F.sum(F.col("sigma") * F.col("sigma"))) / F.count("sigma")).alias("sigma"),
        F.avg("u").alias("u"), F.avg("v").alias("v"), F.sum("tint").alias("tint"), F.count(F.lit(1)).alias("n"),
    )
    return grouped.withColumn("time", (F.col("bucket") + 0.5) * (seconds / 3600.0))


def coherent_by(tagged: DataFrame, group: str) -> DataFrame:
    """Mean visibility of each baseline and group (a scan); the time is the group's first."""
    return tagged.groupBy(*BASELINE, group).agg(F.avg("vis_re").alias("vis_re"), F.avg("vis_im").alias("vis_im"), (F.sqrt(F.sum(F.col("sigma") * F.col("sigma"))) / F.count("sigma")).alias("sigma"), F.min("time").alias("time"), F.sum("tint").alias("tint"), F.count(F.lit(1)).alias("n"))


def incoherent(vis: DataFrame, seconds: float, debias: bool = True) -> DataFrame:
    """Mean amplitude of each baseline and bucket with its error, and mean u and v where the table has them.

    Debiased (Rice) or not; of a single row that row's amplitude and error.
    """
    bucket, a, s = F.floor(F.col("time") * 3600.0 / seconds), amp(), F.col("sigma")
    uv = [F.avg(c).alias(c) for c in "uv" if c in vis.columns]
    g = vis.groupBy(*BASELINE, bucket.alias("bucket")).agg(F.avg(a * a).alias("p"), F.avg(s * s).alias("q"), F.avg(a).alias("r"), F.median("sigma").alias("m"), F.count(F.lit(1)).alias("n"), (F.sqrt(F.sum(s * s)) / F.count(F.lit(1))).alias("c"), F.max(a).alias("one"), *uv)
    names = [c for c in "uv" if c in vis.columns]
    if not debias:
        return g.select(*BASELINE, "bucket", "n", F.col("r").alias("amp"), F.col("c").alias("sigma"), *names)
    amp0 = F.when(F.col("n") == 1, F.col("one")).otherwise(F.sqrt(F.greatest(F.col("p") - (2.0 - 1.0 / F.col("n")) * F.col("q"), F.lit(0.0))))
    g = g.withColumn("amp", amp0)
    inv = F.col("m") / F.nullif(F.col("amp"), F.lit(0.0))
    snr_a = 1.0 / F.nullif(F.sqrt(1.0 + 2.0 / F.sqrt("n") * inv * F.sqrt(1.0 + inv * inv)) - 1.0, F.lit(0.0))
    return g.select(*BASELINE, "bucket", "n", "amp", F.when(F.col("n") == 1, F.col("m")).when(F.col("amp") > 0, F.col("amp") / snr_a).otherwise(F.col("c")).alias("sigma"), *names)


def scans(vis: DataFrame, gap: float, hours: float = 24.0) -> DataFrame:
    """(scan_id, t_start, t_stop, n_times): a new scan begins after more than ``gap`` hours.

    Distinct times are ordered within blocks of ``hours``; only a row a block meets a window over all.
    """
    times = vis.select("time").distinct().withColumn("_block", F.floor(F.col("time") / hours))
    w, over = Window.partitionBy("_block").orderBy("time"), Window.orderBy("_block")
    ends = times.groupBy("_block").agg(F.max("time").alias("_end")).withColumn("_before", F.lag("_end").over(over)).drop("_end")
    gaps = times.join(ends, "_block").withColumn("_new", F.coalesce(F.col("time") - F.coalesce(F.lag("time").over(w), F.col("_before")) > gap, F.lit(False)).cast("long"))
    base = gaps.groupBy("_block").agg(F.sum("_new").alias("_n")).select("_block", (F.sum("_n").over(over) - F.col("_n")).alias("_base"))
    numbered = gaps.withColumn("_k", F.sum("_new").over(w)).join(base, "_block").select("time", (F.col("_base") + F.col("_k")).alias("scan_id"))
    return numbered.groupBy("scan_id").agg(F.min("time").alias("t_start"), F.max("time").alias("t_stop"), F.count(F.lit(1)).alias("n_times"))


def in_scans(vis: DataFrame, scan_table: DataFrame, margin: float = 1e-5) -> DataFrame:
    """Rows with the scan whose interval (start - margin, stop + margin], in hours, holds their time."""
    low, high = F.col("t_start") - margin, F.col("t_stop") + margin
    return intervals.join_spans(vis, scan_table, low, high, (F.col("time") > low) & (F.col("time") <= high))


def subscan_dropouts(tagged: DataFrame, share: float) -> DataFrame:
    """Drop baselines with few rows in a scan, then times that lack a remaining baseline of their scan."""
    scan = Window.partitionBy("scan_id")
    counts = tagged.groupBy("scan_id", *BASELINE).agg(F.count(F.lit(1)).alias("_n"))
    good = counts.withColumn("_typical", F.median("_n").over(scan)).filter(F.col("_n") >= share * F.col("_typical"))
    good = good.select("scan_id", *BASELINE, F.count(F.lit(1)).over(scan).alias("_expected"))
    seen = F.count(F.lit(1)).over(Window.partitionBy("scan_id", "time"))
    return tagged.join(good, ["scan_id", *BASELINE]).withColumn("_seen", seen).filter("_seen = _expected").select("scan_id", "time", *[c for c in tagged.columns if c not in ("scan_id", "time")])


def moving(vis: DataFrame, seconds: int) -> DataFrame:
    """Rolling mean over (t - dt, t] of each baseline, its time the middle of the window."""
    micro = F.round(F.col("time") * 3.6e9).cast("long")
    w = Window.partitionBy(*BASELINE).orderBy("_us").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    s2 = F.col("sigma") * F.col("sigma")
    return vis.withColumn("_us", micro).select((F.col("time") - seconds / 7200.0).alias("time"), *BASELINE, F.avg("vis_re").over(w).alias("vis_re"), F.avg("vis_im").over(w).alias("vis_im"), (F.avg(s2).over(w) / F.sqrt(F.sum(s2).over(w))).alias("sigma"), F.count(F.lit(1)).over(w).alias("n"))


def anomalies(vis: DataFrame, seconds: int, nsigma: float) -> DataFrame:
    """Keep rows within ``nsigma`` median absolute deviations of the rolling median amplitude (both exact)."""
    w = Window.partitionBy(*BASELINE).orderBy("_us").rangeBetween(-(seconds * 1_000_000 - 1), seconds * 1_000_000 - 1)

    def middle(x: Column) -> Column:
        x, n = F.array_sort(x), F.size(x)
        return (F.get(x, F.floor((n - 1) / 2).cast("int")) + F.get(x, F.floor(n / 2).cast("int"))) / 2

    near = vis.withColumn("_us", F.round(F.col("time") * 3.6e9).cast("long")).withColumn("amp", amp()).withColumn("_near", F.collect_list("amp").over(w))
    near = near.withColumn("median", middle(F.col("_near")))
    near = near.withColumn("mad", middle(F.transform("_near", lambda x: F.abs(x - F.col("median")))))
    kept = F.abs(F.col("amp") - F.col("median")) / F.when(F.col("mad") == 0, 1.0).otherwise(F.col("mad")) < nsigma
    return near.filter(kept).drop("_us", "_near")


def common_times(a: DataFrame, b: DataFrame, tolerance: float) -> DataFrame:
    """Rows of ``a`` whose time and baseline, to ``tolerance`` hours, ``b`` has too."""
    key = lambda d: d.select(F.rint(F.col("time") / tolerance).alias("_k"), F.least("t1", "t2").alias("_a"), F.greatest("t1", "t2").alias("_b"))
    left = a.withColumns({"_k": F.rint(F.col("time") / tolerance), "_a": F.least("t1", "t2"), "_b": F.greatest("t1", "t2")})
    return left.join(key(b).distinct(), ["_k", "_a", "_b"], "left_semi").drop("_k", "_a", "_b")


def _factors(vis: DataFrame, gains: DataFrame, parts: tuple[str, ...], method: str, extrapolate: bool) -> DataFrame:
    """_1<part> and _2<part>: the gains of a row's two stations, 1 for those without a curve."""
    one = {c: float(c.endswith("_re")) for c in parts}
    for k in "12":
        own = gains.select(F.col("site").alias("_site"), "time", *[F.col(c).alias(f"_{k}{c}") for c in parts])
        vis = intervals.at_curve(vis.withColumn("_site", F.col(f"t{k}")), own, "_site", tuple(f"_{k}{c}" for c in parts), method, extrapolate, {f"_{k}{c}": x for c, x in one.items()}).drop("_site")
    return vis


def apply_gains(vis: DataFrame, gains: DataFrame, method: str = "linear", extrapolate: bool = False) -> DataFrame:
    """Multiply by g1 conj(g2), gains (site, time, g_re, g_im) interpolated ("linear", "cubic", or "nearest", the earlier of equals).

    A station without a curve has gain 1, one with a single knot that gain at all times; NULL outside a longer curve unless the
    end segments go on (``extrapolate``).
    """
    joined = _factors(vis, gains, ("g_re", "g_im"), method, extrapolate)
    g = cx.mul(cx.pair("_1g"), cx.conj(cx.pair("_2g")))
    out = cx.mul(cx.pair("vis"), g)
    return joined.withColumns({"vis_re": out[0], "vis_im": out[1], "sigma": F.col("sigma") * cx.amplitude(g)}).select(*vis.columns)


def apply_hands(vis: DataFrame, gains: DataFrame, method: str = "linear", extrapolate: bool = False, force: str | None = None) -> DataFrame:
    """Multiply the products of a circular table by the gains (site, time, r_re, r_im, l_re, l_im) of both hands, as ``apply_gains`` does.

    ``force`` ("R" or "L") takes that hand's gains for both.
    """
    joined = _factors(vis, gains, ("r_re", "r_im", "l_re", "l_im"), method, extrapolate)
    hand = lambda k, h: cx.pair(f"_{k}{(force or h).lower()}")
    columns = {}
    for a in "rl":
        for b in "rl":
            g = cx.mul(hand(1, a), cx.conj(hand(2, b)))
            z = cx.mul(cx.pair(f"{a}{b}vis"), g)
            columns |= {f"{a}{b}vis_re": z[0], f"{a}{b}vis_im": z[1], f"{a}{b}sigma": F.col(f"{a}{b}sigma") * cx.amplitude(g)}
    return joined.withColumns(columns).select(*vis.columns)


def merge_gains(first: DataFrame, second: DataFrame, method: str = "linear") -> DataFrame:
    """Products of two gain tables (site, time, g_re, g_im) at the times of both; a table has gain 1 outside its knots and for absent sites."""
    times = first.select("site", "time").union(second.select("site", "time")).distinct()
    for n, gains in enumerate((first, second)):
        one = {f"_{n}_re": 1.0, f"_{n}_im": 0.0}
        times = intervals.at_curve(times, gains.select("site", "time", F.col("g_re").alias(f"_{n}_re"), F.col("g_im").alias(f"_{n}_im")), "site", (f"_{n}_re", f"_{n}_im"), method, False, one, one)
    g = cx.mul(cx.pair("_0"), cx.pair("_1"))
    return times.select("site", "time", g[0].alias("g_re"), g[1].alias("g_im"))


def outside_hours_of(start: float, stop: float, *sites: str) -> Column:
    """False for rows between the hours whose stations include all of ``sites`` (one: a station, two: a baseline)."""
    named = F.lit(True)
    for site in sites:
        named = named & F.lit(site).isin(F.col("t1"), F.col("t2"))
    return ~(F.col("time").between(start, stop) & named)


def station_order(vis: DataFrame) -> DataFrame:
    """(site, snr, ord) by falling median signal to noise over the rows of each station, equal ones by name."""
    ends = vis.select(F.explode(F.array("t1", "t2")).alias("site"), snr().alias("s"))
    return ends.groupBy("site").agg(F.median("s").alias("snr")).withColumn("ord", F.row_number().over(Window.orderBy(F.desc("snr"), "site")))


def merge_intervals(scan_table: DataFrame, widen: float = 1e-5) -> DataFrame:
    """(label, t_start, t_stop): overlapping or touching intervals as one, widened, counted from 1; an end before its start is a day later."""
    stop = F.when(F.col("t_stop") < F.col("t_start"), F.col("t_stop") + 24.0).otherwise(F.col("t_stop"))
    w = Window.orderBy("t_start", "t_stop")
    runs = scan_table.select("t_start", stop.alias("t_stop")).withColumn("_before", F.max("t_stop").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    runs = runs.withColumn("label", F.sum(F.when(F.col("t_start") <= F.col("_before"), 0).otherwise(1)).over(w))
    return runs.groupBy("label").agg((F.min("t_start") - widen).alias("t_start"), (F.max("t_stop") + widen).alias("t_stop"))


def gaussian_model(flux: float, fwhm: float) -> Column:
    """Visibility (real) of a round Gaussian at the phase centre."""
    size = fwhm / (2 * (2 * 0.6931471805599453) ** 0.5)
    return F.lit(flux) * F.exp(F.lit(-2 * 3.141592653589793**2 * size * size) * (F.col("u") * F.col("u") + F.col("v") * F.col("v")))


def chisq(vis: DataFrame, model: Column) -> DataFrame:
    """Reduced chi-squares of visibilities and amplitudes against a real model."""
    s2 = F.col("sigma") * F.col("sigma")
    d = (F.col("vis_re") - model) * (F.col("vis_re") - model) + F.col("vis_im") * F.col("vis_im")
    a = amp() - F.abs(model)
    return vis.agg((F.sum(d / s2) / (2 * F.count(F.lit(1)))).alias("chisq_vis"), (F.sum(a * a / s2) / F.count(F.lit(1))).alias("chisq_amp"))


def dirty_beam(vis: DataFrame, npix: int, fov: float) -> DataFrame:
    """(ix, iy, value): mean of cos over the visibilities; each task adds up its own pixels first."""
    size = fov / npix
    axis = (np.arange(npix) - (npix - 1) / 2) * size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((npix, npix)), 0
        for batch in batches:
            u, v = (batch[c].to_numpy(zero_copy_only=False) for c in ("u", "v"))
            x, y = (2 * np.pi * np.outer(axis, c) for c in (u, v))
            total += np.cos(x) @ np.cos(y).T - np.sin(x) @ np.sin(y).T
            n += len(u)
        ix, iy = (g.ravel() for g in np.meshgrid(np.arange(npix), np.arange(npix), indexing="ij"))
        yield pa.RecordBatch.from_arrays([pa.array(ix.astype(np.int32)), pa.array(iy.astype(np.int32)), pa.array(total.ravel()), pa.array(np.full(npix * npix, n))], ["ix", "iy", "total", "n"])

    sums = vis.select("u", "v").mapInArrow(run, "ix int, iy int, total double, n long")
    return sums.groupBy("ix", "iy").agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("value"))


def beam_moments(vis: DataFrame) -> DataFrame:
    return vis.agg((1.0 / F.max(F.hypot("u", "v"))).alias("res"), F.avg(F.col("u") * F.col("u")).alias("uu"), F.avg(F.col("v") * F.col("v")).alias("vv"), F.avg(2.0 * F.col("u") * F.col("v")).alias("uv2"))


def systematic_noise(vis: DataFrame, level: float | dict[str, float], snr: float = 0.0) -> DataFrame:
    """Rows of at least ``snr``, sigma grown by a share of the amplitude: of each station's own level, or of one level for all.

    The levels of both stations add in squares; a station that ``level`` does not name has 0, and rows of a station of negative level go.
    """
    amp = cx.amplitude(cx.pair("vis"))
    if isinstance(level, dict):
        of = lambda t: F.coalesce(*[F.when(F.col(t) == s, float(x)) for s, x in level.items()], F.lit(0.0))
        one, two = of("t1"), of("t2")
    else:
        one = two = F.lit(float(level))
    kept = vis.filter((amp / F.col("sigma") >= snr) & (one >= 0) & (two >= 0))
    share = F.sqrt(one * one + two * two)
    return kept.withColumn("sigma", F.hypot(F.col("sigma"), share * amp))
