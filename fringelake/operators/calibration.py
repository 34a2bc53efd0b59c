"""Solutions for station gains and leakages.

Each objective is a quadratic form of the visibilities of a baseline, so rows are
first summed by scan and baseline; a solver's group holds as many rows as a scan
has baselines, whatever the number of visibilities. Groups are solved in parallel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import complexes as cx
from ..functions.minimise import lbfgs

#: Default widths of the log-amplitude priors: gains above 1, gains up to 1.
TOLERANCE = (0.2, 0.5)
GAINS = "scan_id long, site string, g_re double, g_im double"


def _prior(g: np.ndarray, tolerance: tuple[float, float]) -> tuple[float, np.ndarray]:
    """Sum of (log |g| / tolerance)^2 and its gradient by conjugate g."""
    size = np.maximum(np.abs(g), 1e-12)
    t = np.where(size > 1, *tolerance)
    return float(np.sum((np.log(size) / t) ** 2)), np.log(size) / t**2 * g / size**2


def _solve(f, n: int, method: str) -> np.ndarray:
    """Gains of least ``f``, a value and gradient by conjugate gains; phases alone, amplitudes alone, or both."""
    if method == "phase":

        def real(x):
            g = np.exp(1j * x)
            value, d = f(g)
            return value, 2 * np.real(np.conj(d) * 1j * g)

        return np.exp(1j * lbfgs(real, np.zeros(n)))
    if method == "amp":

        def real(x):
            g = np.exp(x)
            value, d = f(g.astype(complex))
            return value, 2 * np.real(d) * g

        return np.exp(lbfgs(real, np.zeros(n))).astype(complex)

    def real(x):
        value, d = f(x[:n] + 1j * x[n:])
        return value, 2 * np.concatenate([d.real, d.imag])

    x = lbfgs(real, np.concatenate([np.ones(n), np.zeros(n)]))
    return x[:n] + 1j * x[n:]


def _sums(vis: DataFrame, data: cx.Pair, model: cx.Pair, sigma: Column, method: str) -> DataFrame:
    """Weighted sums of a scan and baseline: data by conjugate model, and model by itself."""
    w = 1 / (sigma * sigma)
    both = cx.mul(data, cx.conj(model))
    if method == "amp":
        both = cx.amplitude(data) * cx.amplitude(model), F.lit(0.0)
    usable = (w > 0) & ~F.isnan(w) & both[0].isNotNull() & both[1].isNotNull()
    return vis.filter(usable).groupBy("scan_id", "t1", "t2").agg(F.sum(w * both[0]).alias("b_re"), F.sum(w * both[1]).alias("b_im"), F.sum(w * (model[0] * model[0] + model[1] * model[1])).alias("c"))


def self_calibrate(vis: DataFrame, method: str = "both", tolerance: tuple[float, float] = TOLERANCE, sites: list[str] | None = None, data: str = "vis", model: str = "mod", sigma: str = "sigma") -> DataFrame:
    """(scan_id, site, g_re, g_im): least squares of data - g1 conj(g2) model over each scan, with log-amplitude priors.

    ``method`` is both, phase or amp. Sites outside ``sites`` (None: all are solved) keep gain 1. Rows lacking data, model or
    a positive sigma take no part; a scan without usable rows has no gains. Multiply by the inverse of g to calibrate.
    """
    sums = _sums(vis, cx.pair(data), cx.pair(model), F.col(sigma), method)

    def scan(rows: pd.DataFrame) -> pd.DataFrame:
        names = sorted(s for s in {*rows["t1"], *rows["t2"]} if sites is None or s in sites)
        if not names:
            return pd.DataFrame()
        place = {s: k for k, s in enumerate(names)}
        n = len(names)  # place n: the fixed gain of 1
        i, j = (rows[c].map(lambda s: place.get(s, n)).to_numpy() for c in ("t1", "t2"))
        b, c = rows["b_re"].to_numpy() + 1j * rows["b_im"].to_numpy(), rows["c"].to_numpy()

        def f(g):
            e = np.append(g, 1.0)
            one, two = e[i], e[j]
            value = np.sum(c * np.abs(one * two) ** 2 - 2 * np.real(np.conj(one) * two * b))
            d = np.zeros(n + 1, complex)
            np.add.at(d, i, c * np.abs(two) ** 2 * one - two * b)
            np.add.at(d, j, c * np.abs(one) ** 2 * two - one * np.conj(b))
            prior, more = _prior(g, tolerance)
            return value + prior, d[:n] + more

        g = _solve(f, n, method)
        return pd.DataFrame({"scan_id": rows["scan_id"].iloc[0], "site": names, "g_re": g.real, "g_im": g.imag})

    return sums.groupBy("scan_id").applyInPandas(scan, GAINS)


def hand_ratios(circ: DataFrame, tolerance: tuple[float, float] = TOLERANCE) -> DataFrame:
    """Gains of the right hand against the left, by scan and site, for a source without circular polarisation."""
    return self_calibrate(circ, "both", tolerance, data="rrvis", model="llvis", sigma="rrsigma")


def network_calibrate(vis: DataFrame, clusters: DataFrame, flux: float, method: str = "both", tolerance: tuple[float, float] = TOLERANCE) -> DataFrame:
    """(scan_id, site, g_re, g_im) from co-located sites: baselines between two places see one visibility, within one place ``flux``.

    ``clusters`` (site, cluster) has one row a site, few enough to broadcast; other sites are places of their own. Only sites of
    places with two or more sites present in the scan are solved. The visibility between two places is the least-squares one at every step.
    """
    if method not in ("both", "phase", "amp"):
        raise ValueError(method)
    small = F.broadcast(clusters.select("site", F.col("cluster").cast("string").alias("cluster")))
    one, two = (small.select(F.col("site").alias(f"t{k}"), F.col("cluster").alias(f"k{k}")) for k in (1, 2))
    placed = vis.join(one, "t1", "left").join(two, "t2", "left").withColumns({f"k{k}": F.coalesce(f"k{k}", F.concat(F.lit("site:"), f"t{k}")) for k in (1, 2)})
    # Turned so that the pair of places is in order.
    turn, z = F.col("k1") > F.col("k2"), cx.pair("vis")
    swap = lambda a, b: F.when(turn, F.col(b)).otherwise(F.col(a))
    size = cx.amplitude(z)
    placed = placed.select("scan_id", swap("t1", "t2").alias("t1"), swap("t2", "t1").alias("t2"), swap("k1", "k2").alias("k1"), swap("k2", "k1").alias("k2"), (size if method == "amp" else z[0]).alias("re"), (F.lit(0.0) if method == "amp" else F.when(turn, -z[1]).otherwise(z[1])).alias("im"), (1 / (F.col("sigma") * F.col("sigma"))).alias("w"), "time")
    # One visibility a time would not be the same over a scan: times stay apart within the group of a scan.
    sums = placed.filter((F.col("w") > 0) & ~F.isnan("w") & F.col("re").isNotNull() & F.col("im").isNotNull()).groupBy("scan_id", "time", "t1", "t2", "k1", "k2").agg(F.sum(F.col("w") * F.col("re")).alias("b_re"), F.sum(F.col("w") * F.col("im")).alias("b_im"), F.sum("w").alias("c"))

    def scan(rows: pd.DataFrame) -> pd.DataFrame:
        home = {**dict(zip(rows["t1"], rows["k1"], strict=True)), **dict(zip(rows["t2"], rows["k2"], strict=True))}
        crowd = pd.Series(home).value_counts()
        names = sorted(s for s, k in home.items() if crowd[k] > 1)
        place, n = {s: k for k, s in enumerate(names)}, len(names)
        i, j = (rows[c].map(lambda s: place.get(s, n)).to_numpy() for c in ("t1", "t2"))
        b, c = rows["b_re"].to_numpy() + 1j * rows["b_im"].to_numpy(), rows["c"].to_numpy()
        within = (rows["k1"] == rows["k2"]).to_numpy()
        pairs = rows.groupby(["time", "k1", "k2"], sort=False).ngroup().to_numpy()
        if not n:
            return pd.DataFrame()

        def f(g):
            e = np.append(g, 1.0)
            one, two = e[i], e[j]
            top = np.bincount(pairs, np.real(np.conj(one) * two * b)) + 1j * np.bincount(pairs, np.imag(np.conj(one) * two * b))
            v = np.where(within, flux, (top / np.maximum(np.bincount(pairs, c * np.abs(one * two) ** 2), 1e-300))[pairs])
            p, q = b * np.conj(v), c * np.abs(v) ** 2
            value = np.sum(q * np.abs(one * two) ** 2 - 2 * np.real(np.conj(one) * two * p))
            d = np.zeros(n + 1, complex)
            np.add.at(d, i, q * np.abs(two) ** 2 * one - two * p)
            np.add.at(d, j, q * np.abs(one) ** 2 * two - one * np.conj(p))
            prior, more = _prior(g, tolerance)
            return value + prior, d[:n] + more

        g = _solve(f, n, method)
        return pd.DataFrame({"scan_id": rows["scan_id"].iloc[0], "site": names, "g_re": g.real, "g_im": g.imag})

    return sums.groupBy("scan_id").applyInPandas(scan, GAINS)


def apply_scan_gains(vis: DataFrame, gains: DataFrame, data: str = "vis", sigma: str = "sigma") -> DataFrame:
    """Visibilities over g1 conj(g2) and their errors over its size; a site without a gain in the scan has 1."""
    out = vis
    for k in (1, 2):
        out = out.join(gains.select("scan_id", F.col("site").alias(f"t{k}"), F.col("g_re").alias(f"_g{k}_re"), F.col("g_im").alias(f"_g{k}_im")), ["scan_id", f"t{k}"], "left")
    one, two = ((F.coalesce(f"_g{k}_re", F.lit(1.0)), F.coalesce(f"_g{k}_im", F.lit(0.0))) for k in (1, 2))
    g = cx.mul(one, cx.conj(two))
    z = cx.div(cx.pair(data), g)
    return out.withColumns({f"{data}_re": z[0], f"{data}_im": z[1], sigma: F.col(sigma) / cx.amplitude(g)}).select(*vis.columns)


def invert_gains(gains: DataFrame) -> DataFrame:
    """1 / g of both hands of (site, time, r_re, r_im, l_re, l_im)."""
    columns = {}
    for hand in "rl":
        z = cx.div((F.lit(1.0), F.lit(0.0)), cx.pair(hand))
        columns |= {f"{hand}_re": z[0], f"{hand}_im": z[1]}
    return gains.withColumns(columns)


def raise_gains(gains: DataFrame, sites: list[str] | None = None, least: float = 0.75, by: str = "min") -> DataFrame:
    """Gains of each site divided by the least ("min"), mean or median size of both hands' gains, if that is below ``least``.

    Scaled to 1 then, and to ``least`` for "min".
    """
    if by not in ("min", "mean", "median"):
        raise ValueError(by)
    sizes = gains.select("site", F.explode(F.array(cx.amplitude(cx.pair("r")), cx.amplitude(cx.pair("l")))).alias("_size"))
    low = sizes.groupBy("site").agg({"min": F.min, "mean": F.avg, "median": F.median}[by]("_size").alias("_low"))
    goal = least if by == "min" else 1.0
    up = F.when(F.col("_low") < least, goal / F.nullif("_low", F.lit(0.0))).otherwise(1.0)
    if sites is not None:
        up = F.when(F.col("site").isin(*sites), up).otherwise(1.0)
    return gains.join(low, "site").withColumns({c: F.col(c) * up for c in ("r_re", "r_im", "l_re", "l_im")}).drop("_low")


def average_gains(gains: DataFrame, scans: DataFrame, incoherent: bool = False) -> DataFrame:
    """Mean gain of each site and scan, at its middle; incoherent means are of sizes. Scans do not overlap."""
    # The scan that began last at or before the knot: one range of a time-ordered union, no join by range.
    from pyspark.sql import Window

    names = ("r_re", "r_im", "l_re", "l_im")
    sites = gains.select("site").distinct()
    starts = sites.crossJoin(F.broadcast(scans.select("t_start", "t_stop"))).select("site", F.col("t_start").alias("time"), F.lit(0).alias("_k"), F.struct("t_start", "t_stop").alias("_s"), *[F.lit(None).cast("double").alias(c) for c in names])
    knots = gains.select("site", "time", F.lit(1).alias("_k"), F.lit(None).cast("struct<t_start:double,t_stop:double>").alias("_s"), *names)
    last = F.last("_s", True).over(Window.partitionBy("site").orderBy("time", "_k"))
    held = starts.unionByName(knots).withColumn("_s", last).filter((F.col("_k") == 1) & (F.col("time") <= F.col("_s.t_stop")))
    if incoherent:
        held = held.withColumns({"r_re": cx.amplitude(cx.pair("r")), "r_im": F.lit(0.0), "l_re": cx.amplitude(cx.pair("l")), "l_im": F.lit(0.0)})
    return held.groupBy("site", "_s").agg(*[F.avg(c).alias(c) for c in names]).select("site", ((F.col("_s.t_start") + F.col("_s.t_stop")) / 2).alias("time"), *names)


def pad_gains(gains: DataFrame, gap: float, value: str = "median", offset: float = 1e-4) -> DataFrame:
    """Knots of each run (no step above ``gap`` hours) with one more before and after: of the run's median, its end values, or 1.

    Medians are of each part; the added knots are half a gap away or, for runs of one knot, ``gap`` / 2 alike.
    """
    from pyspark.sql import Window

    names = ("r_re", "r_im", "l_re", "l_im")
    w = Window.partitionBy("site").orderBy("time")
    runs = gains.withColumn("_new", F.coalesce(F.col("time") - F.lag("time").over(w) > gap, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(w))
    ends = runs.groupBy("site", "_run").agg(F.min("time").alias("_a"), F.max("time").alias("_b"), *[F.median(c).alias(f"_m_{c}") for c in names], *[f(c, "time").alias(f"_{n}_{c}") for c in names for n, f in (("a", F.min_by), ("b", F.max_by))])
    one = {"r_re": 1.0, "r_im": 0.0, "l_re": 1.0, "l_im": 0.0}
    pick = lambda c, side: {"median": F.col(f"_m_{c}"), "endval": F.col(f"_{side}_{c}")}.get(value, F.lit(one[c]))
    more = [ends.select("site", time.alias("time"), *[pick(c, side).alias(c) for c in names]) for side, time in (("a", F.col("_a") - gap / 2 + offset), ("b", F.col("_b") + gap / 2 - offset))]
    return gains.select("site", "time", *names).unionByName(more[0]).unionByName(more[1])


def leakages(circ: DataFrame) -> DataFrame:
    """(site, dr_re, dr_im, dl_re, dl_im): first-order leakages from cross hands against their models.

    Columns modrr, modll, modrl, modlr hold the model; optional turn1 and turn2 (radians) the feed angles, which turn right-hand
    leakages by 2 i turn and left-hand ones by the reverse. rl = modrl + dr1 modll + conj(dl2) modrr and lr = modlr + dl1 modrr +
    conj(dr2) modll are solved by normal equations, which baselines' sums make up: their number is that of baselines.
    """
    turned = lambda z, k, sign: cx.mul(z, (F.cos(2 * F.col(f"turn{k}")), sign * F.sin(2 * F.col(f"turn{k}")))) if f"turn{k}" in circ.columns else z
    rr, ll = cx.pair("modrr"), cx.pair("modll")
    # Each equation: residual = x a + conj(y) b, with x of the first station and y of the second.
    parts = {"rl": (cx.sub(cx.pair("rlvis"), cx.pair("modrl")), turned(ll, 1, 1), turned(rr, 2, 1)), "lr": (cx.sub(cx.pair("lrvis"), cx.pair("modlr")), turned(rr, 1, -1), turned(ll, 2, -1))}
    found = []
    for name, (d, a, b) in parts.items():
        w = 1 / (F.col(f"{name}sigma") * F.col(f"{name}sigma"))
        terms = {"aa": (cx.mul(cx.conj(a), a)[0],), "bb": (cx.mul(cx.conj(b), b)[0],), "ab": cx.mul(cx.conj(a), b), "ad": cx.mul(cx.conj(a), d), "bd": cx.mul(cx.conj(b), d)}
        found += [F.sum(w * t).alias(f"{name}_{k}_{i}") for k, z in terms.items() for i, t in enumerate(z)]
    rows = circ.groupBy("t1", "t2").agg(*found).collect()
    sites = sorted({s for r in rows for s in (r["t1"], r["t2"])})
    place, n = {s: k for k, s in enumerate(sites)}, len(sites)
    matrix, right = np.zeros((4 * n, 4 * n)), np.zeros(4 * n)  # right hands, then left hands; real and imaginary parts
    for r in rows:
        for name, first, second in (("rl", 0, n), ("lr", n, 0)):
            if any(r[f"{name}_{k}"] is None for k in ("aa_0", "bb_0", "ad_0", "bd_0")):
                continue
            x, y = 2 * (place[r["t1"]] + first), 2 * (place[r["t2"]] + second)
            g = lambda k, name=name, r=r: complex(r[f"{name}_{k}_0"], r[f"{name}_{k}_1"])
            # x a + conj(y) b: conj(y) is (1, -1) times y's parts.
            block = np.zeros((4, 4))
            block[:2, :2], block[2:, 2:] = np.eye(2) * r[f"{name}_aa_0"], np.eye(2) * r[f"{name}_bb_0"]
            ab = g("ab")
            block[:2, 2:] = np.array([[ab.real, ab.imag], [ab.imag, -ab.real]])
            block[2:, :2] = block[:2, 2:].T
            at = np.array([x, x + 1, y, y + 1])
            matrix[np.ix_(at, at)] += block
            right[at] += [g("ad").real, g("ad").imag, g("bd").real, -g("bd").imag]
    solved = np.linalg.lstsq(matrix, right, rcond=1e-12)[0].reshape(2, n, 2) if n else np.zeros((2, 0, 2))
    out = [(s, *(float(v) for v in (*solved[0, k], *solved[1, k]))) for k, s in enumerate(sites)]
    return circ.sparkSession.createDataFrame(out, "site string, dr_re double, dr_im double, dl_re double, dl_im double")


def noise_fraction(vis: DataFrame, target: float = 1.0, most: float = 10.0, rounds: int = 6, grid: int = 32) -> float:
    """The fraction f of the amplitude that, added to sigma in quadrature, makes the mean of |vis - mod|^2 / (2 sigma^2) ``target``.

    Each round is one aggregation over a grid of fractions, which then narrows; 0 if none is needed, ``most`` if it is not enough.
    """
    d, z = cx.sub(cx.pair("vis"), cx.pair("mod")), cx.pair("vis")
    miss, size, var = d[0] * d[0] + d[1] * d[1], z[0] * z[0] + z[1] * z[1], F.col("sigma") * F.col("sigma")
    low, high = 0.0, most
    for _ in range(rounds):
        steps = np.linspace(low, high, grid)
        got = vis.agg(*[F.avg(miss / (2 * (var + float(f) ** 2 * size))).alias(f"c{k}") for k, f in enumerate(steps)]).first()
        if got[0] is None or got[0] <= target:
            return float(low)
        over = [k for k in range(grid) if got[k] > target]
        if over[-1] == grid - 1:
            return float(high)
        low, high = steps[over[-1]], steps[over[-1] + 1]
    return float((low + high) / 2)
