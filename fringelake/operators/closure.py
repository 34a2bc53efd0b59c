"""Closure quantities: triangles and quadrangles of baselines at one time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import complexes as cx

DEGREE = 3.141592653589 / 180.0


#: Coordinates of the legs of triangles and quadrangles, where the visibilities have them.
LEGS = ("u1", "v1", "u2", "v2", "u3", "v3", "u4", "v4")


def _has_uv(vis: DataFrame) -> bool:
    return {"u", "v"} <= set(vis.columns)


def _leg(vis: DataFrame, a: str, b: str, n: str) -> DataFrame:
    uv = [F.col(c).alias(f"{n}_{c}") for c in "uv"] if _has_uv(vis) else []
    return vis.select("time", F.col("t1").alias(a), F.col("t2").alias(b), F.col("vis_re").alias(f"{n}_re"), F.col("vis_im").alias(f"{n}_im"), F.col("sigma").alias(f"{n}_s"), *uv)


def _mean_legs(table: DataFrame) -> list[Column]:
    return [F.avg(c).alias(c) for c in LEGS if c in table.columns]


def bispectra(vis: DataFrame, minimal: bool = False) -> DataFrame:
    """(time, t1, t2, t3, bispec_re, bispec_im, sigmab and the legs' u1, v1 .. u3, v3) of triangles over canonical baselines (t1 < t2).

    Legs go round the triangle: 1 to 2, 2 to 3, 3 to 1. ``minimal`` keeps the triangles of each time's first station only.
    """
    joined = _leg(vis, "t1", "t2", "a").join(_leg(vis, "t2", "t3", "b"), ["time", "t2"]).join(_leg(vis, "t1", "t3", "c"), ["time", "t1", "t3"])
    if minimal:
        first = vis.groupBy("time").agg(F.min(F.least("t1", "t2")).alias("t1"))
        joined = joined.join(first, ["time", "t1"], "left_semi")
    b = cx.mul(cx.mul(cx.pair("a"), cx.pair("b")), cx.conj(cx.pair("c")))
    part = lambda n: F.col(f"{n}_s") * F.col(f"{n}_s") / F.nullif(F.col(f"{n}_re") * F.col(f"{n}_re") + F.col(f"{n}_im") * F.col(f"{n}_im"), F.lit(0.0))
    uv = [(-F.col(f"{n}_{c}") if n == "c" else F.col(f"{n}_{c}")).alias(f"{c}{k}") for k, n in enumerate("abc", 1) for c in "uv"] if _has_uv(vis) else []
    return joined.select("time", "t1", "t2", "t3", b[0].alias("bispec_re"), b[1].alias("bispec_im"), (cx.amplitude(b) * F.sqrt(part("a") + part("b") + part("c"))).alias("sigmab"), *uv)


def closure_phases(vis: DataFrame, minimal: bool = False, snr_cut: float = 0.0) -> DataFrame:
    """Degrees; those of a signal to noise (1 / error in radians) above the cut."""
    b = bispectra(vis, minimal)
    legs = [c for c in LEGS if c in b.columns]
    out = b.select("time", "t1", "t2", "t3", (cx.phase(cx.pair("bispec")) / DEGREE).alias("cphase"), (F.col("sigmab") / F.nullif(cx.amplitude(cx.pair("bispec")), F.lit(0.0)) / DEGREE).alias("sigmacp"), *legs)
    return out.filter(1 / (F.col("sigmacp") * DEGREE) > snr_cut) if snr_cut > 0 else out


def average_phases(cphases: DataFrame, seconds: float, snr_cut: float = 0.0) -> DataFrame:
    """Circular mean of each triangle and bucket (above the cut); buckets round half to even."""
    bucket = F.rint(F.col("time") * 3600.0 / seconds).cast("long")
    r = F.col("cphase") * DEGREE
    out = cphases.groupBy("t1", "t2", "t3", bucket.alias("bucket")).agg((F.atan2(F.avg(F.sin(r)), F.avg(F.cos(r))) / DEGREE).alias("cphase"), (F.sqrt(F.sum(F.col("sigmacp") * F.col("sigmacp"))) / F.count(F.lit(1))).alias("sigmacp"), F.avg("time").alias("time"), F.count(F.lit(1)).alias("n"), *_mean_legs(cphases))
    return out.filter(1 / (F.col("sigmacp") * DEGREE) > snr_cut) if snr_cut > 0 else out


def average_bispectra(bispectra_: DataFrame, seconds: float, snr_cut: float = 0.0) -> DataFrame:
    """Mean bispectrum of each triangle and bucket (rounded half to even), of those above the cut."""
    bucket = F.rint(F.col("time") * 3600.0 / seconds).cast("long")
    grouped = bispectra_.groupBy("t1", "t2", "t3", bucket.alias("bucket")).agg(F.avg("bispec_re").alias("bispec_re"), F.avg("bispec_im").alias("bispec_im"), (F.sqrt(F.sum(F.col("sigmab") * F.col("sigmab"))) / F.count(F.lit(1))).alias("sigmab"), F.avg("time").alias("time"), F.count(F.lit(1)).alias("n"), *_mean_legs(bispectra_))
    return grouped.filter(cx.amplitude(cx.pair("bispec")) / F.nullif(F.col("sigmab"), F.lit(0.0)) > snr_cut)


def average_amplitudes(camps: DataFrame, seconds: float) -> DataFrame:
    """Mean closure amplitude of each quadrangle and bucket (rounded half to even)."""
    bucket = F.rint(F.col("time") * 3600.0 / seconds).cast("long")
    return camps.groupBy("t1", "t2", "t3", "t4", bucket.alias("bucket")).agg(F.avg("camp").alias("camp"), (F.sqrt(F.sum(F.col("sigmaca") * F.col("sigmaca"))) / F.count(F.lit(1))).alias("sigmaca"), F.avg("time").alias("time"), F.count(F.lit(1)).alias("n"), *_mean_legs(camps))


def _quadrangles(count: str):
    """The quadrangles (12)(34)/(14)(23) over the array ``s`` of a time's stations in order."""
    s = F.col("s")
    n = F.size(s)
    to = lambda low, high: F.when(low < high, F.sequence(low, high - 1)).otherwise(F.array().cast("array<int>"))
    at = lambda i: F.get(s, i)
    four = lambda a, b, c, d: F.struct(a.alias("t1"), b.alias("t2"), c.alias("t3"), d.alias("t4"))
    if count == "min":
        each = lambda i: F.transform(to(F.lit(1), i), lambda j: four(at(F.lit(0)), at(i), at(j), at(F.when(j == i - 1, 1).otherwise(j + 1))))
        return F.flatten(F.transform(to(F.lit(3), n), each))
    three = lambda a, b, c, d: F.array(four(a, b, c, d), four(a, c, b, d), four(a, b, d, c))
    last = lambda i, j, k: F.flatten(F.transform(to(k + 1, n), lambda m: three(at(i), at(j), at(k), at(m))))
    third = lambda i, j: F.flatten(F.transform(to(j + 1, n), lambda k: last(i, j, k)))
    second = lambda i: F.flatten(F.transform(to(i + 1, n), lambda j: third(i, j)))
    return F.flatten(F.transform(to(F.lit(0), n), second))


def closure_amplitudes(vis: DataFrame, count: str = "max", kind: str = "camp", debias: bool = True, snr_cut: float = 0.0, columns: tuple[str, ...] = ()) -> DataFrame:
    """(time, t1..t4, camp, sigmaca and the legs' u1, v1 .. u4, v4): three quadrangles of every four stations ("max"), or those that suffice ("min").

    Legs are 12, 34, 14 and 23.
    ``kind`` is "camp" or "logcamp". ``vis`` may also be a table of amplitudes (amp, sigma). A time's rows are brought together once; its baselines are looked up in a map.
    ``columns`` (a prefix of complex columns each) adds the same quantity of other values, not debiased.
    """
    key = lambda a, b: F.concat_ws("|", F.least(a, b), F.greatest(a, b))
    uv = _has_uv(vis)
    turn = F.when(F.col("t1") < F.col("t2"), 1.0).otherwise(-1.0)
    size = F.col("amp") if "vis_re" not in vis.columns else cx.amplitude(cx.pair("vis"))
    leg = F.struct(size.alias("amp"), "sigma", *[(F.col(c) * turn).alias(c) for c in "uv" if uv], *[cx.amplitude(cx.pair(c)).alias(c) for c in columns])
    times = vis.groupBy("time").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("t1", "t2"))))).alias("s"), F.map_from_entries(F.collect_list(F.struct(key(F.col("t1"), F.col("t2")), leg))).alias("legs"))
    rows = times.select("time", "legs", F.explode(_quadrangles(count)).alias("q")).select("time", "q.*", "legs")
    pairs = {"p1": ("t1", "t2"), "p2": ("t3", "t4"), "p3": ("t1", "t4"), "p4": ("t2", "t3")}
    rows = rows.withColumns({p: F.try_element_at("legs", key(F.col(a), F.col(b))) for p, (a, b) in pairs.items()}).drop("legs").filter(" and ".join(f"{p} is not null" for p in pairs))

    def amplitude(p: str, force: bool):
        a, s = F.col(f"{p}.amp"), F.col(f"{p}.sigma")
        return F.when(a > s, F.sqrt(a * a - s * s)).otherwise(s) if force else a

    rows = rows.withColumns({f"a{k}": amplitude(f"p{k}", debias) for k in "1234"})
    inverse = [F.col(f"p{k}.sigma") / F.nullif(F.col(f"a{k}"), F.lit(0.0)) for k in "1234"]
    squares = [x * x for x in inverse]
    error = F.sqrt(squares[0] + squares[1] + squares[2] + squares[3])
    combine = (lambda a, b, c, d: a * b / F.nullif(c * d, F.lit(0.0))) if kind == "camp" else (lambda a, b, c, d: F.log(a) + F.log(b) - F.log(c) - F.log(d))
    value = combine(*(F.col(f"a{k}") for k in "1234"))
    spread = value * error if kind == "camp" else error
    if debias:
        new = value / (1 + squares[2] + squares[3]) if kind == "camp" else value + 0.5 * (squares[0] + squares[1] - squares[2] - squares[3])
    else:
        new = value
    legs = [(F.when(F.col(a) < F.col(b), F.col(f"{p}.{c}")).otherwise(-F.col(f"{p}.{c}"))).alias(f"{c}{p[1]}") for p, (a, b) in pairs.items() for c in "uv"] if uv else []
    out = rows.select("time", "t1", "t2", "t3", "t4", new.alias("camp"), spread.alias("sigmaca"), *legs, *[combine(*(F.col(f"p{k}.{c}") for k in "1234")).alias(c) for c in columns])
    if snr_cut > 0:
        out = out.filter((F.col("camp") / F.col("sigmaca") if kind == "camp" else 1 / F.col("sigmaca")) >= snr_cut)
    return out


def noise_rescale(cphases: DataFrame, gap_hours: float, least: int) -> DataFrame:
    """Median over triangles of the deviation of successive phase differences over their errors; 1 if there is none."""
    w = Window.partitionBy("t1", "t2", "t3").orderBy("time")
    d = F.pmod(F.col("cphase") - F.lag("cphase").over(w) + 180.0, F.lit(360.0)) - 180.0
    s, before = F.col("sigmacp"), F.lag("sigmacp").over(w)
    x = cphases.select("t1", "t2", "t3", (F.col("time") - F.lag("time").over(w)).alias("dt"), (d / F.sqrt(s * s + before * before)).alias("d")).filter(F.col("dt") < gap_hours)
    return x.groupBy("t1", "t2", "t3").agg(F.stddev_pop("d").alias("spread"), F.count("d").alias("n")).filter(F.col("n") > least).agg(F.coalesce(F.median("spread"), F.lit(1.0)).alias("factor"))


def _turned_legs(table: DataFrame, old: list[tuple[str, str]], new: list[tuple[Column, Column]]) -> dict[str, Column]:
    """Coordinates of the legs between the stations of ``new``, found among those of ``old`` (columns of stations), if the table has legs."""
    out = {}
    for k, (x, y) in enumerate(new, 1):
        for c in "uv":
            if f"{c}{k}" in table.columns:
                ways = [F.when((F.col(p) == x) & (F.col(q) == y), F.col(f"{c}{j}")).when((F.col(p) == y) & (F.col(q) == x), -F.col(f"{c}{j}")) for j, (p, q) in enumerate(old, 1)]
                out[f"{c}{k}"] = F.coalesce(*ways)
    return out


TRIANGLE = [("t1", "t2"), ("t2", "t3"), ("t3", "t1")]
QUADRANGLE = [("t1", "t2"), ("t3", "t4"), ("t1", "t4"), ("t2", "t3")]


def one_triangle(table: DataFrame, a: str, b: str, c: str, value: str = "cphase") -> DataFrame:
    """Rows of the triangle in any order of its stations, as a, b, c: odd orders change the sign of the phase."""
    from ..functions.scalars import parity

    sign = parity([F.col("t1"), F.col("t2"), F.col("t3")], [F.lit(a), F.lit(b), F.lit(c)])
    legs = _turned_legs(table, TRIANGLE, [(F.lit(x), F.lit(y)) for x, y in ((a, b), (b, c), (c, a))])
    return table.filter(sign.isNotNull()).withColumns(legs | {"t1": F.lit(a), "t2": F.lit(b), "t3": F.lit(c), value: F.col(value) * sign})


def _same_forms(a, b, c, d) -> list[tuple]:
    """Orders of four stations that give the same closure amplitude (12)(34)/(14)(23)."""
    return [(a, b, c, d), (b, a, d, c), (c, d, a, b), (d, c, b, a)]


def _inverse_forms(a, b, c, d) -> list[tuple]:
    return [(a, d, c, b), (b, c, d, a), (c, b, a, d), (d, a, b, c)]


def _inverted(table: DataFrame, inverse: Column, log: bool) -> dict[str, Column]:
    """camp and sigmaca, of the inverse amplitude where asked for; the error of an inverse is that of the value over its square."""
    turned = -F.col("camp") if log else 1 / F.nullif(F.col("camp"), F.lit(0.0))
    error = F.col("sigmaca") if log else F.col("sigmaca") / F.nullif(F.col("camp") * F.col("camp"), F.lit(0.0))
    return {"camp": F.when(inverse, turned).otherwise(F.col("camp")), "sigmaca": F.when(inverse, error).otherwise(F.col("sigmaca"))}


def one_quadrangle(table: DataFrame, a: str, b: str, c: str, d: str, log: bool = False) -> DataFrame:
    """Closure amplitudes (12)(34)/(14)(23) of four stations, from any equal or inverse form of theirs."""
    stations = F.array("t1", "t2", "t3", "t4")
    is_one = lambda forms: F.coalesce(*[F.when(stations == F.array(*[F.lit(s) for s in f]), F.lit(True)) for f in forms], F.lit(False))
    same, inverse = is_one(_same_forms(a, b, c, d)), is_one(_inverse_forms(a, b, c, d))
    legs = _turned_legs(table, QUADRANGLE, [(F.lit(x), F.lit(y)) for x, y in ((a, b), (c, d), (a, d), (b, c))])
    return table.filter(same | inverse).withColumns(legs | _inverted(table, inverse, log) | {"t1": F.lit(a), "t2": F.lit(b), "t3": F.lit(c), "t4": F.lit(d)})


def minimal_quadrangles(table: DataFrame, vis: DataFrame, log: bool = False) -> DataFrame:
    """The rows of a maximal table of closure amplitudes that form a minimal set: those equal, or inverse, to one of their time's minimal set.

    A quadrangle's eight orders share a canonical form (its first station first, the earlier of that one's two neighbours second), which
    both sides are joined on; inverse rows are turned into the set's own amplitude. Rows that are equal keep the order of their stations.
    """
    stations = vis.groupBy("time").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("t1", "t2"))))).alias("s"))
    wanted = stations.select("time", F.explode(_quadrangles("min")).alias("q")).select("time", "q.*")

    def canonical(t1: Column, t2: Column, t3: Column, t4: Column) -> Column:
        return F.array_min(F.array(*[F.array(*f) for f in _same_forms(t1, t2, t3, t4) + _inverse_forms(t1, t2, t3, t4)]))

    names = [f"t{k}" for k in range(1, 5)]
    own = table.withColumn("_form", canonical(*map(F.col, names)))
    key = wanted.select(F.col("time").alias("_time"), canonical(*map(F.col, names)).alias("_key"), F.array(*names).alias("_set"))
    joined = own.join(key, (F.col("time") == F.col("_time")) & (F.col("_form") == F.col("_key")))
    stations_ = F.array(*names)
    w = [F.get("_set", F.lit(k)) for k in range(4)]
    same = F.coalesce(*[F.when(stations_ == F.array(*f), F.lit(True)) for f in _same_forms(*w)], F.lit(False))
    turned = {k: F.when(same, F.col(k)).otherwise(x) for k, x in (("t2", F.col("t4")), ("t4", F.col("t2")))}
    # The inverse of (12)(34)/(14)(23) has t2 and t4 exchanged: its legs are 14, 32, 12 and 43.
    legs = {}
    for c in "uv":
        if f"{c}1" in table.columns:
            flip = {1: F.col(f"{c}3"), 2: -F.col(f"{c}4"), 3: F.col(f"{c}1"), 4: -F.col(f"{c}2")}
            legs |= {f"{c}{k}": F.when(same, F.col(f"{c}{k}")).otherwise(x) for k, x in flip.items()}
    return joined.withColumns(turned | legs | _inverted(table, ~same, log)).select(*table.columns)


def amplitude_table(vis: DataFrame, seconds: float = 0.0, debias: bool = True, snr_cut: float = 0.0) -> DataFrame:
    """(time, t1, t2, u, v, amp, sigma) of each row or, if ``seconds`` are given, of incoherent averages; above the signal to noise cut."""
    from .visibility import debiased, incoherent

    if seconds > 0:
        means = incoherent(vis, seconds, debias)
        out = means.withColumn("time", (F.col("bucket") + 0.5) * (seconds / 3600.0))
    else:
        a = cx.amplitude(cx.pair("vis"))
        out = vis.withColumn("amp", debiased(a, F.col("sigma")) if debias else a)
    return out.select("time", "t1", "t2", *[c for c in "uv" if c in out.columns], "amp", "sigma").filter(F.col("amp") / F.nullif("sigma", F.lit(0.0)) > snr_cut)


def bispectrum_table(vis: DataFrame, seconds: float = 0.0, minimal: bool = False, snr_cut: float = 0.0) -> DataFrame:
    """Bispectra of each time or averaged over ``seconds``; the cut is on the averages."""
    b = bispectra(vis, minimal)
    if seconds > 0:
        return average_bispectra(b, seconds, snr_cut)
    return b.filter(cx.amplitude(cx.pair("bispec")) / F.nullif(F.col("sigmab"), F.lit(0.0)) > snr_cut)


def phase_table(vis: DataFrame, seconds: float = 0.0, minimal: bool = False, snr_cut: float = 0.0) -> DataFrame:
    """Closure phases of each time or averaged over ``seconds``; the cut is on the averages."""
    return average_phases(closure_phases(vis, minimal), seconds, snr_cut) if seconds > 0 else closure_phases(vis, minimal, snr_cut)


def closure_amplitude_table(vis: DataFrame, seconds: float = 0.0, count: str = "max", kind: str = "camp", debias: bool = True, snr_cut: float = 0.0) -> DataFrame:
    """Closure amplitudes of the amplitudes of ``amplitude_table``: averaged first, if asked for, and closed then, without another debiasing."""
    return closure_amplitudes(amplitude_table(vis, seconds, debias) if seconds > 0 else vis, count, kind, False, snr_cut)


def minimal_triangles(table: DataFrame, vis: DataFrame) -> DataFrame:
    """The triangles of a maximal table that hold their time's first station."""
    first = vis.groupBy("time").agg(F.min(F.least("t1", "t2")).alias("t1"))
    return table.join(first, ["time", "t1"], "left_semi")


def triangles_without_short(vis: DataFrame, uv_min: float, minimal: bool = True) -> DataFrame:
    """Triangles of which no side is shorter than ``uv_min``.

    A minimal set goes through each time's first station; where a station has a short side to it, the triangles of that station
    go through the first station that neither end is close to instead.
    """
    short = vis.filter(F.hypot("u", "v") < uv_min).select("time", "t1", "t2")
    every = bispectra(vis)
    for x, y in (("t1", "t2"), ("t2", "t3"), ("t1", "t3")):
        every = every.join(short.select("time", F.col("t1").alias(x), F.col("t2").alias(y)), ["time", x, y], "left_anti")
    if not minimal:
        return every
    # Each pair of other stations keeps the triangle through its first possible reference.
    sides = every.withColumn("_k", F.row_number().over(Window.partitionBy("time", "t2", "t3").orderBy("t1")))
    return sides.filter("_k = 1").drop("_k")
