"""Station corruptions as 2 by 2 complex (Jones) matrices, in column expressions.

The matrix of a station and time has the columns j11, j12, j21, j22 (each _re and
_im) and acts on [[rr, rl], [lr, ll]] as J1 V J2 (conjugate transposed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import complexes as cx

CELLS = ("j11", "j12", "j21", "j22")
HANDS = ("rr", "rl", "lr", "ll")


def _turn(angle: Column) -> cx.Pair:
    return F.cos(angle), F.sin(angle)


def matrices(stations: DataFrame, rotated: bool = True) -> DataFrame:
    """Matrices of rows (site, time, r_re, r_im, l_re, l_im, dr_re, dr_im, dl_re, dl_im, feed), feed in radians.

    Gains times [[e(-f), dr e(f)], [dl e(-f), e(f)]], e(x) = exp(ix). With ``rotated`` false the data's field rotation has been
    taken out, so only the leakages turn, twice as far.
    """
    r, left, dr, dl, f = cx.pair("r"), cx.pair("l"), cx.pair("dr"), cx.pair("dl"), F.col("feed")
    own, cross = (f, f) if rotated else (F.lit(0.0), 2 * f)
    cells = (cx.mul(r, _turn(-own)), cx.mul(cx.mul(r, dr), _turn(cross)), cx.mul(cx.mul(left, dl), _turn(-cross)), cx.mul(left, _turn(own)))
    return stations.select("site", "time", *[c.alias(f"{n}_{x}") for n, z in zip(CELLS, cells, strict=True) for c, x in zip(z, ("re", "im"), strict=True)])


def invert(jones: DataFrame) -> DataFrame:
    """The inverse matrices; NULL where the determinant is 0."""
    a, b, c, d = (cx.pair(n) for n in CELLS)
    det = cx.sub(cx.mul(a, d), cx.mul(b, c))
    cells = (cx.div(d, det), cx.div(cx.scale(b, -1.0), det), cx.div(cx.scale(c, -1.0), det), cx.div(a, det))
    return jones.select("site", "time", *[e.alias(f"{n}_{x}") for n, z in zip(CELLS, cells, strict=True) for e, x in zip(z, ("re", "im"), strict=True)])


def _product(a: list[cx.Pair], b: list[cx.Pair]) -> list[cx.Pair]:
    return [cx.add(cx.mul(a[2 * i], b[j]), cx.mul(a[2 * i + 1], b[2 + j])) for i in (0, 1) for j in (0, 1)]


def _size(z: cx.Pair) -> Column:
    return z[0] * z[0] + z[1] * z[1]


def apply(circ: DataFrame, jones: DataFrame, errors: bool = False) -> DataFrame:
    """J1 V J2* of a circular table; a station and time without a matrix leaves it NULL. ``errors`` carries the sigmas along.

    The matrices are joined by station and time, once for each end, each a shuffle by (time, site) that equal keys share.
    """
    out = circ
    for k in (1, 2):
        out = out.join(jones.select("time", F.col("site").alias(f"t{k}"), *[F.col(f"{n}_{x}").alias(f"_{k}{n}_{x}") for n in CELLS for x in ("re", "im")]), ["time", f"t{k}"], "left")
    one, two = ([cx.pair(f"_{k}{n}") for n in CELLS] for k in (1, 2))
    away = [cx.conj(two[0]), cx.conj(two[2]), cx.conj(two[1]), cx.conj(two[3])]
    got = _product(_product(one, [cx.pair(f"{h}vis") for h in HANDS]), away)
    columns = {f"{h}vis_{x}": c for h, z in zip(HANDS, got, strict=True) for c, x in zip(z, ("re", "im"), strict=True)}
    if errors:
        s = {h: F.col(f"{h}sigma") * F.col(f"{h}sigma") for h in HANDS}
        for i in (0, 1):
            for j in (0, 1):
                total = sum((_size(one[2 * i + a]) * s[HANDS[2 * a + b]] * _size(two[2 * j + b]) for a in (0, 1) for b in (0, 1)), F.lit(0.0))
                columns[f"{HANDS[2 * i + j]}sigma"] = F.sqrt(total)
    return out.withColumns(columns).select(*circ.columns)


def opacity(vis: DataFrame, elevation1: Column, elevation2: Column, corrected: bool = False) -> DataFrame:
    """Amplitudes dimmed by exp(-(tau1 / sin e1 + tau2 / sin e2) / 2), or brightened again."""
    dim = F.exp((1.0 if corrected else -1.0) * (F.col("tau1") / F.sin(elevation1) + F.col("tau2") / F.sin(elevation2)) / 2)
    return vis.withColumns({c: F.col(c) * dim for c in vis.columns if c.endswith(("vis_re", "vis_im"))})
